"""Each operator against a brute-force version, over rows that are hard: nulls, empty and long texts, ties, repeated rows,
empty tables, extra columns whose names the operators use themselves."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ashlar.llm import chat, entry, exact_dedup, golay, langid, lmscore, mixing, packing, quality, simhash, topk, toxicity
from ashlar.llm.common import located
from ashlar.llm.components import components
from tests.oracle import DATA, connect, same

BPE = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, taken string, digest string, keep int, score double, class string, fp int, block int, label int"
HARD = [None, "", " \t\n", "a", "A", "a b c", "a  b\tc", "the same text twice", "the same text twice", "é ́ x's <|endoftext|> b", "w1 w2 w3 w4 w5 w6 w7", "W1 w2 w3 w4 w5 w6 w7", "  odd space\x1c here", "long " * 30_000]


def table(spark, rows):
    """rows (doc_id, text[, source[, lang]]) with clashing columns."""
    full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", 0, 1, "x", "d", 2, 0.5, "c", 7, 8, 1) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def hard(spark):
    rows = [(i, text, [None, "a", "b"][i % 3]) for i, text in enumerate(HARD)]
    return table(spark, [*rows, (None, "null id"), (3, "a", "a"), (3, "a", "a")])


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.mark.parametrize("name", sorted(entry.ORACLES))
def test_sql(spark, name):
    same(entry.QUERIES[name](spark, DATA), connect(), entry.ORACLES[name])


# Top k

def brute_top(rows, queries, k):
    def whole(v):
        return None if v is None or any(x is None or not math.isfinite(x) for x in v) else tuple(math.floor(256 * x) for x in v)

    usable = {(i, w) for i, v in rows if i is not None and (w := whole(v)) is not None}
    out = set()
    for q, a in {(i, w) for i, v in queries if i is not None and (w := whole(v)) is not None}:
        best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in usable if i != q and len(a) == len(b))[:k]
        out |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("wave, batch", [(4096, 2048), (3, 2)])
def test_top_k(spark, monkeypatch, wave, batch):
    monkeypatch.setattr(topk, "BATCH", batch)
    rng = random.Random(3)
    rows = [(i, [round(rng.gauss(0, 0.3), 3) for _ in range(7)]) for i in range(60)]
    rows += [(60, None), (61, [1.0, None] + [0.0] * 5), (62, [math.nan] * 7), (63, [math.inf] * 7), (64, [0.5, 0.5]), (65, [0.1, -0.2]), (66, []), (None, [0.0] * 7), rows[5], (70, rows[5][1]), (71, rows[5][1])]
    schema = "vec_id long, embedding array<float>, score int, rank int"
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], schema)
    exact = [(r.vec_id, r.embedding) for r in df.collect()]
    queries = df.where("vec_id % 5 = 0")
    found = topk.top_k(df, queries, 4, wave).collect()
    wanted = brute_top(exact, [r for r in exact if r[0] is not None and r[0] % 5 == 0], 4)
    assert {tuple(r) for r in found} == wanted and len(found) == len(wanted)
    empty = spark.createDataFrame([], schema)
    assert topk.top_k(empty, empty).count() == 0


# Mixing

def test_mixing(spark):
    docs = hard(spark)
    found = mixing.copies(docs).collect()
    assert len(found) == docs.count() and {tuple(sorted((r.doc_id is None, r.doc_id or 0) for r in found))} == {tuple(sorted((r.doc_id is None, r.doc_id or 0) for r in docs.collect()))}
    assert all(r.taken == r.copies * r["size"] and 0 <= r.copies <= 2 for r in found)
    again = mixing.copies(docs).collect()
    assert sorted((r.doc_id or -1, r.taken) for r in again) == sorted((r.doc_id or -1, r.taken) for r in found)
    whole = mixing.mix(docs)
    assert whole.columns == docs.columns and whole.count() == sum(r.copies for r in found)
    assert mixing.copies(table(spark, [])).count() == 0 and mixing.mix(table(spark, [])).count() == 0
    assert mixing.copies(table(spark, [(1, None), (2, "")])).select(F.sum("taken")).first()[0] == 0


def water_fill(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    goal, target, left = 1.5 * sum(sizes.values()), dict.fromkeys(order, 0.0), set(order)
    while True:
        share = (goal - sum(target[s] for s in order if s not in left)) / max(1, sum(weight[s] for s in left))
        over = {s for s in left if weight[s] * share > 2 * sizes[s] + 1e-9}
        for s in left:
            target[s] = 2.0 * sizes[s] if s in over else weight[s] * share
        if not over:
            return target
        left -= over


@settings(max_examples=8, deadline=None)
@given(st.dictionaries(st.sampled_from(["a", "b", "c", "d", "é", None]), st.integers(0, 400), min_size=1))
def test_mixing_targets(spark, sizes):
    rows = [(i * 1000 + j, "w " * min(7, n - 7 * j), s) for i, (s, n) in enumerate(sizes.items()) for j in range(-(-n // 7) or 1)]
    found = mixing.copies(table(spark, rows)).collect()
    source = {r[0]: r[2] for r in rows}
    wanted, taken = water_fill(sizes), Counter()
    for r in found:
        assert abs(r.target - wanted[source[r.doc_id]]) < 1e-6 * max(1, r.target) and r.source_size == sizes[source[r.doc_id]]
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - wanted[s]) <= 15 for s in sizes)


# Quality and toxicity

def rated(spark, n=400):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        toxic, quality_ = int(rng.random() < 0.3), rng.choice([0, 1, 2])
        words = [f"w{rng.randint(0, 200)}" for _ in range(40)] + ["vileness" + rng.choice(["", "ly", "ish"])] * (3 * toxic)
        words = [w + ("!!", "!", "")[quality_] for w in words]
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, quality_, toxic))
    rows += [(1000, None), (1001, ""), (1002, "vileness " * 20_000), (1003, "###"), (None, "null id"), (0, rows[0][1])]
    labels += [(None, 1, 1), (1000, None, None), (5000, 1, 1), (0, labels[0][1], labels[0][2])]
    return table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: (q, t) for i, q, t in labels}


def test_toxicity(spark):
    docs, labels, truth = rated(spark)
    found = toxicity.score(located(docs), toxicity.fit(docs, labels)).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    held = [r for r in found if r.held_out and r.doc_id in truth and truth[r.doc_id][1] is not None]
    assert held and all(r.predicted == truth[r.doc_id][1] for r in held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found if r.doc_id is not None)
    assert {r.doc_id: r.predicted for r in found if r.doc_id in (1000, 1001, 1002)} == {1000: 0, 1001: 0, 1002: 1}
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(not r.predicted for r in found)
    none = labels.limit(0)
    assert all(r.predicted == 0 for r in toxicity.score(located(docs), toxicity.fit(docs, none)).collect())
    assert toxicity.score(located(table(spark, [])), toxicity.fit(docs, labels)).count() == 0


def test_neighbours_are_exact(spark):
    docs, labels, _ = rated(spark, 300)
    model = toxicity.fit(docs, labels)
    index, n = model.index, len(model.terms) + 1
    dense = np.zeros((len(index.ids), n))
    for b, block in enumerate(index.blocks):
        for term, (at, weight) in block.items():
            dense[b * toxicity.BLOCK + at, term] = weight
    for text in [r.text for r in docs.limit(80).collect()] + ["vileness w1"]:
        terms, weights = model.vector(text)
        if len(terms):
            query = np.zeros(n)
            query[terms] = weights
            _, cosines = index.nearest(terms, weights, 7)
            wanted = np.sort((dense @ query)[dense @ query > 0])[::-1][:7]
            assert np.allclose(np.sort(cosines)[::-1], wanted)


def test_quality(spark):
    docs, labels, truth = rated(spark)
    model = quality.fit(docs, labels)
    assert model.grades == [0, 1, 2] and model.thresholds[0] < model.thresholds[1]
    found = quality.grade(located(docs), model).collect()
    assert len(found) == docs.count() and all(0 <= r.expected_grade <= 2 and 0 <= r.tail_probability <= 1 for r in found)
    held = [r for r in found if r.held_out and truth.get(r.doc_id, (None,))[0] is not None]
    assert sum(round(r.expected_grade) == truth[r.doc_id][0] for r in held) > 0.9 * len(held)
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.grade(located(docs), quality.fit(docs, labels.limit(0))).count() == docs.count()
    assert quality.grade(located(table(spark, [])), model).count() == 0


# Packing

def check_packing(docs, pieces, window=packing.WINDOW):
    tokenizer = Tokenizer.from_file(BPE)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for doc_id, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END]
        own = sorted(by_doc[doc_id], key=lambda p: p.start)
        assert [p.start for p in own] == [sum(p.length for p in own[:i]) for i in range(len(own))] and sum(p.length for p in own) == len(ids)
        assert b"".join(bytes(p.ids) for p in own) == np.array(ids, np.uint32).tobytes() and all(p.doc_tokens == len(ids) for p in own)
    padding = 0
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(p.length for p in own[:i]) for i in range(len(own))]
        total = sum(p.length for p in own)
        assert total <= window
        padding += 0 if not total & (total - 1) else window - total
    return padding, sum(p.length for p in pieces)


def test_packing(spark, documents):
    rows = [(i, text) for i, text in enumerate(HARD)]
    pieces = packing.pack(table(spark, rows), BPE).collect()
    check_packing(rows, pieces)
    real = [(r.doc_id, r.text) for r in documents.collect()]
    padding, total = check_packing(real, packing.pack(documents, BPE).collect())
    assert padding < 0.01 * total
    assert packing.pack(table(spark, []), BPE).count() == 0
    assert packing.pack(table(spark, [(1, "a"), (1, "a"), (None, "b")]), BPE).count() == 3


def test_small_groups_and_cache(documents, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 50)
    encode, tokenizer = packing.Encoder(BPE), Tokenizer.from_file(BPE)
    for r in documents.limit(20).collect():
        assert encode(r.text.encode()).tolist() == tokenizer.encode(r.text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aBé.,'sS \t\n\x1c\x85 <|endoftx>́H̱1½²İΣσ"), max_size=40))
def test_encoder(text):
    assert ENCODER(text.encode()).tolist() == PLAIN.encode(text, add_special_tokens=False).ids


ENCODER, PLAIN = packing.Encoder(BPE), Tokenizer.from_file(BPE)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_best_fit_decreasing(lengths):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if b[0] >= n]
        if not fits:
            bins.append([30, []])
        tightest = min(fits, key=lambda b: b[0]) if fits else bins[-1]
        tightest[0] -= n
        tightest[1].append(n)
    found = packing.best_fit(lengths, 30)
    assert sorted(i for own in found for i in own) == list(range(len(lengths)))
    assert sorted(sum(lengths[i] for i in own) for own in found) == sorted(30 - b[0] for b in bins)


# Chat

def test_chat_round_trip(spark):
    said = [None, "", "<|turn|>", "<\\|says|>", "</s>[INST] ok [/INST]", "\\\\<\\\\|done|>[\\INST]", "plain", "<<SYS>>", "x" * 50_000, "<s></s><|image:0|>"]
    rows = [(c, t, role, text, "x") for c in (1, None, -5) for t, (role, text) in enumerate(zip(["user", "assistant", None, "sys<|tem"] * 3, said))] + [(1, 3, "assistant", "again", "x"), (1, 3, "assistant", "again", "x"), (2, None, "assistant", "first", "x"), (2, 0, "user", "second", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments string")
    formatted = chat.format_conversations(df.select("*", chat.as_parts(F.col("text")).alias("parts")))
    back = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] is not None, r[3] or "")
    for conv in (1, None, -5, 2):
        own = sorted((r for r in rows if r[0] == conv), key=key)
        assert [(t.role, t.text) for t in back[conv].turns] == [(r[2] or "", r[3] or "") for r in own]
        assert back[conv].loss == "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert back[conv].formatted.count("<|turn|>") == len(own)
    assert chat.format_conversations(df.limit(0).select("*", chat.as_parts(F.col("text")).alias("parts"))).count() == 0


def test_chat_parts(spark):
    part = lambda kind, text=None, ref=None, tokens=None: (kind, text, ref, tokens)
    rows = [(1, 0, "user", [part("text", "see "), part("image", ref="a.png"), part(None, "<|x|>"), part("audio", ref="b.wav", tokens=9)]), (1, 1, "assistant", [part("document", ref="c.pdf"), part("text", "done")]), (1, 2, "user", None), (1, 3, "user", [part("smell", ref="d")])]
    r = chat.format_conversations(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")).first()
    assert r.formatted == "<|turn|>user<|says|>see <|image:0|><\\|x|><|audio:1|><|done|><|turn|>assistant<|says|><|document:2|>done<|done|><|turn|>user<|says|><|done|><|turn|>user<|says|><|smell:3|><|done|>"
    assert [(a.place, a.type, a.ref, a.tokens) for a in r.attachments] == [(0, "image", "a.png", 256), (1, "audio", "b.wav", 9), (2, "document", "c.pdf", 512), (3, "smell", "d", 1)]
    assert r.expanded_tokens == 256 + 9 + 512 + 1
    assert [s.text for s in r.segments if s.loss] == ["<|document:2|>done"]


# SimHash

def brute_fingerprint(text, shingle=4):
    words = (text or "").encode().lower().split()
    pieces = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(items, linked):
    parent = list(range(len(items)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(items))]


def test_golay():
    assert np.array_equal(np.bincount(golay.decode(np.arange(1 << 23))), np.full(4096, 2048))


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=4))
def test_keys_meet(fp, flips):
    other = fp
    for bit in flips:
        other ^= 1 << bit
    place, keys = simhash.keys_of(np.array([fp, other], np.uint64).view(np.int64))
    assert set(keys[place == 0]) & set(keys[place == 1])


@pytest.mark.parametrize("most", [50_000, 2])
def test_near_groups(spark, most):
    rng = random.Random(11)
    rows = [(r[0], r[1]) for r in enumerate(HARD)]
    for c in range(6):
        base = [f"v{rng.randint(0, 999)}" for _ in range(300)]
        for k in range(12):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = "edit"
            rows.append((1000 * (c + 1) + k, " ".join(own)))
    rows += [(7000, rows[-1][1]), (7000, rows[-1][1])]
    found = simhash.near_groups(table(spark, rows), in_memory=most).collect()
    by_id = {r.doc_id: r for r in found}
    fps = [brute_fingerprint(text) for _, text in rows]
    roots = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    least = defaultdict(lambda: 10**9)
    for (i, _), root in zip(rows, roots):
        least[root] = min(least[root], i)
    assert len(found) == len(rows)
    for (i, _), fp, root in zip(rows, fps, roots):
        assert by_id[i].fp % 2**64 == fp and by_id[i].component_id == least[root]
    assert sum(r["first"] for r in found) == len(set(roots))
    kept = simhash.near_dedup(table(spark, rows))
    assert kept.count() == len(set(roots)) and {r.doc_id for r in kept.collect()} == set(least.values())


def test_near_groups_of_nothing(spark):
    assert simhash.near_groups(table(spark, [])).count() == 0
    assert {r.component_id for r in simhash.near_groups(table(spark, [(None, None), (None, "")])).collect()} == {None}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_components(spark, pairs):
    links = {(min(p), max(p)) for p in pairs if p[0] != p[1]}
    found = dict(components(spark.createDataFrame(list(links), "low long, high long")).collect())
    for a, b in links:
        assert found.get(a, a) == found.get(b, b)
    roots = brute_components(list(range(26)), lambda a, b: (min(a, b), max(a, b)) in links)
    assert len({found.get(i, i) for i in range(26)}) == len(set(roots)) and all(root <= node for node, root in found.items())


# Exact deduplication

@pytest.mark.parametrize("keys", [300_000, 0])
@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda text: (F.length(text) % 3).cast("string")])
def test_exact_groups(spark, monkeypatch, digest, keys):
    import re

    monkeypatch.setattr(exact_dedup, "BROADCAST_KEYS", keys)
    docs = hard(spark)
    rows = [(r.doc_id, re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")) for r in docs.collect()]
    found = exact_dedup.groups_of(docs, digest).collect()
    assert len(found) == len(rows)
    size = Counter(text for _, text in rows)
    least = {}
    for i, text in rows:
        least[text] = min(least.get(text, math.inf), math.inf if i is None else i)
    wanted = sorted((i if i is not None else -1, least[t] if least[t] < math.inf else None, size[t]) for i, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.keep_id, r.group_size) for r in found) == wanted
    assert sum(r.kept for r in found) == len(size)
    kept = exact_dedup.exact_dedup(docs, digest)
    assert kept.columns == docs.columns and kept.count() == len(size)
    assert exact_dedup.groups_of(table(spark, []), digest).count() == 0


def test_digest_of_the_query(spark, documents):
    r = entry.QUERIES["op8_exact_dedup"](spark, DATA).orderBy("doc_id").first()
    text = " ".join(documents.where(f"doc_id = {r.doc_id}").first().text.split(" "))
    import re

    assert r.text_sha256 == hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text).encode()).hexdigest()


def test_state_survives_between_runs(spark, tmp_path):
    """A second run only adds rows; groups seen before keep their row."""
    schema = "__lode_file long, __lode_row long, doc_id long, digest string"
    rows = lambda *ids: spark.createDataFrame([(0, i, i, f"d{i % 3}") for i in ids], schema)
    folder, args = str(tmp_path / "rows"), (str(tmp_path / "out"), str(tmp_path / "state"))
    rows(3, 4, 5).write.parquet(folder)
    exact_dedup.stream_groups(spark.read.parquet(folder), *args)
    rows(0, 7).write.mode("append").parquet(folder)
    found = {r.digest: (r.keep.doc_id, r.n) for r in exact_dedup.stream_groups(spark.read.parquet(folder), *args, 1).collect()}
    assert found == {"d0": (0, 2), "d1": (4, 2), "d2": (5, 1)}


# Language model

@pytest.mark.parametrize("order, block", [(2, 1_500_000), (3, 100), (1, 50)])
def test_lm_scores(spark, monkeypatch, order, block):
    monkeypatch.setattr(lmscore, "BLOCK_TOKENS", block)
    rows = [(i, t) for i, t in enumerate([*HARD[:-1], "a b c a b", "b c a b a", "w1 w2 w1 w2", "a b c a b"])]
    found = {r.doc_id: r for r in lmscore.lm_scores(table(spark, rows), BPE, order).collect()}
    texts = [tuple(PLAIN.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    every = Counter(t[i : i + k] for t in texts for k in range(1, order + 1) for i in range(len(t) - k + 1))
    total = sum(map(len, texts))
    for (i, _), t in zip(rows, texts):
        own = Counter(t[j : j + k] for k in range(1, order + 1) for j in range(len(t) - k + 1))
        count = lambda gram: every[gram] - own[gram]

        def value(gram):
            if len(gram) == 1:
                return max(count(gram), 0.5) / max(1, total - len(t))
            return count(gram) / max(count(gram[:-1]), 1) if count(gram) > 0 else lmscore.BACKOFF * value(gram[1:])

        logprob = sum(math.log(value(t[max(0, j - order + 1) : j + 1])) for j in range(len(t)))
        assert found[i].n_tokens == len(t) and abs(found[i].logprob - logprob) < 1e-6 * max(1, abs(logprob))
        assert (found[i].mean_logprob is None) == (len(t) == 0)
    assert lmscore.lm_scores(table(spark, []), BPE, order).count() == 0


# Languages

def brute_grams(text):
    out = Counter()
    for word in "".join(c if c.isalpha() else "\0" for c in (text or "").lower()).split("\0"):
        v = [1, *(ord(c) + 1 for c in word), 1]
        if word:
            out.update(x << 42 for x in v[1:-1])
            out.update(x << 42 | y << 21 for x, y in zip(v, v[1:]))
            out.update(x << 42 | y << 21 | z for x, y, z in zip(v, v[1:], v[2:]))
    return out


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60), st.sampled_from([1, 2, 7, 1000]))
def test_grams(text, chunk):
    before, langid.CHUNK = langid.CHUNK, chunk
    try:
        found = langid.gram_counts(text)
    finally:
        langid.CHUNK = before
    assert dict(zip(*(x.tolist() for x in found))) == dict(brute_grams(text))


def test_languages(spark, documents):
    profiles = langid.fit(documents)
    teach = [r for r in documents.collect() if zlib.crc32(str(r.doc_id).encode()) % 5]
    for lang, profile in profiles.items():
        total = sum((brute_grams(r.text) for r in teach if r.lang == lang), Counter())
        assert profile == [g for g, _ in sorted(total.items(), key=lambda p: (-p[1], p[0]))[: langid.MOST]]
    found = langid.identify(documents, profiles).collect()
    truth = {r.doc_id: r.lang for r in documents.collect()}
    held = [r for r in found if r.held_out]
    assert len(found) == len(truth) and sum(r.lang_pred == truth[r.doc_id] for r in held) > 0.9 * len(held)


def test_languages_of_hard_rows(spark):
    docs = hard(spark)
    found = langid.identify(docs, langid.fit(docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "xx")))).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found)
    assert all(r.lang_pred == "und" for r in found if r.doc_id in (0, 1, 2))
    assert all(r.lang_pred == "und" for r in langid.identify(docs, {}).collect())
    assert langid.identify(table(spark, []), langid.fit(table(spark, []))).count() == 0
