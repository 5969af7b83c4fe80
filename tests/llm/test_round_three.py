"""Edit embedding, ranked search and whitening against brute force, and their odd inputs."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from ashlar.llm import edits, quality, ranked, toxicity, whitening
from ashlar.llm.common import located
from tests.oracle import DATA, connect, same

DOCS = "doc_id long, text string, terms string, rank int, n long, __lode_bucket int"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], DOCS)


# ---- op3 and op4


def test_quality_learns_from_a_bounded_sample(spark, monkeypatch):
    """Of repeated identifiers one row each reaches the driver, and no more documents or characters than asked for."""
    seen = []
    monkeypatch.setattr(quality, "Model", lambda rows, wanted=None: seen.append(rows))
    docs = docs_of(spark, [(i % 5 + 1, f"text {i}") for i in range(2000)] + [(i, "long " * 100) for i in range(10, 60)] + [(None, "x"), (7, None)])
    labels = spark.createDataFrame([(i, i % 3, 0) for i in range(60)] + [(1, 0, 0), (None, 1, 0), (61, None, 0)], "doc_id long, quality int, toxic int")
    for most, chars, check in ((10, 10**6, lambda rows: 5 <= len(rows) <= 10), (1000, 10**6, lambda rows: 35 < len(rows) < 56), (1000, 1200, lambda rows: sum(len(t) for t, _ in rows) <= 1200)):
        quality.fit(docs, labels, most, None, chars)
        assert check(seen[-1]) and len({t for t, _ in seen[-1] if t.startswith("text")}) <= 5
    assert all(t == min(f"text {i}" for i in range(2000) if i % 5 + 1 == int(t.split()[1]) % 5 + 1) for t, _ in seen[1] if t.startswith("text"))


def test_toxicity_fitted_on_executors_is_that_of_the_rows(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9))) for _ in range(200)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(30)) + (" vile" + rng.choice("abc") if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(120)]
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    one = toxicity.fit(docs_of(spark, [r[:2] for r in rows]), labels)
    held = {r.doc_id for r in labels.selectExpr("doc_id", "crc32(CAST(doc_id AS STRING)) % 5 = 0 AS held").where("held").collect()}
    two = toxicity.Model([r for r in rows if r[0] not in held])
    assert one.terms == two.terms and (one.loud == two.loud).all() and np.allclose(one.weights, two.weights) and one.curve == pytest.approx(two.curve, rel=1e-5)
    for _, text, _ in rows[:20]:
        assert one.score(text)[0] == pytest.approx(two.score(text)[0], rel=1e-5) and [i for i, _ in one.score(text)[1]] == [i for i, _ in two.score(text)[1]]


# ---- op11


def test_places_are_the_least_hashes():
    for length in (1, 7, 8, 100, 5000, 400_000):
        found = edits.places().of(length)
        for band in (0, 13, 31):
            rank = edits.mixed(np.arange(length), 1000 + band)
            assert set(found[band]) == set(np.argsort(rank)[: edits.SYMBOLS])


def test_walks_side_by_side_are_those_of_one():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdé 😀") for _ in range(n)) for n in [0, 1, 2, 5, 900, 40, *range(60)]]
    codes = [edits.characters(t) for t in texts]
    prints, leaves = edits._prints(codes)
    table = edits.waits()
    for c, w, p, t in zip(codes, leaves, prints, texts):
        at, out = 0, []
        for code in (edits.mixed(c, 7) % np.uint64(edits.CLASSES)).tolist():
            at += table[int(code) * edits.PERIOD + at % edits.PERIOD]
            out.append(at)
        assert out == w.tolist() and str(p) == str(edits.print_of(t)) == str(edits.Print.parse(str(p)))


def test_waits_follow_the_bits():
    table = edits.waits()
    for c in (0, 5, 63):
        go = edits.mixed(np.arange(edits.PERIOD), 1 + c) >> np.uint64(63)
        for time in (0, 1, 77, edits.PERIOD - 2, edits.PERIOD - 1):
            wait = table[c * edits.PERIOD + time]
            assert [int(go[(time + i) % edits.PERIOD]) for i in range(wait)] == [0] * (wait - 1) + [1]


def test_likeness_estimates_the_share_that_agrees():
    rng = random.Random(1)
    text = "".join(rng.choice("etaoinshr ") for _ in range(4000))
    assert edits.likeness(edits.print_of(text), edits.print_of(text)) == 1
    found = [edits.likeness(edits.print_of(text), edits.print_of(text[:cut] + "Z" * (4000 - cut))) for cut in (3600, 2000, 400)]
    assert found[0] > 0.75 and 0.35 < found[1] < 0.65 and found[2] < 0.25
    assert edits.likeness(edits.print_of(""), edits.print_of("")) == 1 and edits.likeness(edits.print_of(""), edits.print_of("a")) == 0
    moved = edits.likeness(edits.print_of(text), edits.print_of(text[:10] + "q" + text[10:]))
    assert moved > 0.8  # a walk meets the other again after an insertion


@pytest.mark.parametrize("rows", [[], [(5, "alone")], [(None, "x"), (3, None), (3, "ab"), (1, ""), (2, "a"), (9, "long " * 3000), (None, None), (3, "ab")]])
def test_beside_next(spark, rows, monkeypatch):
    monkeypatch.setattr(edits, "BUCKET_ROWS", 2)
    found = [tuple(r)[:5] for r in edits.beside_next(docs_of(spark, rows)).collect()]
    order = sorted([(i is None, i or 0, t or "") for i, t in rows])
    wanted = Counter()
    options = {}
    for k, (absent, i, x) in enumerate(order):
        options.setdefault((absent, i), []).append(x)
    for r in found:
        wanted[(r[0] is None, r[0] or 0, r[1])] += 1
    assert wanted == Counter((a, i, len(t)) for a, i, t in order)
    if len({(a, i) for a, i, _ in order}) == len(order):
        for k, (absent, i, x) in enumerate(order):
            y = order[(k + 1) % len(order)][2]
            e = edits.edited(x, y)
            assert (None if absent else i, len(x), hashlib.sha256(e.encode()).hexdigest(), str(edits.print_of(x)), str(edits.print_of(e))) in found


def test_beside_next_over_a_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    found = {r.doc_id: r for r in edits.op11_edits(spark, DATA).collect()}
    assert len(found) == len(rows)
    for k, (i, x) in enumerate(rows):
        y = rows[(k + 1) % len(rows)][1]
        one, two, changed = edits.print_of(x), edits.print_of(y), edits.print_of(edits.edited(x, y))
        r = found[i]
        assert (r.n_chars, r.fingerprint, r.edited_fingerprint) == (len(x), str(one), str(changed))
        assert r.edited_sha256 == hashlib.sha256(edits.edited(x, y).encode()).hexdigest()
        assert (r.near_edited, r.near_next) == (edits.likeness(one, changed), edits.likeness(one, two))
    assert np.mean([r.near_edited for r in found.values()]) > 0.4 and np.mean([r.near_next for r in found.values()]) < 0.2


@pytest.mark.parametrize("in_memory", [3, 10_000])
def test_near_groups_against_all_pairs(spark, in_memory):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    rows = [(i, " ".join(word() for _ in range(120))) for i in range(30)]
    base = rows[4][1]
    rows += [(100 + i, base[: 600 - i] + word() + base[600 - i :]) for i in range(12)] + [(200, rows[7][1]), (201, None), (202, ""), (None, rows[7][1])]
    prints = [(i, edits.print_of(t)) for i, t in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if edits.likeness(prints[a][1], prints[b][1]) >= edits.LEAST:
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    least = {}
    for (i, _), r in zip(rows, root):
        least.setdefault(r, []).append(i)
    wanted = Counter((i, min((x for x in least[r] if x is not None), default=None)) for (i, _), r in zip(rows, root))
    found = Counter((r.doc_id, r.component_id) for r in edits.near_groups(docs_of(spark, rows), in_memory=in_memory).collect())
    assert found == wanted
    assert sum(c for (i, k), c in found.items() if k == 4) >= 10
    assert edits.near_groups(docs_of(spark, [])).count() == 0


# ---- op12


def brute_ranked(docs, items, k):
    docs = [(i, Counter(ranked.terms_of(t))) for i, t in docs]
    docs = [(i, tf) for i, tf in docs if tf]
    n_docs, n_terms = len(docs), sum(sum(tf.values()) for _, tf in docs)
    df = Counter(t for _, tf in docs for t in tf)
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(ranked.terms_of(text))
    out = []
    for item, terms in asked.items():
        found = []
        for i, tf in docs:
            m = 100 - 90 + 90 * sum(tf.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m)) for t in terms if t in tf)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, rank, None if absent else i, -s) for rank, (s, absent, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("vocabulary, sent", [(500_000, 200_000), (3, 200_000), (500_000, 4)])
def test_ranked_against_brute_force(spark, vocabulary, sent, monkeypatch):
    monkeypatch.setattr(ranked, "SENT", sent)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    draw = lambda n: " ".join(words[min(59, int(rng.expovariate(0.08)))] for _ in range(n))
    docs = [(i, draw(rng.randint(1, 80))) for i in range(150)] + [(7, docs_text := draw(30)), (300, docs_text), (301, docs_text), (302, None), (303, ""), (304, "W1,w2;W1 ÀÉ"), (None, draw(20)), (305, "!!")]
    items = [(i, draw(12)) for i in range(8)] + [(20, docs_text), (21, None), (22, "nowhere"), (None, "w1"), (3, "w9 À é àé ÀÉ"), (23, "w1")]
    made = spark.createDataFrame([(*r, "x", 1) for r in items], "item_id long, text string, term string, w int")
    found = ranked.search(docs_of(spark, docs), made, 5, vocabulary).collect()
    assert sorted(map(tuple, found), key=repr) == brute_ranked(docs, items, 5)


def test_ranked_empty_tables(spark):
    none, items = docs_of(spark, []), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked.search(none, items).count() == 0
    assert ranked.search(docs_of(spark, [(1, "a b")]), items.limit(0)).count() == 0
    # A term that every document holds may weigh nothing.
    assert ranked.search(docs_of(spark, [(i, "a") for i in range(2000)]), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


def test_ranked_sql(spark):
    same(ranked.op12_ranked(spark, DATA), connect(), ranked.ORACLE)


def test_thresholds_leave_few(spark):
    """Of pairs with a term in common few become candidates, and each candidate's bound holds."""
    Row = lambda item, term, w, first, bar, left: type("R", (), dict(item_id=item, term=term, w=w, first=first, bar=bar, left=left))()
    rows = [Row(1, "a", 100, True, 5000, 900), Row(1, "b", 10, False, 5000, 900), Row(2, "b", 10, True, 10, 0)]
    block = ranked.Block(rows, 2)
    a, b = block.terms["a"], block.terms["b"]
    # Documents: 0 has a, 1 has both, 2 has b, 3 has little of a, which can't reach 5000 with 900 more.
    block.offer(np.array([0, 1, 1, 2, 3]), np.array([a, a, b, b, a]), np.array([45, 41, 90, 90, 40]), [10, 11, 12, 13], [0, 1, 2, 3])
    assert block.looked.tolist() == [5, 4, 3]  # item 1 with 0, 1 and 3, item 2 with 1 and 2; 0 has 4500 only
    assert sorted(block.best[0]) == [(-5000, False, 1, 11)] and sorted(block.best[1]) == [(-900, False, 1, 11), (-900, False, 2, 12)]


# ---- op13


def brute_whitened(rows, k=16):
    usable = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    listed = [list(x) for x in {tuple(x) for _, x in usable}]
    n, d = len(listed), len(listed[0])
    sums = [sum(x[j] for x in listed) for j in range(d)]
    off = [[n * x[j] - sums[j] for j in range(d)] for x in listed]
    v = np.array([[sum(o[a] * o[b] for o in off) / n**3 for b in range(d)] for a in range(d)])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    out = []
    for i, x in usable:
        centred = [n * x[j] - sums[j] for j in range(d)]
        out.append((i, n, sum(c * c for c in centred), np.array([c / n for c in centred]) @ vectors / np.sqrt(values), values / np.trace(v)))
    return out


@pytest.mark.parametrize("size", [0.5, 3e4, 1e12, 1e25])
def test_whitening_against_exact_numbers(spark, size):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1 + j) * size for j in range(5)]) for i in range(60)]
    rows += [(7, rows[0][1]), (None, rows[1][1]), (90, None), (91, [1.0, None, 0.0, 0.0, 0.0]), (92, [math.nan] * 5), (93, [math.inf] + [0.0] * 4)]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "vec_id long, embedding array<double>, n int, packed string")
    found = sorted(whitening.whiten(df).collect(), key=lambda r: (repr(r.vec_id), r.deviation))
    wanted = sorted(brute_whitened(rows), key=lambda r: (repr(r[0]), str(r[2])))
    assert [(r.vec_id, r.n, int(r.deviation)) for r in found] == [w[:3] for w in wanted] and found[0].n == 60
    for r, w in zip(found, wanted):
        assert np.allclose(np.abs(r.whitened), np.abs(w[3]), rtol=1e-8, atol=1e-10) and np.allclose(r.explained, w[4], rtol=1e-9)
        assert r.identity_error < 1e-9


def test_products_are_exact():
    rng = random.Random(4)
    for bits, kind in ((6, np.int64), (19, np.int64), (40, np.int64), (61, np.int64), (90, object)):
        x = [[rng.randint(-(1 << bits), 1 << bits) for _ in range(3)] for _ in range(50)]
        found = whitening.products(np.array(x, kind))
        assert found.tolist() == [[sum(r[a] * r[b] for r in x) for b in range(3)] for a in range(3)]
        for value in found.ravel().tolist():
            assert sum(v << (32 * i) for i, v in enumerate(whitening._limbs(value))) == value
            assert all(0 <= v < 1 << 32 for v in whitening._limbs(value)[:-1])


def test_whitening_of_lengths_and_flat_directions(spark):
    rows = [(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [2.0, 1.0]), (4, [5.0]), (5, [6.0]), (6, []), (7, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = {r.vec_id: r for r in whitening.whiten(df).collect()}
    assert [round(found[i].whitened[0] ** 2, 9) for i in (1, 2, 3)] == [1.5, 0.0, 1.5] and found[1].whitened[1] is None
    assert found[1].n == 3 and found[4].n == 2 and found[7].n == 1 and found[7].whitened == [None] * 3 and found[6].whitened == []
    assert found[1].identity_error < 1e-12 and found[7].identity_error == 0
    assert whitening.whiten(df.limit(0)).count() == 0


def test_whitening_query(spark):
    found = whitening.op13_whitening(spark, DATA).collect()
    rows = [(r.vec_id, None if r.embedding is None else list(r.embedding)) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    wanted = {w[0]: w for w in brute_whitened(rows)}
    assert len(found) == 16 * len(wanted)
    for r in found:
        w = wanted[r.vec_id]
        assert (r.n, r.deviation) == (w[1], w[2]) and abs(abs(r.whitened) - abs(w[3][r.component - 1])) < 1e-8 and r.identity_error < 1e-4
        assert abs(r.explained - w[4][r.component - 1]) < 1e-10


def test_located_rows_keep_their_keys(spark):
    rows = located(docs_of(spark, [(1, "a")]))
    assert located(rows).columns == rows.columns
