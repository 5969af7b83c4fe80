"""Each stage on its own input, against a plain version, and the whole over the small tables."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from ashlar.llm import mixing, near
from ashlar.llm.common import materialise
from tests.llm.test_operators import PLAIN, brute_components, hard, table
from tests.oracle import DATA


def grams(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(texts, least=0.8):
    """The root of each text over all pairs with a Jaccard similarity of at least least."""
    sets = [grams(t) for t in texts]
    alike = lambda a, b: len(a & b) >= least * len(a | b)
    return brute_components(sets, alike)


def copies_of(seed, n=40, words=120):
    """Texts; of some there are copies with few words changed, near and just below the limit."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    rows = [(i, [word() for _ in range(words)]) for i in range(n)]
    for k in range(60):
        text = list(rows[rng.choice([1, 2, 3, 5])][1])
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(len(text))] = word()
        rows.append((100 + k, text))
    return [(i, " ".join(t)) for i, t in rows] + [(300, None), (301, ""), (302, "one two"), (303, "One  TWO"), (304, "three"), (None, " ".join(rows[1][1]))]


@pytest.mark.parametrize("together", [500_000, 300])
def test_near_groups_against_all_pairs(spark, together):
    rows = copies_of(4)
    wanted = {}
    for (i, _), root in zip(rows, brute_groups([t for _, t in rows])):
        wanted.setdefault(root, []).append(i)
    wanted = Counter((i, min(x for x in g if x is not None)) for g in wanted.values() for i in g)
    found = Counter((r.doc_id, r.component_id) for r in near.near_groups(table(spark, rows), together=together).collect())
    assert found == wanted and len({c for _, c in found}) < 70


def test_links_of_asking_sets_and_blocks():
    rng = random.Random(6)
    texts = [t for _, t in copies_of(9, 20, 60)]
    sets = {i: near.shingles(near.words_of((t or "").encode()), 5) for i, t in enumerate(texts)}

    def parts(roots):
        return sorted(tuple(i for i, r in enumerate(roots) if r == root) for root in set(roots))

    same = lambda links: parts(brute_components(list(range(len(texts))), lambda a, b: (min(a, b), max(a, b)) in links))
    assert same(set(near.links_of(sets, 0.8))) == parts(brute_groups(texts))
    asking = set(rng.sample(sorted(sets), 30))
    pairs = {(a, b) for a in sets for b in sets if a < b and {a, b} & asking and near.alike(sets[a], sets[b], 0.8)}
    assert same(set(near.links_of(sets, 0.8, asking))) == same(pairs)


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, sizes = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = materialise(stage(spark, docs, DATA), "stage")
        assert docs.columns == columns
        sizes.append(docs.count())
        old, new = [r.asDict() for r in before.collect()], [r.asDict() for r in docs.collect()]
        assert {r["doc_id"] for r in new} <= {r["doc_id"] for r in old}
        if name == "exact dedup":
            least = {}
            for r in old:
                key = re.sub(r"[\x20\x09-\x0D]+", " ", r["text"])
                least[key] = min(least.get(key, r["doc_id"]), r["doc_id"])
            assert sorted(r["doc_id"] for r in new) == sorted(least.values())
        if name == "near dedup":
            wanted, found = brute_groups([r["text"] for r in old]), [r["doc_id"] for r in new]
            groups = {}
            for r, root in zip(old, wanted):
                groups.setdefault(root, []).append(r["doc_id"])
            # A pair of copies may be missed where fingerprints are further apart; nothing else may go.
            assert {min(g) for g in groups.values()} <= set(found) and len(found) == len(set(found))
            pairs = sum(len(g) - 1 for g in groups.values())
            assert len(found) - len(groups) <= pairs // 10
        if name == "mixing":
            plan = {r.doc_id: r.copies for r in mixing.copies(before).collect()}
            assert Counter(r["doc_id"] for r in new) == Counter({i: n for i, n in plan.items() if n})
    assert sizes[0] >= sizes[1] >= sizes[2]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    tokens = sum(len(PLAIN.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert pieces.groupBy().sum("length").first()[0] == tokens


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0


def test_hard_rows(spark):
    docs = hard(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, DATA), "stage")
    assert docs.count() > 0
    empty = table(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0


def test_texts_of_the_same_words_are_not_candidates(spark, monkeypatch):
    """Only texts with shingles in common are compared: unrelated ones never grow into one component with their number."""
    rng, rows = random.Random(12), []
    words = [f"w{k}" for k in range(80)]
    for i in range(400):
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, rows[i][1] + " more") for i in range(20)]
    checked, seen = near._checked, []
    monkeypatch.setattr(near, "_checked", lambda members, *more: seen.append(members.select("id").distinct().count()) or checked(members, *more))
    found = {r.doc_id: r.component_id for r in near.near_groups(table(spark, rows)).collect()}
    assert found == {i: i % 1000 for i, _ in rows}
    assert seen == [40]


def test_components_end_at_stars(spark):
    """Stars are recognised without a round; chains, cycles and shared ends come down to them."""
    from ashlar.llm.components import _stars, components

    def roots(links):
        df = spark.createDataFrame(links, "low long, high long")
        return {r.node: r.root for r in components(df).collect()}, _stars(df)

    assert roots([(1, 2), (1, 3), (5, 9)]) == ({2: 1, 3: 1, 9: 5}, (3, True))
    assert roots([(1, 2), (2, 3), (3, 4), (4, 5)]) == ({2: 1, 3: 1, 4: 1, 5: 1}, (4, False))
    assert roots([(1, 9), (2, 9), (2, 8), (3, 8), (10, 11)]) == ({2: 1, 3: 1, 8: 1, 9: 1, 11: 10}, (5, False))
    assert roots([]) == ({}, (0, True))
