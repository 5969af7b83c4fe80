"""Toxicity against a plain version that computes TF-IDF cosines, votes and calibrated scores from the texts."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ashlar.llm import toxicity as tox
from ashlar.llm.common import examples, located
from tests.llm.test_operators import hard, rated, table


def tokens(text):
    return re.findall(r"[^\W\d_]+", (text or "").lower())


class Plain:
    """Dense, term by term; takes from the model only which terms weigh fully, and its curve."""

    def __init__(self, rows, loud):
        n = len(rows)
        found = [Counter() for _ in rows]
        for c, (_, text, _) in zip(found, rows):
            for w in tokens(text):
                for form in [w] + [w[:k] + "*" for k in tox.BEGINNINGS if len(w) >= k]:
                    c[form] += 1
        df = Counter(form for c in found for form in c)
        self.loud = loud
        self.idf = {f: (math.log((1 + n) / (1 + m)) + 1) * (1 if f in loud else tox.QUIET) for f, m in df.items() if f in loud or not f.endswith("*") and tox.LEAST_DF <= m <= tox.MOST_SHARE * n}
        self.rows, self.vectors = rows, [self.vector(c) for c in found]
        plain = [y for v, (*_, y) in zip(self.vectors, rows) if not set(v) & loud]
        self.prior = (sum(plain) + 0.5) / (len(plain) + 2)

    def vector(self, counts):
        v = {f: (1 + math.log(m)) * self.idf[f] for f, m in counts.items() if f in self.idf}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {f: x / norm for f, x in v.items()}

    def cosines(self, text):
        counts = Counter(form for w in tokens(text) for form in [w] + [w[:k] + "*" for k in tox.BEGINNINGS if len(w) >= k])
        own = self.vector(counts)
        return own, [sum(x * v.get(f, 0) for f, x in own.items()) for v in self.vectors]

    def vote(self, text, without=None):
        own, cosines = self.cosines(text)
        if not own:
            return self.prior, []
        near = sorted((c, i) for i, c in enumerate(cosines) if c > 0 and i != without)[::-1][: tox.NEIGHBOURS]
        weights = [c**tox.POWER for c, _ in near]
        return (sum(w * self.rows[i][2] for w, (_, i) in zip(weights, near)) + tox.PRIOR * self.prior) / (sum(weights) + tox.PRIOR), [c for c, _ in near]


def test_scores_from_texts(spark):
    docs, labels, truth = lettered(spark, 250)
    rows = examples(docs, labels, "toxic", tox.EXAMPLES, tox.CHARS)
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    assert [i for i, *_ in rows] == sorted(i for i, (_, t) in truth.items() if i is not None and t is not None and texts.get(i) is not None and not tox_held(i))
    assert all(text == texts[i] and y == truth[i][1] for i, text, y in rows)
    model = tox.Model(rows)
    index_terms = set(model.terms)
    df = Counter(w for _, text, _ in rows for w in set(tokens(text)))
    assert {w for w, m in df.items() if 2 <= m <= tox.MOST_SHARE * len(rows)} <= index_terms
    loud = {f for f, t in model.terms.items() if not math.isclose(model.weights[t], (math.log((1 + len(rows)) / (1 + sum(f in forms(x) for _, x, _ in rows))) + 1) * tox.QUIET)}
    plain = Plain(rows, loud)
    assert model.prior == pytest.approx(plain.prior)
    votes = [plain.vote(text, i)[0] for i, (_, text, _) in enumerate(rows)]
    assert model.curve == pytest.approx(tox._logistic(np.array(votes), np.array([y for *_, y in rows], float)), rel=1e-3, abs=1e-3)
    scored = {r.doc_id: r for r in tox.score(located(docs), model).collect()}
    reached = 0
    for i, text in list(texts.items())[:120] + [(k, texts[k]) for k in (1000, 1001, 1002, 1003)]:
        vote, cosines = plain.vote(text)
        a, b = model.curve
        assert scored[i].score == pytest.approx(1 / (1 + math.exp(-(a * vote + b))), abs=1e-4)
        assert [e.cosine for e in scored[i].evidence] == pytest.approx(cosines, abs=1e-5)
        reached += bool(cosines)
    assert reached >= 120


def lettered(spark, n):
    """rated's rows, with words of letters beside: each of 400, so most are in fewer examples than stop words are."""
    docs, labels, truth = rated(spark, n)
    more = [F.concat(F.lit("q"), F.translate(F.pmod(F.xxhash64("doc_id", F.lit(k)), F.lit(400)).cast("string"), "0123456789", "abcdefghij")) for k in range(12)]
    return docs.withColumn("text", F.when(F.col("doc_id") < 1000, F.concat_ws(" ", "text", *more)).otherwise(F.col("text"))), labels, truth


def forms(text):
    return {f for w in tokens(text) for f in tox.forms(w)}


def tox_held(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 5 == 0


def test_given_documents_reach_the_index(spark):
    from tests.oracle import DATA

    docs, labels = (spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    found = tox.score(located(docs), tox.fit(docs, labels)).select(F.avg((F.size("evidence") > 0).cast("int"))).first()[0]
    assert found > 0.95


def test_examples_are_bounded(spark):
    docs, labels, _ = rated(spark, 100)
    assert len(examples(docs, labels, "toxic", 10, tox.CHARS)) == 10
    some = examples(docs, labels, "toxic", 1000, 2000)
    assert some and sum(len(text) for _, text, _ in some) <= 2000
    many = table(spark, [(1, f"text {i}") for i in range(50)])
    teach = spark.createDataFrame([(1, 1, 0), (1, 0, 1)], "doc_id long, quality int, toxic int")
    assert examples(many, teach, "toxic", 10, 1000) == ([] if tox_held(1) else [(1, "text 0", 1)])


def test_kept_rows_are_those_scored(spark):
    docs, labels, _ = rated(spark, 100)
    model = tox.fit(docs, labels)
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in tox.keep_clean(docs, labels).collect())
    assert kept == sorted((r.doc_id is None, r.doc_id or 0) for r in tox.score(located(docs), model).collect() if not r.predicted)
    assert tox.keep_clean(hard(spark), labels).columns == docs.columns
    assert tox.keep_clean(table(spark, []), labels).count() == 0
