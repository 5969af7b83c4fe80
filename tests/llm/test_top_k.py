"""Exact top-k search: rows that share an id, large components, what the bounds leave."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ashlar.llm import topk
from tests.llm.test_operators import brute_top
from tests.oracle import DATA

SCHEMA = "vec_id long, embedding array<double>"


def check(spark, rows, query, k, wave):
    df = spark.createDataFrame(rows, SCHEMA)
    found = [tuple(r) for r in topk.top_k(df, df.where(query), k, wave).collect()]
    return found


@pytest.mark.parametrize("wave", [1, 3, 4096])
def test_more_vectors_of_an_id_than_a_wave(spark, wave):
    rng = random.Random(1)
    rows = [(50, [rng.gauss(0, 1) * i for _ in range(4)]) for i in range(1, 8)] + [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(30)]
    whole = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows}
    found = check(spark, rows, "vec_id = 50", 5, wave)
    pairs = {(-sum(a * b for a, b in zip(q, x)), i, x) for j, q in whole if j == 50 for i, x in whole if i != 50}
    best = {}
    for s, i, x in sorted(pairs):
        best.setdefault((s, i, x), None)
    assert [(r[2], r[3]) for r in sorted(found)] == [(i, -s) for s, i, _ in list(best)[:5]]


@pytest.mark.parametrize("size", [1e6, 3e9, 2.0**40])
def test_large_components(spark, size):
    rows = [(1, [size, 0.0]), (2, [size, 0.0]), (3, [2 * size, 0.0]), (4, [-size, 0.5]), (5, [0.1, 0.1])]
    df = spark.createDataFrame(rows, SCHEMA)
    found = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id = 1"), 4).collect()}
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    wanted = sorted((-sum(a * b for a, b in zip(whole[1], whole[i])), i) for i in (2, 3, 4, 5))
    stop = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    if size < 1e9:
        assert found == {(1, n + 1): (i, -s) for n, (s, i) in enumerate(wanted)}
    assert {v[0]: v[1] for v in found.values()} == {i: stop(-s) for s, i in wanted}


def test_two_vectors_of_an_id_with_one_score(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.25]), (1, [0.5, 0.75]), (1, [0.5, 0.25]), (2, [0.25, 0.0])]
    found = check(spark, rows, "vec_id = 0", 3, 4096)
    assert sorted((r[1], r[2], r[3]) for r in found) == [(1, 1, 256 * 128), (2, 1, 256 * 128), (3, 2, 256 * 64)]


@pytest.mark.parametrize("n", [1, 2, 5, 16, 17, 64])
def test_bounds_hold(n):
    rng = np.random.default_rng(n)
    v = topk.Vectors(np.arange(40), rng.normal(size=(40, n)) * rng.uniform(0, 3, size=n))
    exact = v.whole @ v.whole.T
    slack = 1e-9 * np.abs(exact).max() + 1e-6
    by = topk.turn(v)
    assert np.allclose(by @ by.T, np.eye(n))
    turned = v.whole.astype(float) @ by
    for (single, starts), level in zip(topk.levels(n), topk.statistics(turned)):
        assert single == starts[0] <= 3 * n / 4 and (n <= 2 or single + level.shape[1] < n or single == 0)
        assert (turned[:, :single] @ turned[:, :single].T + level @ level.T >= exact - slack).all()


def survivors(rows, queries):
    batch = topk._joined([pa.RecordBatch.from_arrays([pa.array([i for i, _ in r]), pa.array([v for _, v in r], pa.list_(pa.float64()))], names=["vec_id", "embedding"]) for r in (rows,)], ["vec_id", "embedding"])
    (n, known), = topk.usable(batch).items()
    own = topk.Vectors(known.ids[queries], known.whole[queries] / 256.0)
    first = topk.start({n: own}, {n: (known, topk.turn(known))}, 5)[n]
    first.offer(known)
    return first.looked / first.looked[0], first.work / (first.looked[0] * n)


def test_bounds_prune(spark):
    """Work is counted in multiplications, against those of all pairs: less even where vectors have no preferred direction, a
    few hundredths where they have one, and each level is computed for what is left alone."""
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.1')}/embeddings.parquet").where(F.col("embedding").isNotNull()).collect()]
    left, work = survivors(rows, np.arange(0, len(rows), 50))
    assert all(a >= b for a, b in zip(left, left[1:])) and left[-1] <= 0.1 and work < 1
    rng = np.random.default_rng(0)
    energy = 0.8 ** np.arange(64)
    left, work = survivors([(i, (rng.normal(size=64) * energy).tolist()) for i in range(2000)], np.arange(0, 2000, 50))
    assert left[-1] < 0.05 and work < 0.5
    far = rng.normal(size=(40, 64))
    left, work = survivors([(i, (far[i % 40] * 5 + rng.normal(size=64)).tolist()) for i in range(2000)], np.arange(0, 2000, 50))
    assert left[-1] < 0.1 and work < 0.6


def test_brute_force_over_mixed_scales(spark):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) * rng.choice([0.01, 1, 1e4]) for _ in range(20)]) for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = {tuple(r) for r in topk.top_k(df, df.where("vec_id % 4 = 0"), 5, 10).collect()}
    assert found == brute_top(rows, [r for r in rows if r[0] % 4 == 0], 5)
