"""Exact top-k search by inner product over multi-resolution segment statistics.

Vectors are first turned by an orthogonal transform, fitted to a bounded sample, that moves their energy to the front; it
changes no inner product, and only bounds are taken from turned vectors. A level cuts the coordinates into segments, coarse
to fine: one segment of all, then an eighth of the coordinates one by one with two segments of the rest, and on by eighths
with one segment of the rest, up to three quarters. A segment keeps its mean and deviation, times the root of its length. The distance of two vectors
is at least that of such statistics, so their inner product is at most what they agree on in single coordinates and the
product of the statistics.

A task holds a bounded block of queries and reads its vectors in batches. A pair goes from coarse to fine only while its
bound reaches the query's k-th best score so far, and a level is computed for the pairs that are left, from what the level
before knows. Survivors are multiplied exactly, in integers, in falling order of their bounds. The k-th best score in the sample is where every task starts. Queries go to the tasks in waves of at most WAVE
rows, each of which reads the vectors once; a wave writes what each task found, k rows for each query and task at most, to
the shared folder, and those are ranked at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ashlar.llm.common import FILE, ROW, located, materialise, shared_path, table

WAVE, WAVE_BYTES, BATCH, FIRST, SAMPLE, NARROW = 4096, 64_000_000, 2048, 32, 2048, 2.0**31
_RESULT = "query_id long, vec_id long, score long, vector long"
_LEAST, _GREATEST = -(1 << 63), (1 << 63) - 1


class Vectors:
    """Vectors of one length as floor(256 * x): exact integers, and floats for bounds.

    Rows with a component of 2**31 or more are wide: their integers are kept beside, of any size, and have no bounds.
    """

    def __init__(self, ids: np.ndarray, raw: np.ndarray):
        scaled = np.floor(256.0 * np.where(np.abs(raw) < 2.0**900, raw, 0))
        wide = (np.abs(scaled) >= NARROW).any(axis=1) | (np.abs(raw) >= 2.0**900).any(axis=1)
        self.ids, self.whole = ids, np.where(wide[:, None], 0, scaled).astype(np.int64)
        self.wide = {int(i): [math.floor(256 * x) if abs(x) < 2.0**900 else 256 * int(x) for x in raw[i].tolist()] for i in np.flatnonzero(wide)}
        self.most = np.abs(self.whole).max(axis=1, initial=0).astype(np.float64)
        self.keys = np.array([xxhash.xxh3_64_intdigest(repr(self.wide[i]).encode() if i in self.wide else row.tobytes()) for i, row in enumerate(self.whole)], np.uint64).view(np.int64)

    def __len__(self) -> int:
        return len(self.ids)

    def integers(self, i: int) -> list[int]:
        return self.wide.get(i) or self.whole[i].tolist()


def usable(batch: pa.RecordBatch) -> dict[int, Vectors]:
    """A batch of (vec_id, embedding) by the vectors' length. Null vectors and those with a null or non-finite component are
    left out."""
    ids, column = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    offsets = column.offsets.to_numpy()
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    lengths, valid = np.diff(offsets), np.asarray(column.is_valid())
    out = {}
    for n in np.unique(lengths[valid]).tolist():
        rows = np.flatnonzero(valid & (lengths == n))
        raw = values[offsets[rows][:, None] + np.arange(n)] if n else np.zeros((len(rows), 0))
        finite = np.isfinite(raw).all(axis=1)
        if finite.any():
            out[n] = Vectors(ids[rows][finite].astype(np.int64), raw[finite])
    return out


def levels(n: int) -> list[tuple[int, list[int]]]:
    """For each level, coarse to fine: how many coordinates in front are taken one by one, and where the segments of the
    others start, and n. A level adds to the one before; none takes more than three quarters of the coordinates."""
    out: list[tuple[int, list[int]]] = []
    for single, segments in ((0, 1), (n // 8, 2), *((eighths * n // 8, 1) for eighths in range(2, 7))):
        cut = single, [*dict.fromkeys(np.linspace(single, n, min(segments, n - single) + 1).astype(int).tolist())] if n > single else [n]
        if len(cut[1]) > 1 and cut not in out and (not out or 2 * (len(cut[1]) - 1) + single < n):
            out.append(cut)
    return out


def statistics(turned: np.ndarray) -> list[np.ndarray]:
    """Of each level the segments' means and deviations, times the roots of their lengths (deviations as sums of squares).

    Inner products over the segments' coordinates are at most the products of these."""
    out = []
    for _, starts in levels(turned.shape[1]):
        part = turned[:, starts[0] :]
        sizes, at = np.diff(starts), np.array(starts[:-1]) - starts[0]
        mean = np.add.reduceat(part, at, axis=1) / sizes
        spread = part - np.repeat(mean, sizes, axis=1)
        several = sizes > 1
        deviation = np.sqrt(np.add.reduceat(spread**2, at, axis=1)[:, several])
        out.append(np.concatenate([mean * np.sqrt(sizes), deviation], axis=1))
    return out


def turn(sample: Vectors) -> np.ndarray:
    """An orthogonal matrix whose columns go from the sample's most to its least energetic direction."""
    rows = sample.whole.astype(np.float64)
    return np.ascontiguousarray(np.linalg.eigh(rows.T @ rows)[1][:, ::-1])


class Search:
    """The best k of what has been offered, for each of a block of queries of one length.

    looked counts pairs: all, those left after each level, those multiplied. work counts multiplications of two numbers.
    """

    def __init__(self, queries: Vectors, k: int, by: np.ndarray, least: np.ndarray | None = None):
        self.queries, self.k, self.by = queries, k, by
        self.turned = queries.whole.astype(np.float64) @ by
        self.levels, self.norms = statistics(self.turned), np.sqrt((self.turned**2).sum(axis=1))
        nothing = np.zeros(0, np.int64)
        self.best: list[tuple[np.ndarray, list[int], np.ndarray]] = [(nothing, [], nothing) for _ in range(len(queries))]  # ids, scores, keys
        self.worst = np.full(len(queries), -np.inf) if least is None else least.copy()
        self.worst[list(queries.wide)] = -np.inf
        self.looked, self.work = np.zeros(len(self.levels) + 2, np.int64), 0

    def offer(self, vectors: Vectors) -> None:
        turned = vectors.whole.astype(np.float64) @ self.by
        others, norms = statistics(turned), np.sqrt((turned**2).sum(axis=1))
        wide = np.zeros(len(vectors), bool)
        wide[sorted(vectors.wide)] = True
        singles = [single for single, _ in levels(turned.shape[1])]
        for mine in range(len(self.queries)):
            left = np.flatnonzero(vectors.ids != self.queries.ids[mine])
            self.looked[0] += len(left)
            slack = 1e-9 * self.norms[mine] * norms.max(initial=0) + 1e-6
            known, bound = np.zeros(len(left)), np.full(len(left), np.inf)
            if np.isneginf(self.worst[mine]):
                self.looked[1:-1] += len(left)
            else:
                before = 0
                for level, (single, other) in enumerate(zip(singles, others)):
                    if single > before:
                        known = known + turned[left, before:single] @ self.turned[mine, before:single]
                    bound = known + other[left] @ self.levels[level][mine]
                    self.work += len(left) * (single - before + other.shape[1])
                    bound[wide[left]] = np.inf
                    keep = bound >= self.worst[mine] - slack
                    left, known, bound, before = left[keep], known[keep], bound[keep], single
                    self.looked[level + 1] += len(left)
            order = np.argsort(-bound, kind="stable")
            first, rest = order[:FIRST], order[FIRST:]
            self._multiply(mine, left[first], vectors)
            self._multiply(mine, left[rest[bound[rest] >= self.worst[mine] - slack]], vectors)

    def _multiply(self, mine: int, some: np.ndarray, vectors: Vectors) -> None:
        if not len(some):
            return
        self.looked[-1] += len(some)
        n = vectors.whole.shape[1]
        self.work += len(some) * n
        ids, scores, keys = self.best[mine]
        small = mine not in self.queries.wide and n * self.queries.most[mine] * vectors.most[some].max(initial=0) < 2.0**62
        if small and not (vectors.wide and any(int(i) in vectors.wide for i in some)):
            found = (vectors.whole[some] @ self.queries.whole[mine]).tolist()
        else:
            own = self.queries.integers(mine)
            found = [sum(a * b for a, b in zip(own, vectors.integers(int(i)))) for i in some]
        rows = zip([*scores, *found], np.concatenate([ids, vectors.ids[some]]).tolist(), np.concatenate([keys, vectors.keys[some]]).tolist())
        top = sorted({(-s, i, key) for s, i, key in rows})[: self.k]  # a repeated row counts once
        self.best[mine] = np.array([i for _, i, _ in top], np.int64), [-s for s, _, _ in top], np.array([key for *_, key in top], np.int64)
        if len(top) == self.k and mine not in self.queries.wide:
            self.worst[mine] = max(self.worst[mine], float(-top[-1][0]))

    def rows(self) -> list[tuple[int, int, int, int]]:
        return [(int(q), i, max(_LEAST, min(_GREATEST, s)), key) for q, (ids, scores, keys) in zip(self.queries.ids, self.best) for i, s, key in zip(ids.tolist(), scores, keys.tolist())]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, wave: int = WAVE) -> DataFrame:
    """vectors(vec_id, embedding) and queries alike, to (query_id, rank, vec_id, score): each query's k highest scores.

    Ties go to the smaller vec_id. A query isn't its own candidate: rows with its vec_id are left out. Vectors that are
    null or hold a null or non-finite component take no part, nor do rows without vec_id; only vectors of one length are
    compared. Rows that repeat count once; different vectors of one vec_id are searched and found one by one, and queries
    of one vec_id share their k results. Scores are exact; one beyond 64 bits stops at the least or the greatest long. An
    empty table gives an empty result; other columns are not looked at.
    """
    spark = vectors.sparkSession
    pick = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    vectors = pick(vectors)
    asked = located(materialise(pick(queries).dropDuplicates(), "queries"))
    longest = asked.agg(F.max(F.size("embedding"))).first()[0] or 1
    wave = max(1, min(wave, WAVE_BYTES // (32 * longest)))  # integers, turned coordinates and statistics of each
    sample = {n: (v, turn(v)) for n, v in usable(_one_batch(vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE))).items()}
    out, last = shared_path(spark, "nearest"), None
    while True:  # pages by the place of a row, which is its own
        rest = asked if last is None else asked.where((F.col(FILE) > last[0]) | (F.col(FILE) == last[0]) & (F.col(ROW) > last[1]))
        block = _one_batch(rest.orderBy(FILE, ROW).limit(wave).select("vec_id", "embedding", FILE, ROW))
        if last is not None and not block.num_rows:
            break
        _wave(vectors, usable(block), sample, k).write.mode("append").parquet(out)
        if not block.num_rows:
            break
        last = block.column(2)[-1].as_py(), block.column(3)[-1].as_py()
    found = spark.read.schema(_RESULT).parquet(out).distinct()
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id", "vector")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _one_batch(df: DataFrame) -> pa.RecordBatch:
    """A bounded DataFrame as one batch in the driver."""
    return _joined(df.toArrow().combine_chunks().to_batches(), df.schema.names)


def _joined(batches: list[pa.RecordBatch], names: list[str]) -> pa.RecordBatch:
    if not batches:
        return pa.RecordBatch.from_arrays([pa.array([], pa.list_(pa.float64()) if name == "embedding" else pa.int64()) for name in names], names=names)
    return pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(i) for b in batches]) for i in range(len(names))], names=names)


def start(queries: dict[int, Vectors], sample: dict[int, tuple[Vectors, np.ndarray]], k: int) -> dict[int, Search]:
    """Searches whose bars are the k-th best scores in the sample."""
    searches = {}
    for n, own in queries.items():
        known, by = sample.get(n, (None, np.eye(n)))
        first = Search(own, k, by)
        if known is not None:
            first.offer(known)
        searches[n] = Search(own, k, by, first.worst)
    return searches


def _wave(vectors: DataFrame, queries: dict[int, Vectors], sample: dict[int, tuple[Vectors, np.ndarray]], k: int) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast(start(queries, sample, k))  # wave queries at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {n: Search(s.queries, k, s.by, s.worst) for n, s in shared.value.items()}
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = _joined([batch.slice(at, BATCH)], batch.schema.names)
                for n, found in usable(part).items():
                    if n in own:
                        own[n].offer(found)
        for search in own.values():
            rows = search.rows()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["query_id", "vec_id", "score", "vector"])

    return vectors.mapInArrow(run, _RESULT)


def op1_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


ORACLE = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM whole q JOIN whole x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id AND len(q.v) = len(x.v))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""
QUERIES, ORACLES = {"op1_topk": op1_topk}, {"op1_topk": ORACLE}
