"""Whitening of embeddings from an exact integer scatter matrix.

A component c becomes the integer x = floor(scale * c) + offset. Vectors are packed as the bytes of x less a shift, in the
narrowest integers that hold them, and each distinct one is kept once: that is the fit list, a table in the shared folder.
Tasks add up the list's sums and cross-products as integers of any size: products of limbs of LIMB bits, over blocks of
ROWS rows, stay below 2**53 and are exact in floats; everything above is Python's integers. Partial sums leave a task cut
into limbs of 32 bits, which Spark adds by (length, place, limb). n * X'X - S S' is formed from the totals exactly, turned
into floats by one correctly rounded division, and decomposed by eigh. A shift changes none of it.

A second pass over the rows projects; one over the fit list measures how far the covariance of what came out is from the
identity. The driver holds one matrix for each length of vectors (an embedding has one).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ashlar.llm.common import materialise, table

SCALE, OFFSET, COMPONENTS, LIMB, ROWS, PART = 64, 1_000_000, 16, 20, 4096, 32
_KINDS = {b"b": np.int8, b"h": np.int16, b"i": np.int32, b"l": np.int64}


def whole_numbers(batch: pa.Array, scale: int = SCALE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """floor(scale * c) of the usable vectors of a list column, by length: (places, one row a vector).

    Null vectors, and those with a null or non-finite component, are left out. Numbers that 62 bits don't hold come as
    Python's integers.
    """
    offsets, lengths, valid = batch.offsets.to_numpy(), np.diff(batch.offsets.to_numpy()), np.asarray(batch.is_valid())
    values = batch.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    for n in np.unique(lengths[valid]).tolist():
        rows = np.flatnonzero(valid & (lengths == n))
        raw = values[offsets[rows][:, None] + np.arange(n)] if n else np.zeros((len(rows), 0))
        finite = np.isfinite(raw).all(axis=1)
        rows, raw = rows[finite], raw[finite]
        narrow = (np.abs(raw) < 2.0**62 / scale).all(axis=1)
        if narrow.any():
            yield rows[narrow], np.floor(scale * raw[narrow]).astype(np.int64)
        for i in np.flatnonzero(~narrow):
            yield rows[i : i + 1], np.array([[math.floor(scale * x) if abs(x) < 2.0**900 else scale * int(x) for x in raw[i].tolist()]], object)


def pack(row: np.ndarray) -> bytes:
    """A vector of integers as a byte for their width and the integers themselves; wide ones as text."""
    if row.dtype == object:
        return b"w" + ",".join(map(str, row)).encode()
    most = max(int(row.max(initial=0)), -int(row.min(initial=0)) - 1)
    kind = next(k for k, t in _KINDS.items() if most <= np.iinfo(t).max)
    return kind + row.astype(_KINDS[kind]).tobytes()


def unpack(value: bytes) -> np.ndarray:
    if value[:1] == b"w":
        return np.array([int(x) for x in value[1:].split(b",")], object)
    return np.frombuffer(value, _KINDS[value[:1]], offset=1).astype(np.int64)


def fit_list(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """The distinct vectors of vectors(embedding): (length, packed), packed without the offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in whole_numbers(batch.column(0), scale):
                packed = list({pack(row) for row in x})
                yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]] * len(packed), pa.int32()), pa.array(packed, pa.binary())], names=["length", "packed"])

    return vectors.select(F.col("embedding").cast("array<double>")).mapInArrow(run, "length int, packed binary").distinct()


def products(x: np.ndarray) -> np.ndarray:
    """x'x as Python's integers, exactly, for at most ROWS rows of integers of any size."""
    limbs, rest = [], x
    while True:
        most = max((abs(int(v)) for v in (rest.max(initial=0), rest.min(initial=0))), default=0)
        if most < 1 << LIMB:
            limbs.append(rest.astype(np.float64))
            break
        low = rest & ((1 << LIMB) - 1)
        limbs.append(low.astype(np.float64))
        rest = rest >> LIMB
    total = np.zeros((x.shape[1], x.shape[1]), object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            total += (a.T @ b).astype(np.int64).astype(object) << (LIMB * (i + j))
    return total


def _limbs(value: int) -> list[int]:
    """value as parts of PART bits, the last one signed."""
    out = []
    while not -(1 << (PART - 1)) <= value < 1 << (PART - 1):
        out.append(value & ((1 << PART) - 1))
        value >>= PART
    return [*out, value]


def scatter(fit: DataFrame) -> DataFrame:
    """(length, place, limb, value): place 0 counts rows, 1 to length are the sums, those that follow the upper triangle of
    the cross-products; a number is the sum of value << (PART * limb)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}  # n, sums, products
        for batch in batches:
            by_length: dict[tuple[int, bool], list[np.ndarray]] = {}
            for length, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                row = unpack(value.as_py())
                by_length.setdefault((length, row.dtype == object), []).append(row)
            for (length, _), rows in by_length.items():
                own = held.setdefault(length, [0, np.zeros(length, object), np.zeros((length, length), object)])
                for at in range(0, len(rows), ROWS):
                    x = np.array(rows[at : at + ROWS]).reshape(len(rows[at : at + ROWS]), length)  # -1 isn't known where length is 0
                    own[0] += len(x)
                    own[1] += np.array([sum(map(int, column)) for column in x.T], object) if x.dtype == object else x.astype(object).sum(axis=0)
                    own[2] += products(x)
        for length, (n, sums, cross) in held.items():
            numbers = [n, *sums.tolist(), *cross[np.triu_indices(length)].tolist()]
            parts = [(place, limb, value) for place, number in enumerate(numbers) for limb, value in enumerate(_limbs(int(number)))]
            places, limbs, values = zip(*parts)
            yield pa.RecordBatch.from_arrays([pa.array([length] * len(parts), pa.int32()), pa.array(places, pa.int32()), pa.array(limbs, pa.int32()), pa.array(values, pa.int64())], names=["length", "place", "limb", "value"])

    partial = fit.mapInArrow(run, "length int, place int, limb int, value long")
    return partial.groupBy("length", "place", "limb").agg(F.sum("value").alias("value"))


class Model:
    """Components of the vectors of one length, of n rows with the sums, from exact cross-products (offset not counted)."""

    def __init__(self, n: int, sums: list[int], cross: np.ndarray, most: int = COMPONENTS):
        self.n, self.sums, d = n, sums, len(sums)
        exact = [[n * int(cross[i, j]) - sums[i] * sums[j] for j in range(d)] for i in range(d)]
        by = max(1, math.isqrt(max([exact[i][i] for i in range(d)], default=1)))  # keeps wide numbers within floats
        values, vectors = np.linalg.eigh(np.array([[v / (by * by) for v in row] for row in exact], np.float64).reshape(d, d))
        order = np.argsort(-values, kind="stable")[:most]
        self.values, self.vectors = np.maximum(values[order], 0), np.ascontiguousarray(vectors[:, order])
        trace = sum(exact[i][i] for i in range(d)) / (by * by)
        self.explained = self.values / trace if trace else np.zeros(len(order))
        # A direction without deviation, but for rounding, has no unit.
        steady = self.values > d * np.finfo(float).eps * max([*self.values, 0])
        self.root = np.where(steady, np.sqrt(self.values), np.nan)
        self.by = by

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly."""
        most = max([abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))]) * self.n + max(map(abs, self.sums), default=0)
        if x.dtype != object and most < 1 << 62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def squares(self, off: np.ndarray) -> list[int]:
        """The sum of squares of each row, exactly."""
        most = max(abs(int(off.max(initial=0))), abs(int(off.min(initial=0))))
        wide = off.dtype == object or most * most * max(1, off.shape[1]) >= 1 << 62
        return [sum(int(v) ** 2 for v in row) for row in off.tolist()] if wide else (off * off).sum(axis=1).tolist()

    def whitened(self, off: np.ndarray) -> np.ndarray:
        centred = np.array([[int(v) / self.by for v in row] for row in off.tolist()]).reshape(off.shape) if off.dtype == object else off / self.by
        return centred @ self.vectors / self.root


def fit(listed: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """A model for each length in listed(length, packed). What comes to the driver is a number for each pair of dimensions."""
    totals: dict[int, dict[int, int]] = {}
    for length, place, limb, value in scatter(listed).collect():
        own = totals.setdefault(length, {})
        own[place] = own.get(place, 0) + (value << (PART * limb))
    out = {}
    for length, own in totals.items():
        cross = np.zeros((length, length), object)
        cross[np.triu_indices(length)] = [own[place] for place in range(length + 1, len(own))]
        cross = cross + np.triu(cross, 1).T
        out[length] = Model(own[0], [own[place] for place in range(1, length + 1)], cross, components)
    return out


def identity_errors(listed: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    """How far the covariance of the whitened fit list is from the identity, at most, by length."""
    shared = listed.sparkSession.sparkContext.broadcast(models)  # components x length numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            by_length: dict[tuple[int, bool], list[np.ndarray]] = {}
            for length, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                row = unpack(value.as_py())
                by_length.setdefault((length, row.dtype == object), []).append(row)
            for (length, _), rows in by_length.items():
                model = shared.value[length]
                white = model.whitened(model.deviations(np.array(rows).reshape(len(rows), length)))
                held[length] = held.get(length, 0) + white.T @ white
        for length, total in held.items():
            places = np.arange(total.size)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(total.size, length, np.int32)), pa.array(places.astype(np.int32)), pa.array(total.ravel())], names=["length", "place", "value"])

    sums: dict[int, list] = {}
    for length, place, value in listed.mapInArrow(run, "length int, place int, value double").groupBy("length", "place").agg(F.sum("value")).collect():
        sums.setdefault(length, []).append((place, value / models[length].n))
    out = dict.fromkeys(models, 0.0)  # vectors without components have no covariance
    for length, found in sums.items():
        k = math.isqrt(len(found))
        matrix = np.array([v for _, v in sorted(found)]).reshape(k, k)
        known = ~np.isnan(models[length].root)
        out[length] = float(np.abs(matrix - np.eye(k))[np.ix_(known, known)].max(initial=0))
    return out


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vectors(vec_id, embedding) to a row for each usable vector: vec_id, n, deviation (decimal text of any size),
    whitened, explained (arrays, by falling eigenvalue, components of them at most), identity_error.

    Null vectors and those that hold a null or non-finite component are left out. Vectors of each length have a model and
    an n of their own. Repeated rows each have a row, but count once in the fit; a null vec_id stays null. A direction in
    which all vectors are alike has a null whitened value and takes no part in identity_error (one vector alone has no
    other directions). Vectors without components have empty arrays. An empty table gives an empty result; other
    columns are not looked at. The offset of the contract's x moves every vector alike and changes none of these.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    listed = materialise(fit_list(vectors, scale), "fit-list")
    models = fit(listed, components)
    errors = identity_errors(listed, models)
    shared = vectors.sparkSession.sparkContext.broadcast((models, errors))  # components x length numbers
    fields = "vec_id long, n long, deviation string, whitened array<double>, explained array<double>, identity_error double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, errors = shared.value
        for batch in batches:
            for rows, x in whole_numbers(batch.column(1), scale):
                model = models[x.shape[1]]
                off = model.deviations(x)
                white, k = model.whitened(off), len(model.values)
                flat = pa.array(white.ravel(), mask=np.isnan(white.ravel()))
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, k * len(rows) + 1, k, np.int32) if k else np.zeros(len(rows) + 1, np.int32)), values) for values in (flat, pa.array(np.tile(model.explained, len(rows))))]
                constant = [pa.array(np.full(len(rows), v)) for v in (model.n, errors[x.shape[1]])]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), constant[0], pa.array([str(s) for s in model.squares(off)]), *lists, constant[1]], names=["vec_id", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(run, fields)


def op13_whitening(spark, sf_dir):
    found = whiten(table(spark, sf_dir, "embeddings"))
    each = found.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "one"))
    # A sum of squares beyond 64 bits stops at the greatest long.
    deviation = F.coalesce(F.expr("try_cast(deviation AS LONG)"), F.lit((1 << 63) - 1)).alias("deviation")
    return each.select("vec_id", (F.col("place") + 1).alias("component"), "n", deviation, "one.whitened", "one.explained", "identity_error")


QUERIES = {"op13_whitening": op13_whitening}
