"""Fingerprints by a randomised edit embedding.

A text is read by a random walk in time: at time t it stands at some character c and puts it out; a random bit of (t, c),
shared by all texts, says whether it goes on to the next character. After an edit two walks meet again soon and go on
alike, so texts at a small edit distance give outputs at a small Hamming distance. The walk jumps from character to
character with a table of waiting times (CLASSES classes of characters; bits repeat after PERIOD steps), two steps of time
a character on average.

A fingerprint keeps SYMBOLS characters of the output, hashed to four bits, for each of BANDS bands. A band's places are
those with its least hashes among all times of the output, so texts of unlike lengths sample the same places wherever both
have them, and a fingerprint is as long for a book as for a line. The likeness of two fingerprints estimates the share of
the longer output that agrees, freed of what four bits agree on by chance.

Near copies are found by bands: fingerprints with an equal band meet, and those at a likeness of at least LEAST link. A pair
at LEAST shares a band in more than 99 of 100 cases (32 chances of 0.8 ** 8).
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ashlar.llm.common import FILE, ROW, located, materialise, table
from ashlar.llm.components import components

CLASSES, PERIOD, BANDS, SYMBOLS, LEAST, IN_MEMORY = 64, 1 << 16, 32, 8, 0.8, 10_000
BUCKET_ROWS, MOST_BUCKETS, HORIZON = 2000, 16_384, 1 << 18
FEW, AT_ONCE = 24, 8_000_000
_DIGITS, _VALUES = bytes.maketrans(bytes(range(16)), b"0123456789abcdef"), bytes.maketrans(b"0123456789abcdef", bytes(range(16)))
_ABSENT, _BUCKET, _LATER = "__lode_absent", "__lode_bucket", "__lode_later"


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A hash of unsigned integers of 64 bits."""
    x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & (1 << 64) - 1)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


@cache
def waits() -> bytes:
    """At class * PERIOD + time, how long the walk stays at a character of the class: 1 to 255."""
    out = []
    for c in range(CLASSES):
        go = mixed(np.arange(PERIOD), 1 + c) >> np.uint64(63) == 1
        ones = np.flatnonzero(go)
        ones = np.append(ones, ones[0] + PERIOD)
        out.append(np.minimum(ones[np.searchsorted(ones, np.arange(PERIOD))] - np.arange(PERIOD) + 1, 255).astype(np.uint8).tobytes())
    return b"".join(out)


class Places:
    """The sampled places of every band for any length of the output."""

    def __init__(self):
        self.end, self.records, self.known = 0, [(np.zeros(0, np.int64), np.zeros(0, np.uint64))] * BANDS, {}

    def _reach(self, end: int) -> None:
        """Notes which places are among a band's SYMBOLS least hashes of those before them and themselves."""
        while self.end < end:
            at = np.arange(self.end, self.end + HORIZON)
            for band, (place, rank) in enumerate(self.records):
                own = mixed(at, 1000 + band)
                # Blocks of doubling size: what isn't among the least of its block's beginning never is.
                keep_place, keep_rank = [place], [rank]
                start = 0
                while start < HORIZON:
                    stop = min(HORIZON, max(64, 2 * (self.end + start)) - self.end) if self.end + start else 64
                    known = np.concatenate(keep_rank)
                    bar = np.partition(known, SYMBOLS - 1)[SYMBOLS - 1] if len(known) >= SYMBOLS else np.uint64((1 << 64) - 1)
                    some = np.flatnonzero(own[start:stop] <= bar) + start
                    keep_place.append(at[some])
                    keep_rank.append(own[some])
                    start = stop
                place, rank = np.concatenate(keep_place), np.concatenate(keep_rank)
                order = np.argsort(rank, kind="stable")
                self.records[band] = place[order], rank[order]
            self.end += HORIZON
        self.turns, self.known = np.unique(np.concatenate([place for place, _ in self.records])), {}
        width = max(len(place) for place, _ in self.records)
        self.table = np.full((BANDS, width), np.iinfo(np.int64).max)
        for band, (place, _) in enumerate(self.records):
            self.table[band, : len(place)] = place

    def of(self, length: int) -> np.ndarray:
        """BANDS rows of SYMBOLS places, by rank; fewer, if the output has fewer times than SYMBOLS."""
        if length > self.end or not self.end:
            self._reach(max(1, length))
        turn = int(np.searchsorted(self.turns, length))  # places change where a new one comes in
        if turn not in self.known:
            inside = self.table < length
            chosen = inside & (np.cumsum(inside, axis=1) <= SYMBOLS)
            self.known[turn] = self.table[chosen].reshape(BANDS, min(SYMBOLS, length))
        return self.known[turn]


@cache
def places() -> Places:
    return Places()


def characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def walks(codes: np.ndarray, lengths: np.ndarray, begin: np.ndarray | None = None) -> np.ndarray:
    """When the walks of several texts leave each of their characters.

    codes are the texts' characters one after another; a walk comes to its first one at its time in begin, or at 0. The
    walks go on side by side, longest texts first; where only a few are left, they are finished one by one.
    """
    table, mask = np.frombuffer(waits(), np.uint8), PERIOD - 1
    rows = (mixed(codes, 7) % np.uint64(CLASSES)).astype(np.int32) * PERIOD
    order = np.argsort(-lengths, kind="stable")
    sizes, place = lengths[order], (np.cumsum(lengths) - lengths)[order]
    at = np.zeros(len(order), np.int64) if begin is None else begin[order].astype(np.int64)
    out = np.zeros(len(codes), np.int64)
    together = int(sizes[FEW]) if len(sizes) > FEW else 0
    left = len(sizes)
    for step in range(together):
        while sizes[left - 1] <= step:
            left -= 1
        here, now = place[:left] + step, at[:left]
        now += table[rows[here] + (now & mask)]
        out[here] = now
    plain = waits()
    for i in range(int((sizes > together).sum())):
        now, one, leave = int(at[i]), rows[place[i] + together : place[i] + sizes[i]].tolist(), []
        for row in one:
            now += plain[row + (now & mask)]
            leave.append(now)
        out[place[i] + together : place[i] + sizes[i]] = leave
    return out


def walk(codes: np.ndarray) -> np.ndarray:
    return walks(codes, np.array([len(codes)]))


class Print:
    """length of the output, and its sampled symbols (BANDS rows)."""

    def __init__(self, codes: np.ndarray, leaves: np.ndarray):
        self.length = int(leaves[-1]) if len(leaves) else 0
        self.places = places().of(self.length)
        at = np.searchsorted(leaves, self.places, "right")
        self.symbols = (mixed(codes[at], 11) & np.uint64(15)).astype(np.uint8) if len(leaves) else np.zeros((BANDS, 0), np.uint8)

    @classmethod
    def parse(cls, value: str) -> Print:
        self = cls.__new__(cls)
        length, _, digits = value.partition(":")
        self.length = int(length, 16)
        self.places = places().of(self.length)
        self.symbols = np.frombuffer(digits.encode().translate(_VALUES), np.uint8).reshape(self.places.shape)
        return self

    def __str__(self) -> str:
        return f"{self.length:x}:" + self.symbols.tobytes().translate(_DIGITS).decode()

    def keys(self) -> list[int]:
        """A key for each band; equal only where places and symbols are."""
        return [xxhash.xxh3_64_intdigest(bytes([band]) + p.tobytes() + s.tobytes()) - (1 << 63) for band, (p, s) in enumerate(zip(self.places, self.symbols))]


def print_of(text: str | None) -> Print:
    codes = characters(text or "")
    return Print(codes, walk(codes))


def likeness(a: Print, b: Print) -> float:
    """From 0 to 1; 1 for equal fingerprints, empty ones too."""
    if a.length > b.length:
        a, b = b, a
    if not b.length:
        return 1.0
    if a.length == b.length:
        same = (a.symbols == b.symbols).sum()
    elif not a.length:
        same = 0
    else:
        same = ((a.places[:, :, None] == b.places[:, None, :]) & (a.symbols[:, :, None] == b.symbols[:, None, :])).sum()
    return max(0.0, (float(same) / b.symbols.size - 1 / 16) / (1 - 1 / 16))


def edited(text: str, after: str) -> str:
    """text with its last half (rounded down) replaced by as much of the beginning of after as there is."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _bounds(rows: DataFrame) -> list[tuple]:
    """The first row of each bucket of rows in order: (absent, doc_id, FILE, ROW); MOST_BUCKETS at most."""
    keys = rows.select(F.col("doc_id").isNull().alias(_ABSENT), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), FILE, ROW)
    keys = materialise(keys, "keys")
    buckets = max(1, min(MOST_BUCKETS, keys.count() // BUCKET_ROWS))
    ranged = keys.repartitionByRange(buckets, _ABSENT, "doc_id", FILE, ROW)
    firsts = ranged.groupBy(F.spark_partition_id()).agg(F.min(F.struct(_ABSENT, "doc_id", FILE, ROW)).alias("first"))
    return sorted(tuple(r["first"]) for r in firsts.collect())


def beside_next(docs: DataFrame) -> DataFrame:
    """A row for each row of docs(doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. The next document is that of the next higher doc_id, after the last one the first.

    Null texts are empty; an empty text's likeness to an empty one is 1, to any other 0. Rows of one doc_id follow each
    other by their place in the input; null doc_ids come last. One row alone is its own next. An empty table gives an
    empty result; other columns are not looked at. Texts cross the network once, compressed, to buckets of consecutive
    rows; the first row of a bucket also goes to the bucket before.
    """
    rows = located(docs)
    shared = docs.sparkSession.sparkContext.broadcast(_bounds(rows))  # MOST_BUCKETS rows at most

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, packer = shared.value, zstandard.ZstdCompressor(1)
        firsts = {first: i for i, first in enumerate(bounds)}
        for batch in batches:
            out = []
            for doc_id, file, row, text in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3)):
                key = (doc_id is None, doc_id or 0, file, row)
                bucket, packed = bisect.bisect_right(bounds, key) - 1, packer.compress((text.as_py() or "").encode("utf-8", "surrogatepass"))
                out.append((bucket, False, *key, packed))
                if firsts.get(key) is not None:
                    out.append(((bucket - 1) % len(bounds), True, *key, packed))
            kinds = (pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, kinds)], names=names)

    names = [_BUCKET, _LATER, _ABSENT, "doc_id", FILE, ROW, "text"]
    texts = rows.select(F.col("doc_id").cast("long").alias("doc_id"), FILE, ROW, "text")
    dealt = texts.mapInArrow(deal, f"{_BUCKET} int, {_LATER} boolean, {_ABSENT} boolean, doc_id long, {FILE} long, {ROW} long, text binary")
    dealt = dealt.repartition(_BUCKET).sortWithinPartitions(*names[:-1])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker, held, chars = zstandard.ZstdDecompressor(), [], 0
        for batch in batches:
            for bucket, absent, doc_id, packed in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), batch.column(6)):
                text = unpacker.decompress(packed.as_py()).decode("utf-8", "surrogatepass")
                held.append((bucket, None if absent else doc_id, text))
                chars += len(text)
                if chars > AT_ONCE:
                    yield _compared(held, fields)
                    held, chars = held[-1:], len(text)
        yield _compared(held, fields)

    fields = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return dealt.mapInArrow(compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _compared(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    """Rows (bucket, doc_id, text) in order to what is said of each but the last of a bucket."""
    codes = [characters(text) for *_, text in rows]
    prints, leaves = _prints(codes)
    pairs = [i for i, (one, two) in enumerate(zip(rows, rows[1:])) if one[0] == two[0]]
    cuts = [len(codes[i]) - len(codes[i]) // 2 for i in pairs]
    tails = [codes[i + 1][: len(codes[i]) // 2] for i in pairs]
    ends, _ = _prints(tails, [(codes[i][:cut], leaves[i][:cut]) for i, cut in zip(pairs, cuts)])
    out = []
    for i, changed in zip(pairs, ends):
        text = rows[i][2]
        digest = hashlib.sha256(edited(text, rows[i + 1][2]).encode("utf-8", "surrogatepass")).hexdigest()
        out.append((rows[i][1], len(text), digest, str(prints[i]), str(changed), likeness(prints[i], changed), likeness(prints[i], prints[i + 1])))
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, kinds)], names=names)


def _prints(codes: list[np.ndarray], before: list[tuple[np.ndarray, np.ndarray]] | None = None) -> tuple[list[Print], list[np.ndarray]]:
    """Fingerprints of texts, and when their walks leave each character. before: (characters, when the walk leaves them)
    that a text goes on from."""
    if not codes:
        return [], []
    begin = None if before is None else np.array([b[1][-1] if len(b[1]) else 0 for b in before])
    lengths = np.array([len(c) for c in codes])
    leaves = np.split(walks(np.concatenate(codes), lengths, begin), np.cumsum(lengths)[:-1])
    if before is None:
        return [Print(c, w) for c, w in zip(codes, leaves)], leaves
    return [Print(np.concatenate([b[0], c]), np.concatenate([b[1], w])) for b, c, w in zip(before, codes, leaves)], leaves


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(FILE, ROW, doc_id, text) to (FILE, ROW, doc_id, fingerprint)."""

    @F.arrow_udf("string")
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out, held, chars = [], [], 0
            for text in texts:
                held.append(characters(text.as_py() or ""))
                chars += len(held[-1])
                if chars > AT_ONCE:
                    out += map(str, _prints(held)[0])
                    held, chars = [], 0
            yield pa.array([*out, *map(str, _prints(held)[0])], pa.string())

    return docs.select(FILE, ROW, F.col("doc_id").cast("long").alias("doc_id"), made("text").alias("fingerprint"))


def spanning(prints: list[tuple[int, str]], least: float) -> set[tuple[int, int]]:
    """Links (low, high) that span the components of (id, fingerprint); each is compared as a frontier once."""
    out, rest = set(), [(i, Print.parse(p)) for i, p in sorted(prints)]
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and rest:
            i, one = frontier.pop()
            hits = [likeness(one, other) >= least for _, other in rest]
            found = [x for x, hit in zip(rest, hits) if hit]
            rest = [x for x, hit in zip(rest, hits) if not hit]
            out |= {(min(i, j), max(i, j)) for j, _ in found}
            frontier += found
    return out


def near_groups(docs: DataFrame, least: float = LEAST, in_memory: int = IN_MEMORY) -> DataFrame:
    """A row for each row of docs(doc_id, text): doc_id, fingerprint, component_id (the smallest doc_id reachable over
    links: fingerprints that share a band and whose likeness is at least least).

    Null texts are empty, and linked with each other; repeated rows are in one group; null doc_ids come last. An empty
    table gives an empty result; other columns are not looked at. Equal fingerprints are one before they meet. A band's
    key with more than in_memory fingerprints is cut into blocks, and every two blocks meet in a task of their own.
    """
    rows = materialise(fingerprints(located(docs)), "prints")
    distinct = rows.groupBy("fingerprint").agg(F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id")).alias("least"))
    distinct = materialise(distinct.select(F.monotonically_increasing_id().alias("id"), "fingerprint", "least"), "distinct-prints")

    @F.arrow_udf("array<long>")
    def keys(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for prints in batches:
            yield pa.array([Print.parse(p.as_py()).keys() for p in prints], pa.list_(pa.int64()))

    keyed = materialise(distinct.select("id", "fingerprint", F.explode(keys("fingerprint")).alias("key")), "bands")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = keyed.join(sizes, "key").withColumn("blocks", F.ceil(F.col("n") / in_memory).cast("int"))
    met = met.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = met.select("id", "fingerprint", "key", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select("id", "fingerprint", "key", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))

    def links(group: pa.Table) -> pa.Table:
        found = spanning(list(zip(group.column("id").to_pylist(), group.column("fingerprint").to_pylist())), least)
        low, high = zip(*found) if found else ((), ())
        return pa.table({"low": pa.array(low, pa.int64()), "high": pa.array(high, pa.int64())})

    roots = components(met.groupBy("key", "one", "two").applyInArrow(links, "low long, high long"))
    grouped = distinct.join(roots, distinct["id"] == roots["node"], "left").select("fingerprint", "least", F.coalesce("root", "id").alias("root"))
    leaders = grouped.groupBy("root").agg(F.min("least").alias("leader"))
    of_print = grouped.join(leaders, "root").select("fingerprint", F.col("leader.doc_id").alias("component_id"))
    return rows.join(of_print, "fingerprint").select("doc_id", "fingerprint", "component_id")


def op11_edits(spark, sf_dir):
    return beside_next(table(spark, sf_dir, "documents"))


QUERIES = {"op11_edits": op11_edits}
