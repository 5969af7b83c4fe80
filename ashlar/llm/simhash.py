"""SimHash near-deduplication with Golay-code keys.

A fingerprint's bit says whether most shingles' hashes have it. Two fingerprints that differ in four bits or fewer must
meet at a key: of their three segments (22, 21, 21 bits) either one is equal, and then another differs in two bits or
fewer, or two differ in one bit each. So a fingerprint's keys are
- a segment as it is with an index nearby another segment (indices nearby meet within two bits), for each ordered pair;
- for each pair of segments, an index nearby the one with the other's own index, and the reverse (within one bit each,
  the first fingerprint's own index of one segment and the second's of the other meet).
Equal fingerprints are one before keys are made. Within a key, fingerprints are compared exactly and only links that
span its components are kept, never all pairs. A key with more than IN_MEMORY fingerprints isn't gathered, and one with
more than a small share of all rows (counted in a sample) isn't even dealt to a task: each of its fingerprints meets those
within four bits at some word within two bits of both, where all that meet are linked. That is exact, too, but takes 2081
rows a fingerprint instead of 61.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ashlar.llm.common import FILE, ROW, located, materialise, table, without_rows
from ashlar.llm.components import components
from ashlar.llm.golay import decode, nearby

SHINGLE, SEED, BITS_APART, IN_MEMORY, SAMPLED, HOT_KEYS = 4, 42, 4, 50_000, 64, 20_000
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text in UTF-8: A-Z lowered, words parted by ASCII white space, XXH64 of word shingles."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    last = min(shingle, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[: len(words) - last].tolist(), ends[last:].tolist())
    hashes = np.array([digest(joined[a:b], SEED) for a, b in pairs], np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255):  # sums of bytes don't overflow
        bits = np.unpackbits(hashes[at : at + 255].view(np.uint8), bitorder="little").reshape(-1, 64)
        votes += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs(FILE, ROW, doc_id, text) to (FILE, ROW, doc_id, fp); fp is signed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(text.as_py(), shingle) for text in batch.column(3)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found)], names=[FILE, ROW, "doc_id", "fp"])

    texts = docs.select(FILE, ROW, F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("text"))
    return texts.mapInArrow(run, f"{FILE} long, {ROW} long, doc_id long, fp long")


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each fingerprint: (places in fps, keys)."""
    parts = [(fps.view(np.uint64) >> np.uint64(at)).astype(np.int64) & ((1 << width) - 1) for at, width in SEGMENTS]
    near = [nearby(part, width) for part, (_, width) in zip(parts, SEGMENTS)]
    own = [decode(part).astype(np.int64) for part in parts]
    places, keys = [], []
    for i in range(3):
        for j in range(3):
            if i != j:
                place, index = near[j]
                places.append(place)
                keys.append((3 * i + j) << 40 | parts[i][place] << 12 | index)
    for i, j in combinations(range(3), 2):
        place, index = near[i]
        places.append(place)
        keys.append((16 + 3 * i + j) << 40 | index.astype(np.int64) << 12 | own[j][place])
        place, index = near[j]
        other = index != own[j][place]  # the pair of own indices is there already
        places.append(place[other])
        keys.append((16 + 3 * i + j) << 40 | own[i][place[other]] << 12 | index[other])
    return np.concatenate(places), np.concatenate(keys)


def _within(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= BITS_APART


def spanning(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links (least, other) that span the components of distinct, sorted fingerprints; each is compared as a frontier once."""
    out, rest = [], fps
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        frontier = np.array([root])
        while len(frontier) and len(rest):
            take = max(1, 4_000_000 // len(rest))
            hit = _within(frontier[:take, None], rest[None, :]).any(axis=0)
            found, rest, frontier = rest[hit], rest[~hit], frontier[take:]
            out += [(int(root), int(x)) for x in found]
            frontier = np.concatenate([frontier, found])
    return out


def _key_links(most: int):
    """Rows sorted by key to links; those of a key with more than most fingerprints come back as (fp, null)."""

    def links(keys: np.ndarray, fps: np.ndarray) -> list[tuple[int, int]]:
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        two = starts[sizes == 2]
        two = two[_within(fps[two], fps[two + 1])]
        out = list(zip(fps[two].tolist(), fps[two + 1].tolist()))
        for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            out += spanning(fps[start : start + size])
        return out

    def batch_of(pairs) -> pa.RecordBatch:
        low, high = zip(*pairs) if pairs else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, hot = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, batch.column(1).to_numpy()])
            if not len(keys):
                continue
            if hot is not None:
                n = int(np.searchsorted(keys, hot, "right"))
                yield batch_of([(int(x), None) for x in fps[:n]])
                keys, fps = keys[n:], fps[n:]
                if not len(keys):
                    continue
                hot = None
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield batch_of(set(links(keys[:cut], fps[:cut])))
                keys, fps = keys[cut:], fps[cut:]
            if len(keys) > most:
                hot = int(keys[0])
                yield batch_of([(int(x), None) for x in fps])
                keys, fps = keys[:0], fps[:0]
        if len(keys):
            yield batch_of(set(links(keys, fps)))

    return run


def _masks() -> np.ndarray:
    """All words of at most two bits."""
    units = [1 << b for b in range(64)]
    return np.array([0, *units, *(a | b for a, b in combinations(units, 2))], np.uint64)


def _meeting_links(fps: DataFrame) -> DataFrame:
    """Exact links of fps(fp) in rows that grow with their number: all that are within two bits of a word are linked."""

    def run(batches):
        masks = _masks()
        for batch in batches:
            own = batch.column(0).to_numpy()
            for at in range(0, len(own), 64):
                some = own[at : at + 64]
                words = (some.view(np.uint64)[:, None] ^ masks).view(np.int64).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(np.repeat(some, len(masks)))], names=["word", "fp"])

    words = fps.mapInArrow(run, "word long, fp long")
    least = words.groupBy("word").agg(F.min("fp").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return words.join(least, "word").where("fp > low").select("low", F.col("fp").alias("high")).distinct()


def fingerprint_links(fps: DataFrame, in_memory: int = IN_MEMORY) -> DataFrame:
    """Links (low, high) that span the components of distinct fps(fp)."""

    def run(batches):
        for batch in batches:
            own = batch.column(0).to_numpy()
            for at in range(0, len(own), 2000):
                place, keys = keys_of(own[at : at + 2000])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(own[at : at + 2000][place])], names=["key", "fp"])

    keys = lambda some: some.mapInArrow(run, "key long, fp long")
    # Keys with more than their share of the rows, by a sample, aren't dealt to one task each; HOT_KEYS of them or so at most.
    bar = max(in_memory / SAMPLED, fps.count() / HOT_KEYS)
    hot = materialise(keys(fps.where(F.pmod(F.xxhash64("fp"), F.lit(SAMPLED)) == 0)).groupBy("key").count().where(F.col("count") > bar).select("key"), "hot")
    keyed, crowded = keys(fps), fps.limit(0)
    if not hot.isEmpty():
        crowded = keyed.join(F.broadcast(hot), "key", "left_semi").select("fp")
        keyed = keyed.join(F.broadcast(hot), "key", "left_anti")
    found = materialise(keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_key_links(in_memory), "low long, high long"), "near")
    links, crowded = found.where("high IS NOT NULL"), crowded.unionByName(found.where("high IS NULL").select(F.col("low").alias("fp")))
    return links if crowded.isEmpty() else links.unionByName(_meeting_links(crowded.distinct()))


def near_groups(docs: DataFrame, shingle: int = SHINGLE, in_memory: int = IN_MEMORY) -> DataFrame:
    """A row for each row of docs(doc_id, text): its key, doc_id, fp (signed), component_id (the smallest doc_id reachable
    over links), first (true for one row of each group, of those with the smallest doc_id).

    Texts without words, null ones too, have fingerprint zero and are linked as any others; texts of fewer words than a
    shingle have one hash. Repeated rows are in one group; null doc_ids come last. An empty table gives an empty result;
    other columns are not looked at.
    """
    rows = materialise(fingerprints(located(docs), shingle), "fingerprints")
    order = lambda *more: F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", FILE, ROW, *more)
    distinct = materialise(rows.groupBy("fp").agg(F.min(order()).alias("least")), "distinct")
    roots = components(fingerprint_links(distinct.select("fp"), in_memory))
    grouped = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    leaders = grouped.groupBy("root").agg(F.min("least").alias("leader"))
    of_fp = grouped.join(leaders, "root").select("fp", "leader")
    found = rows.join(of_fp, "fp")
    first = (F.col("leader")[FILE] == F.col(FILE)) & (F.col("leader")[ROW] == F.col(ROW))
    return found.select(FILE, ROW, "doc_id", "fp", F.col("leader.doc_id").alias("component_id"), first.alias("first"))


def near_dedup(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs with one document of each group of near copies, that with the smallest doc_id; the columns stay as they are.

    Null texts and those without words are one group with any others near fingerprint zero; repeated rows are in one
    group and leave one; null doc_ids come last. An empty table gives an empty one.
    """
    rows = located(docs)
    gone = near_groups(rows, shingle).where("NOT first").select(FILE, ROW)
    return without_rows(rows, gone).select(*docs.columns)


def op7_simhash(spark, sf_dir):
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op7_simhash": op7_simhash}
