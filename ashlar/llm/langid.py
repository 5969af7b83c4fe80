"""Language identification by rank-order profiles.

A text's words are runs of letters, lowered and padded; its grams of one to three characters are ranked by count, equal
ones in code-point order. A language's profile ranks the grams of all its learning texts. The out-of-place distance of a
text to a profile adds up, over the text's MOST first grams, how far the ranks are apart, MOST for a gram that the
profile lacks. The least distance wins, equal ones by the language's name.

Grams are numbers: three code points of 21 bits, each plus one, 1 for padding and 0 for none, so that a text's grams are
counted by sorting an array.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ashlar.llm.common import table

MOST, CHUNK, FLUSH = 400, 1_000_000, 2_000_000
BITS, PAD = 21, 1


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Of each code point the number that stands for it, if it's a letter, else 0."""
    return np.array([i + 1 if chr(i).isalpha() else 0 for i in range(0x110000)], np.int64)


def counted(codes: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and how often each occurs, or the sums of n."""
    if n is not None:
        order = np.argsort(codes, kind="stable")
        codes, n = codes[order], n[order]
    else:
        codes = np.sort(codes)
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[starts], np.diff(np.append(starts, len(codes))) if n is None else np.add.reduceat(n, starts) if len(starts) else n


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A text's grams in order with their counts."""
    found = _letters()[np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)]
    found = np.concatenate([[0], found, [0]])
    keep = np.ones(len(found), bool)
    keep[1:] = (found[1:] > 0) | (found[:-1] > 0)  # one pad between words
    found = found[keep]
    found[found == 0] = PAD
    if len(found) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    parts = []
    for at in range(0, len(found), CHUNK):
        own = found[at : at + CHUNK + 2]
        first = own << 2 * BITS
        one = first[:CHUNK][own[:CHUNK] != PAD]
        two = (first[:-1] | own[1:] << BITS)[:CHUNK]
        three = (first[:-2] | own[1:-1] << BITS | own[2:])[own[1:-1] != PAD][:CHUNK]
        parts.append(counted(np.concatenate([one, two, three])))
    return parts[0] if len(parts) == 1 else counted(*map(np.concatenate, zip(*parts)))


def counts_by_language(docs: DataFrame) -> DataFrame:
    """docs(lang, text) to (lang, gram, n) over all of them; each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def merge() -> int:
            for lang, parts in held.items():
                held[lang] = [counted(*map(np.concatenate, zip(*parts)))]
            return sum(len(parts[0][0]) for parts in held.values())

        def rows() -> Iterator[pa.RecordBatch]:
            merge()
            for lang, ((gram, n),) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = gram_counts(text.as_py())
                held.setdefault(lang, []).append(found)
                size += len(found[0])
                if size > FLUSH:
                    size = merge()
                    if size > FLUSH // 2:
                        yield from rows()
                        size = 0
        yield from rows()

    return docs.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, most: int = MOST) -> dict[str, list[int]]:
    """Profiles, grams by rank, from docs(doc_id, lang, text): all rows with a text and a language that are not held out
    (CRC-32 of the identifier divisible by 5, or no identifier). At most most grams for each language come to the driver."""
    teach = docs.where("lang IS NOT NULL AND text IS NOT NULL AND crc32(CAST(doc_id AS STRING)) % 5 <> 0")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    rows = counts_by_language(teach).withColumn("rank", rank).where(F.col("rank") <= most).select("lang", "rank", "gram").collect()
    profiles: dict[str, list[int]] = {}
    for lang, _, gram in sorted(rows):
        profiles.setdefault(lang, []).append(gram)
    return profiles


class Identifier:
    """Distances to all profiles at once: each known gram has a row of ranks, 0 where a profile lacks it."""

    def __init__(self, profiles: dict[str, list[int]], most: int = MOST):
        self.langs, self.most = sorted(profiles), most
        self.known = np.array(sorted({gram for profile in profiles.values() for gram in profile}), np.int64)
        self.ranks = np.zeros((len(self.known) + 1, len(self.langs)), np.int64)  # the last row is for others
        for i, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.known, profiles[lang]), i] = np.arange(1, len(profiles[lang]) + 1)

    def __call__(self, text: str | None) -> tuple[str, float]:
        grams, n = gram_counts(text)
        if not len(grams) or not self.langs:
            return "und", 0.0
        if len(grams) > self.most:
            least = np.partition(n, len(n) - self.most)[len(n) - self.most]
            grams, n = grams[n >= least], n[n >= least]
        top = grams[np.argsort(-n, kind="stable")][: self.most]
        place = np.searchsorted(self.known, top)
        place[(place == len(self.known)) | (self.known[np.minimum(place, len(self.known) - 1)] != top)] = len(self.known)
        ranks = self.ranks[place]
        apart = np.where(ranks > 0, np.minimum(np.abs(ranks - np.arange(1, len(top) + 1)[:, None]), self.most), self.most).sum(axis=0)
        best = int(np.argmin(apart))
        return self.langs[best], float(1 - apart[best] / (self.most * len(top)))


def identify(docs: DataFrame, profiles: dict[str, list[int]], most: int = MOST) -> DataFrame:
    """docs(doc_id, text) to doc_id, held_out, lang_pred, score (1 where all ranks agree, 0 where no gram is known).

    Texts that are null or hold no letter are und, with score 0; so is everything if nothing was learned. Repeated rows
    are told one by one; an empty table gives an empty result; other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # most grams for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tell = Identifier(shared.value, most)
        for batch in batches:
            lang, score = zip(*[tell(text.as_py()) for text in batch.column(1)]) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return told.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))


QUERIES = {"op10_langid": op10_langid}
