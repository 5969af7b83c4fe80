"""Stupid-backoff scores, computed relationally.

Texts are tokenised once (ids of a public tokenizer) and written with the number of a block: documents of one task up to
BLOCK_TOKENS ids. Each block's n-grams are exploded to (block, gram, n), one row for each distinct gram of the block, so
that a frequent gram has one row for each block at most. Count tables come from summing them by gram, partitioned by its
hash; joined back they give each block the corpus counts of its grams, and scores add up for each document. Nothing is
sent to the driver but the number of tokens.

A document is scored by the counts of all other documents: its own are taken away first. A gram that no other document
has falls back to the gram without its first id, times BACKOFF; an id that no other document has counts for half of one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ashlar.llm.common import FILE, ROW, located, materialise, table
from ashlar.llm.packing import encoder

ORDER, BACKOFF, BLOCK_TOKENS, BITS = 2, 0.4, 1_500_000, 21


def grams(ids: np.ndarray, order: int) -> np.ndarray:
    """Codes of the n-grams of one order, n ids of BITS bits each, all plus one."""
    ids = ids.astype(np.int64) + 1
    code = ids[: max(0, len(ids) - order + 1)]
    for k in range(1, order):
        code = code << BITS | ids[k : len(ids) - order + 1 + k]
    return code


def packed(ids: np.ndarray) -> bytes:
    """Unsigned ids of 16 bits, or of 32 where one needs them, behind a byte that says which."""
    small = ids.max(initial=0) < 1 << 16
    return (b"\2" if small else b"\4") + ids.astype(np.uint16 if small else np.uint32).tobytes()


def unpacked(value: bytes) -> np.ndarray:
    return np.frombuffer(value, np.uint16 if value[:1] == b"\2" else np.uint32, offset=1)


def tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """docs(FILE, ROW, doc_id, text) to (FILE, ROW, doc_id, block, ids); ids are packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, block, held = encoder(tokenizer), TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            ids, blocks = [], []
            for text in batch.column(3):
                found = encode(text.as_py() or b"")
                if held and held + len(found) > BLOCK_TOKENS:
                    block, held = block + 1, 0
                held += len(found)
                blocks.append(block)
                ids.append(packed(found))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(blocks, pa.int64()), pa.array(ids, pa.binary())], names=[FILE, ROW, "doc_id", "block", "ids"])

    texts = docs.select(FILE, ROW, F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("text"))
    return texts.mapInArrow(run, f"{FILE} long, {ROW} long, doc_id long, block long, ids binary")


def exploded(tokenised: DataFrame, order: int = ORDER) -> DataFrame:
    """(block, gram, n): each block's n-grams of all orders up to order; a block's rows may come in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for block, many in held.items():
                gram, n = np.unique(np.concatenate([grams(ids, k) for ids in many for k in range(1, order + 1)]), return_counts=True)
                for at in range(0, len(gram), 50_000):
                    part = gram[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block)), pa.array(part), pa.array(n[at : at + 50_000])], names=["block", "gram", "n"])
            held.clear()

        for batch in batches:
            for block, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                if block not in held:
                    yield from flush()
                held.setdefault(block, []).append(unpacked(ids.as_py()))
        yield from flush()

    return tokenised.select("block", "ids").mapInArrow(run, "block long, gram long, n long")


def lm_scores(docs: DataFrame, tokenizer: str, order: int = ORDER) -> DataFrame:
    """A row for each row of docs(doc_id, text): doc_id, n_tokens, logprob (natural, over all tokens), mean_logprob.

    Null and empty texts have no tokens, logprob 0 and a null mean. Repeated rows are scored one by one, each by the
    others; a null doc_id stays null; a very long text is held by its task, as its row is. An empty table gives an empty
    result; other columns are not looked at. order is 1, 2 or 3: more ids don't fit a code of 63 bits.
    """
    if order not in (1, 2, 3):
        raise ValueError(f"order is 1, 2 or 3, not {order}")
    tokenised = materialise(tokens(located(docs), tokenizer), "tokens")
    parts = materialise(exploded(tokenised, order), "grams")
    counts = materialise(parts.groupBy("gram").agg(F.sum("n").alias("count")), "counts")
    total = counts.where(F.col("gram") < 1 << BITS).agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    wanted = parts.select("block", "gram").join(counts, "gram")

    def score(ids: np.ndarray, known: np.ndarray, count: np.ndarray) -> float:
        if not len(ids):
            return 0.0
        rest = max(1, total - len(ids))
        seen = {}
        for k in range(1, order + 1):
            code = grams(ids, k)
            own, place, times = np.unique(code, return_inverse=True, return_counts=True)
            seen[k] = (count[np.searchsorted(known, own)] - times)[place] if len(own) else np.zeros(0)
        value = np.maximum(seen[1], 0.5) / rest
        for k in range(2, order + 1):
            longer, context = seen[k], seen[k - 1][: len(seen[k])]
            tail = value[k - 1 :] * BACKOFF
            value = np.concatenate([value[: k - 1], np.where(longer > 0, longer / np.maximum(context, 1), tail)])
        return math.fsum(np.log(value))

    def run(_, own: pa.Table, answers: pa.Table) -> pa.Table:
        known, count = answers.column("gram").to_numpy(), answers.column("count").to_numpy()
        known, first = np.unique(known, return_index=True)
        count = count[first]
        ids = [unpacked(x.as_py()) for x in own.column("ids")]
        sums = [score(x, known, count) for x in ids]
        sizes = [len(x) for x in ids]
        return pa.table({"doc_id": own.column("doc_id"), "n_tokens": pa.array(sizes, pa.int64()), "logprob": pa.array(sums, pa.float64()), "mean_logprob": pa.array([s / n if n else None for s, n in zip(sums, sizes)], pa.float64())})

    return tokenised.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(run, "doc_id long, n_tokens long, logprob double, mean_logprob double")


def op9_lmscore(spark, sf_dir):
    import public_tokenizers

    return lm_scores(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op9_lmscore": op9_lmscore}
