"""Token counts by a tokenizer file."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that are encoded at once hold so many bytes, or are one: an encoding takes some hundred bytes a token.
SLICE_BYTES = 262_144


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    """Opened once for each Python worker and file."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """texts in order, cut where more than most bytes would come together."""
    start = held = 0
    for at, size in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if at > start and held + size > most:
            yield texts.slice(start, at - start)
            start, held = at, 0
        held += size
    if start < len(texts):
        yield texts.slice(start)


def token_count(path: str) -> Callable[[Column | str], Column]:
    """A function from a text to its number of tokens, special ones not added, by the tokenizer file at path, which all
    executors must have. Null texts have none."""

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = _tokenizer(path)
        for texts in batches:
            counts: list[int] = []
            for some in slices(texts):
                counts += [len(e.ids) for e in tokenizer.encode_batch_fast([t or "" for t in some.to_pylist()], add_special_tokens=False)]
            yield pa.array(counts, pa.int64())

    return count
