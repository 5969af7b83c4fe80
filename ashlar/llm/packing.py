"""Packing documents into windows, best fit decreasing.

Each task tokenises its documents and packs them in groups of at most GROUP_TOKENS ids: no shuffle, bounded memory, and
a lost task gives the same rows again. An overlong document is first cut into full windows. The rest, longest first, goes
into the open window with the least room that still suffices, which a segment tree over the remaining capacity finds in
log2(window) steps; a document that fits nowhere opens a window. At a group's end a window less than 15/16 full is split,
its ids in order, into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ashlar.llm.common import kept, table

WINDOW, END, GROUP_TOKENS, CACHE_WORDS = 4096, 2, 4_000_000, 300_000
#: New words of letters a-z that are worth a call of their own; fewer are encoded along with other letters.
PLAIN_WORDS = 16
#: Ids in a batch of rows that goes out, 1 MB of them: Python and Spark both hold such a batch more than once.
BATCH_TOKENS = 262_144
#: ASCII marks that BY_PIECES parts from letters before them; not ', which begins pieces of its own, nor what special tokens have.
TAIL = b'.,;:!?"#$%&()*+-/=@[]^_`{}~'
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
#: Normaliser and splitting of a tokenizer whose ids can be put together from pieces; fixed values, part of its file format.
BY_PIECES = {
    "truncation": None,
    "padding": None,
    "post_processor": None,
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
_ARROW = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())])


class Encoder:
    """Ids of whole texts by a tokenizer file, added special tokens left out.

    A tokenizer that ignores case, drops white space and never joins what it parts (BY_PIECES) gives a text the ids of its
    pieces between ASCII white space, one after the other; pieces that were met before come from a cache of bounded size.
    It also parts letters from marks behind them (TAIL): where that can't change a special token's string or how marks
    combine, A-Z are lowered first, and such a piece's ids are put together, so that fewer pieces are new. New pieces of
    letters alone are one token sequence each, whose last id says that a word ends; so they are encoded side by side in one
    text. What normalising and splitting leave as it is, letters a-z between spaces, goes to the model without either. Any
    other tokenizer gets each text whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, WhitespaceSplit

        self.tokenizer, self.cache = Tokenizer.from_file(path), {}
        made = json.loads(self.tokenizer.to_str())
        specials = [t for t in made["added_tokens"] if not t["content"].startswith("<|") or t["single_word"] or t["lstrip"] or t["rstrip"]]
        self.by_pieces = not specials and {key: made[key] for key in BY_PIECES} == BY_PIECES
        self.marks = re.compile(rb"\xcc|\xcd[\x80-\xaf]").search
        vocabulary, suffix = made["model"].get("vocab", {}), made["model"].get("end_of_word_suffix")
        #: by id, whether a word ends there; None where that isn't told, or a word could lose its end
        self.ends = None
        if self.by_pieces and suffix and all(c in vocabulary and c + suffix in vocabulary for c in ByteLevel.alphabet()):
            self.ends = np.zeros(1 + max(vocabulary.values()), bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
            self.plain = Tokenizer(self.tokenizer.model)
            self.plain.pre_tokenizer = WhitespaceSplit()

    def __call__(self, text: bytes) -> np.ndarray:
        """text is UTF-8; bytes part at ASCII white space only."""
        if not self.by_pieces:
            return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.uint32)
        if b"<|" not in text and (text.isascii() or not self.marks(text)):
            text = text.lower()
        pieces, cache = text.split(), self.cache
        new = set(pieces).difference(cache)
        if new:
            if len(cache) + 3 * len(new) > CACHE_WORDS:
                cache.clear()
                new = set(pieces)
            ended, plain, letters, others = [], set(), set(), []
            for word in new:
                head = word.rstrip(TAIL)
                if head.isalpha() and head.islower():
                    plain.add(head)
                elif _letters(head):
                    letters.add(head)
                else:
                    others.append(word)
                    continue
                if len(head) < len(word):
                    ended.append((word, head, word[len(head) :]))
            self._learn(list(plain.difference(cache)), list(letters.difference(cache)), list({tail for *_, tail in ended}.union(others).difference(cache)))
            for word, head, tail in ended:
                cache[word] = cache[head] + cache[tail]
        return np.frombuffer(b"".join(map(cache.__getitem__, pieces)), np.uint32)

    def _learn(self, plain: list[bytes], letters: list[bytes], others: list[bytes]) -> None:
        """Ids of words of letters a-z, of other letters and of other pieces into the cache."""
        if self.ends is None or len(plain) < PLAIN_WORDS:
            plain, letters = [], plain + letters
        if self.ends is None:
            others = letters + others
        else:
            others = self._side_by_side(self.plain, plain) + self._side_by_side(self.tokenizer, letters) + others
        found = self.tokenizer.encode_batch_fast([w.decode() for w in others], add_special_tokens=False) if others else ()
        for word, ids in zip(others, found):
            self.cache[word] = array("I", ids.ids).tobytes()

    def _side_by_side(self, tokenizer, words: list[bytes]) -> list[bytes]:
        """Ids of words into the cache, from one text of them all; returns the words if their ends aren't told."""
        if not words:
            return []
        ids = np.array(tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, np.uint32)
        ends = 4 * (np.flatnonzero(self.ends[ids]) + 1)
        if len(ends) != len(words):  # each word has one end at least
            return words
        joined, begin = ids.tobytes(), 0
        for word, end in zip(words, ends.tolist()):
            self.cache[word] = joined[begin:end]
            begin = end
        return []


def _letters(word: bytes) -> bool:
    """Whether a piece is letters, and stays so when it is normalised."""
    return word.isalpha() or not word.isascii() and unicodedata.normalize("NFC", word.decode()).lower().isalpha()


def encoder(path: str) -> Encoder:
    """One for each Python worker, which runs many tasks."""
    return kept(f"encoder of {path}", lambda: Encoder(path))


class Room:
    """Open windows by remaining capacity; a segment tree finds the smallest capacity of at least n that some window has."""

    def __init__(self, window: int):
        self.half = 1 << window.bit_length()
        self.tree, self.open = bytearray(2 * self.half), [[] for _ in range(window + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        if len(self.open[capacity]) == 1:
            node = self.half + capacity
            while node and not self.tree[node]:
                self.tree[node] = 1
                node >>= 1

    def take(self, n: int) -> tuple[int, int] | None:
        """The tightest window with room for n, taken out: (capacity, window)."""
        node, tree = self.half + n, self.tree
        if not tree[node]:
            while node > 1 and (node & 1 or not tree[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.half:
                node = 2 * node if tree[2 * node] else 2 * node + 1
        capacity = node - self.half
        window = self.open[capacity].pop()
        if not self.open[capacity]:
            tree[node] = 0
            node >>= 1
            while node and not (tree[2 * node] or tree[2 * node + 1]):
                tree[node] = 0
                node >>= 1
        return capacity, window


def best_fit(lengths: list[int], window: int = WINDOW) -> list[list[int]]:
    """Places of lengths, each at most window, by window; longest first, equal ones in order."""
    room, windows = Room(window), []
    for place in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = room.take(lengths[place])
        if found is None:
            found = (window, len(windows))
            windows.append([])
        windows[found[1]].append(place)
        if left := found[0] - lengths[place]:
            room.add(left, found[1])
    return windows


def pack_group(docs: list[tuple[int | None, np.ndarray]], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of (place in docs, start, length), from ids that each belong to one document."""
    sequences, rest = [], []
    for place, (_, ids) in enumerate(docs):
        full = len(ids) // window * window
        sequences += [[(place, start, window)] for start in range(0, full, window)]
        if len(ids) > full:
            rest.append((place, full, len(ids) - full))
    for found in best_fit([n for *_, n in rest], window):
        pieces = [rest[i] for i in found]
        total = sum(n for *_, n in pieces)
        sequences += [pieces] if total > window * 15 // 16 or not total & (total - 1) else _powers(pieces, total)
    return sequences


def _powers(pieces: list[tuple[int, int, int]], total: int) -> list[list[tuple[int, int, int]]]:
    """The pieces cut into sequences whose lengths are the powers of two that make up total, largest first."""
    out, queue = [], pieces[::-1]
    for bit in range(total.bit_length() - 1, -1, -1):
        need, own = total & (1 << bit), []
        while need:
            place, start, n = queue.pop()
            own.append((place, start, min(n, need)))
            if n > need:
                queue.append((place, start + need, n - need))
            need -= min(n, need)
        out += [own] if own else []
    return out


def batches_of(docs: list[tuple[int | None, np.ndarray]], sequences: list[list[tuple[int, int, int]]], serial: int) -> Iterator[pa.RecordBatch]:
    """The rows of a group's sequences, numbered from serial on: whole sequences, some BATCH_TOKENS ids at a time."""
    rows, tokens = [], 0
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
    for number, pieces in enumerate(sequences, serial):
        offset = 0
        for place, start, n in pieces:
            doc_id, ids = docs[place]
            rows.append((doc_id, start, n, len(ids), number, offset, ids[start : start + n].tobytes()))
            offset += n
        tokens += offset
        if tokens >= BATCH_TOKENS:
            yield batch()
            rows, tokens = [], 0
    if rows:
        yield batch()


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """A row for each piece of docs(doc_id, text): doc_id, start, length, doc_tokens, sequence_id, offset, ids (binary,
    little-endian unsigned 32-bit). A document's ids are those of its whole text, then end; each lies in one piece.

    A null text is empty and gives a piece of one id. Rows that repeat are packed one by one, a null doc_id stays null.
    A very long text is held by its task, as its row is. An empty table gives no pieces. Other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, held, tokens = encoder(tokenizer), [], 0
        serial = TaskContext.get().partitionId() << 36

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or b""), np.uint32(end))
                held.append((doc_id, ids))
                tokens += len(ids)
                if tokens >= group_tokens:
                    sequences = pack_group(held, window)
                    yield from batches_of(held, sequences, serial)
                    serial += len(sequences)
                    held, tokens = [], 0
        yield from batches_of(held, pack_group(held, window), serial)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("text")).mapInArrow(run, SCHEMA)



def op5_packing(spark, sf_dir):
    import public_tokenizers

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op5_packing": op5_packing}
