"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Learning looks at a bounded sample of labelled documents (EXAMPLES, those with the least hashes); executors count its
forms and make its vectors. The terms
are all words, runs of letters, lowered, that at least LEAST_DF examples and at most a share of MOST_SHARE have; more
frequent ones are the languages' stop words. An example's vector weighs them by (1 + log tf) * idf, times QUIET for terms
that don't go with the label, and is normalised. Terms that do, in FEWEST examples or more, always count and weigh fully:
either chi-square is at least CHI, or as many toxic ones come by chance with a probability
of at most CHANCE (chi-square can't exceed the number of examples and is small for rare words). Beginnings of words are
terms only there; they catch a stem in all its forms. QUIET is 1 for a plain TF-IDF; README has what that loses.

The index keeps postings by term, and for blocks of BLOCK examples the largest weight of each term in the block. A
document's bound for every block is a sum over its terms. The FIRST_BLOCKS blocks of the greatest bounds are searched
exactly, then all others whose bound reaches the NEIGHBOURS-th best cosine so far, so the neighbours are exact. Neighbours vote with weight
cosine ** POWER beside the prior, which counts as PRIOR votes; the votes are calibrated by a logistic curve fitted to
CALIBRATED of the examples, evenly spread, each scored without itself. The index is bounded by the sample, EXAMPLES and CHARS, so that it may be sent to
every task.
"""

from __future__ import annotations

import math
import pickle
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ashlar.llm.common import FILE, ROW, kept, located, sample, table

EXAMPLES, CHARS, CALIBRATED, LEAST_DF, MOST_SHARE, FEWEST, CHI, BLOCK, NEIGHBOURS, PRIOR = 8000, 64_000_000, 3000, 2, 0.1, 4, 40.0, 256, 15, 0.25
BEGINNINGS, QUIET, POWER, CACHE_WORDS, FIRST_BLOCKS = (3, 4, 5, 6, 7), 0.05, 4, 120_000, 2
CHANCE, TALLIED = 3e-4, 20
_WORDS = re.compile(r"[^\W\d_]+").findall


def words(text: str | None) -> list[str]:
    return _WORDS((text or "").lower())


def forms(word: str) -> list[str]:
    """The word, and its beginnings, marked by a star."""
    return [word, *(f"{word[:k]}*" for k in BEGINNINGS if len(word) >= k)]


def by_chance(hits: int, df: int, positive: int, n: int) -> float:
    """The probability that of df examples out of n, positive of them labelled, hits or more are labelled (hypergeometric)."""
    ways = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    total = 0.0
    for x in range(max(hits, df - (n - positive)), min(df, positive) + 1):
        total += math.exp(ways(positive, x) + ways(n - positive, df - x) - ways(n, df))
        if total > CHANCE:
            break
    return total


def spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers from each start up to its end, one after the other."""
    sizes = ends - starts
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


class Index:
    """Postings of examples by term; a cell is a term's run of postings in one block, and knows its largest weight."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, ids: np.ndarray, n_terms: int):
        loudest = [int(terms[np.argmax(weights)]) if len(terms) else -1 for terms, weights in vectors]
        order = sorted(range(len(vectors)), key=lambda i: (loudest[i], i))  # alike examples share a block
        self.labels, self.ids = labels[order].astype(float), ids[order]
        self.n_blocks = max(1, -(-len(order) // BLOCK))
        sizes = [len(vectors[i][0]) for i in order]
        term = np.concatenate([vectors[i][0] for i in order]).astype(np.int32) if order else np.zeros(0, np.int32)
        by_term = np.argsort(term, kind="stable")  # so places stay in order
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=n_terms))])
        del term
        self.place = np.repeat(np.arange(len(order), dtype=np.int32), sizes)[by_term]
        weight = np.concatenate([vectors[i][1] for i in order]).astype(np.float32) if order else np.zeros(0, np.float32)
        self.weight = weight[by_term]
        del weight, by_term
        self._cells()

    def _cells(self) -> None:
        """Of each term and block the largest weight, and where in the term's run the block's postings begin and end."""
        n_terms = len(self.starts) - 1
        cell = np.repeat(np.arange(n_terms, dtype=np.int64) * self.n_blocks, np.diff(self.starts))
        cell += self.place // BLOCK
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
        own = cell[first]
        del cell
        sizes = np.zeros(n_terms * self.n_blocks, np.uint16 if len(self.ids) < 1 << 16 else np.int32)
        sizes[own] = np.diff(np.append(first, len(self.place)))
        self.cell_ends = np.zeros((n_terms, self.n_blocks + 1), sizes.dtype)
        np.cumsum(sizes.reshape(n_terms, self.n_blocks), axis=1, out=self.cell_ends[:, 1:])
        self.cell_most = np.zeros((n_terms, self.n_blocks), np.float32)
        if len(first):
            self.cell_most.ravel()[own] = np.maximum.reduceat(self.weight, first)

    def __getstate__(self) -> dict:
        """Postings travel; cells follow from them."""
        return {k: v for k, v in self.__dict__.items() if not k.startswith("cell")} | {"starts": self.starts.astype(np.int32)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = state | {"starts": state["starts"].astype(np.int64)}
        self._cells()

    @property
    def blocks(self) -> list[dict[int, tuple[np.ndarray, np.ndarray]]]:
        """Of each block a map from term to (places in the block, weights)."""
        out: list[dict] = [{} for _ in range(self.n_blocks)]
        for term, block in np.argwhere(np.diff(self.cell_ends.astype(np.int64), axis=1) > 0).tolist():
            own = slice(*(self.starts[term] + self.cell_ends[term, block : block + 2].astype(np.int64)).tolist())
            out[block][term] = self.place[own] - block * BLOCK, self.weight[own]
        return out

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(places, cosines) of the k examples with the largest cosines above zero; equal ones by place. Exact."""
        bounds = np.einsum("i,ij->j", weights, self.cell_most[terms])  # not BLAS, whose threads cost more than they save here
        starts, within = self.starts[terms], self.cell_ends[terms]
        cosines, worst = np.zeros(len(self.ids)), 0.0
        best_first = np.argsort(-bounds, kind="stable")
        for some in (best_first[:FIRST_BLOCKS], best_first[FIRST_BLOCKS:]):
            wanted = np.zeros(self.n_blocks, bool)
            wanted[some] = (bounds[some] > 0) & (bounds[some] >= worst - 1e-6)
            if 2 * wanted.sum() > self.n_blocks:  # whole postings lists are quicker to add than most of their runs
                ends = self.starts[terms + 1]
                found = spans(starts, ends)
                cosines = np.bincount(self.place[found], np.repeat(weights, ends - starts) * self.weight[found], len(cosines))
            elif wanted.any():
                blocks = np.flatnonzero(wanted)
                begin, end = ((starts[:, None] + within[:, at]).ravel() for at in (blocks, blocks + 1))
                found = spans(begin, end)
                cosines += np.bincount(self.place[found], np.repeat(np.repeat(weights, len(blocks)), end - begin) * self.weight[found], len(cosines))
            if without is not None and len(cosines):
                cosines[without] = 0
            some = cosines[cosines > 0]
            worst = np.partition(some, len(some) - k)[len(some) - k] if len(some) >= k else 0.0
        hit = np.flatnonzero((cosines > 0) & (cosines >= worst - 2e-6))
        best = hit[np.lexsort((hit, -np.round(cosines[hit], 6)))[:k]]
        return best, cosines[best]


class Known(dict):
    """Of a word that was looked up its term, -1 for none, or beyond all terms the place of its several terms.

    begun has the lengths of the beginnings among terms, by their first letters."""

    def __init__(self, terms: dict[str, int], begun: dict[str, list[int]]):
        self.terms, self.begun = terms, begun
        self.several: list[list[int]] = []

    def __missing__(self, word: str) -> int:
        own = [self.terms[word]] if word in self.terms else []
        for k in self.begun.get(word[: BEGINNINGS[0]], ()):
            if len(word) >= k and (form := f"{word[:k]}*") in self.terms:
                own.append(self.terms[form])
        if len(own) > 1:
            self.several.append(own)
        found = self[word] = -1 if not own else own[0] if len(own) == 1 else len(self.terms) + len(self.several) - 1
        return found

    def clear(self) -> None:
        super().clear()
        self.several.clear()

    def __reduce__(self):
        return Known, (self.terms, self.begun)


def tally(rows: Iterable[tuple[str | None, int]]) -> dict[str, list[int]]:
    """Of (text, label) rows for each form how many have it, and how many of those are labelled."""
    out: dict[str, list[int]] = {}
    for text, y in rows:
        for form in {form for word in set(words(text)) for form in forms(word)}:
            counts = out.setdefault(form, [0, 0])
            counts[0] += 1
            counts[1] += y
    return out


def standing(form: str, df: int, hits: int, n: int, positive: int) -> bool | None:
    """True for a form that goes with the label, False for any other term, None for what is no term."""
    if df >= FEWEST and 0 < positive < n:
        a, b, c, d = hits, df - hits, positive - hits, n - positive - df + hits
        value = n * (a * d - b * c) ** 2 / max(1.0, (a + b) * (c + d) * (a + c) * (b + d))
        if value >= CHI or a * d > b * c and by_chance(a, df, positive, n) <= CHANCE:
            return True
    return False if LEAST_DF <= df <= MOST_SHARE * n and not form.endswith("*") else None


class Model:
    """Fitted on (doc_id, text, label) rows, each doc_id once; fit does the same over a table."""

    def __init__(self, rows: list[tuple[int, str | None, int]], quiet: float = QUIET):
        n, positive = len(rows), sum(int(y) for *_, y in rows)
        found = {form: (df, standing(form, df, hits, n, positive)) for form, (df, hits) in tally((text, int(y)) for _, text, y in rows).items()}
        self.choose({form: x for form, x in found.items() if x[1] is not None}, n, quiet)
        self.learn(np.array([i for i, *_ in rows], np.int64), np.array([y for *_, y in rows], float), [self.vector(text) for _, text, _ in rows])

    @classmethod
    def of_terms(cls, found: dict[str, tuple[int, bool]], n: int, quiet: float = QUIET) -> Model:
        """A model that knows its terms and can turn texts to vectors, but hasn't learned yet."""
        self = cls.__new__(cls)
        self.choose(found, n, quiet)
        return self

    def choose(self, found: dict[str, tuple[int, bool]], n: int, quiet: float) -> None:
        """found: terms to their df and whether they go with the label; n: how many examples there are."""
        chosen = sorted(found)
        self.terms = {w: i for i, w in enumerate(chosen)}
        begun: dict[str, list[int]] = {}
        for form in sorted((form for form in chosen if form.endswith("*")), key=len):
            if len(form) - 1 not in begun.setdefault(form[: BEGINNINGS[0]], []):
                begun[form[: BEGINNINGS[0]]].append(len(form) - 1)
        self.known = Known(self.terms, begun)
        self.loud = np.array([found[w][1] for w in chosen], bool)
        self.weights = np.array([(math.log((1 + n) / (1 + found[w][0])) + 1) * (1.0 if found[w][1] else quiet) for w in chosen])

    def learn(self, ids: np.ndarray, labels: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """From examples' identifiers, labels and vectors, in any order; calibrated on some of them."""
        n = len(ids)
        have = [i for i, (terms, _) in enumerate(vectors) if len(terms)]
        plain = [i for i, (terms, _) in enumerate(vectors) if not self.loud[terms].any()]
        self.prior = (labels[plain].sum() + 0.5) / (len(plain) + 2.0)
        vectors = [(terms.astype(np.int32), weights.astype(np.float32)) for terms, weights in vectors]
        self.index = Index([vectors[i] for i in have], labels[have], ids[have], len(self.terms))
        back = {int(doc_id): at for at, doc_id in enumerate(self.index.ids)}
        some = np.unique(np.linspace(0, max(0, n - 1), min(n, CALIBRATED)).astype(int))
        votes = [self.vote(*self.index.nearest(vectors[i][0].astype(np.int64), vectors[i][1].astype(float), NEIGHBOURS, back[int(ids[i])])) if len(vectors[i][0]) else self.prior for i in some]
        self.curve = _logistic(np.array(votes), labels[some])
        self.known.clear()

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(terms in order, weights) of a text, of length one; nothing for a text without terms."""
        found, known = words(text), self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        terms, times = np.unique(np.fromiter(map(known.__getitem__, found), np.int64, len(found)), return_counts=True)
        if len(terms) and terms[0] < 0:
            terms, times = terms[1:], times[1:]
        single = int(np.searchsorted(terms, len(self.terms)))
        if single < len(terms):
            counted = Counter(dict(zip(terms[:single].tolist(), times[:single].tolist())))
            for several, n in zip(terms[single:].tolist(), times[single:].tolist()):
                for term in known.several[several - len(self.terms)]:
                    counted[term] += n
            terms = np.array(sorted(counted), np.int64)
            times = np.array([counted[t] for t in terms.tolist()], np.int64)
        if not len(terms):
            return np.zeros(0, np.int64), np.zeros(0)
        weights = (1 + np.log(times)) * self.weights[terms]
        return terms, weights / np.sqrt(weights @ weights)

    def vote(self, places: np.ndarray, cosines: np.ndarray) -> float:
        weights = cosines**POWER
        return float((weights @ self.index.labels[places] + PRIOR * self.prior) / (weights.sum() + PRIOR))

    def score(self, text: str | None) -> tuple[float, list[tuple[int, float]]]:
        """The calibrated probability, and the neighbours behind it."""
        terms, weights = self.vector(text)
        places, cosines = self.index.nearest(terms, weights, NEIGHBOURS) if len(terms) else (np.zeros(0, np.int64), np.zeros(0))
        vote = self.vote(places, cosines) if len(terms) else self.prior
        a, b = self.curve
        return 1 / (1 + math.exp(-(a * vote + b))), list(zip(self.index.ids[places].tolist(), cosines.tolist()))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's method, with a little ridge; the slope is never negative."""
    if not len(x) or y.min() == y.max():
        rate = min(0.99, max(0.01, float(y.mean()))) if len(y) else 0.01
        return 0.0, math.log(rate / (1 - rate))
    design, w = np.stack([x - 0.5, np.ones_like(x)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (y - p) - 0.01 * w
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    a = max(0.0, float(w[0]))
    return a, float(w[1]) - a / 2


class Sent:
    """A model on its way to the tasks, compressed; a Python worker opens it once for all its tasks."""

    def __init__(self, model: Model):
        self.content, self.name = zlib.compress(pickle.dumps(model), 1), uuid.uuid4().hex

    def model(self) -> Model:
        return kept(self.name, lambda: pickle.loads(zlib.decompress(self.content)))


def fit(docs: DataFrame, labels: DataFrame, most: int = EXAMPLES, chars: int = CHARS) -> Model:
    """From docs(doc_id, text) and labels(doc_id, toxic): null labels, texts and identifiers teach nothing, nor do held-out
    documents (CRC-32 of the identifier divisible by 5). Of a repeated identifier the least text counts, and it's toxic if
    any of its labels says so. The sample has most documents and chars characters at most.

    Executors count forms and make vectors; the terms with their counts and the vectors come to the driver, no texts.
    """
    spark = docs.sparkSession
    rows = sample(docs, labels, "toxic", most, chars)
    n, positive = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("label") > 0).cast("int")), F.lit(0))).first()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, marks = batch.column(0), batch.column(1).to_pylist()
            for at in range(0, len(texts), TALLIED):
                found = tally((texts[i].as_py(), int(marks[i] > 0)) for i in range(at, min(len(texts), at + TALLIED)))
                counts = list(zip(*found.values())) or [(), ()]
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *(pa.array(c, pa.int64()) for c in counts)], names=["form", "df", "hits"])

    @F.arrow_udf("boolean")
    def stands(form: pa.Array, df: pa.Array, hits: pa.Array) -> pa.Array:
        return pa.array([standing(*one, n, positive) for one in zip(form.to_pylist(), df.to_pylist(), hits.to_pylist())], pa.bool_())

    sums = rows.select("text", "label").mapInArrow(counted, "form string, df long, hits long").groupBy("form").agg(F.sum("df").alias("df"), F.sum("hits").alias("hits"))
    # Most forms are in one example only and no terms.
    terms = sums.where(F.col("df") >= LEAST_DF).select("form", "df", stands("form", "df", "hits").alias("loud")).where("loud IS NOT NULL").toArrow()
    found = dict(zip(terms.column("form").to_pylist(), zip(terms.column("df").to_pylist(), terms.column("loud").to_pylist())))
    model = Model.of_terms(found, n)
    shared = spark.sparkContext.broadcast(Sent(model))  # the terms of the sample

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value.model()
        for batch in batches:
            vectors = [own.vector(text.as_py()) for text in batch.column(1)]
            columns = [pa.array([x.tobytes() for x, _ in vectors], pa.binary()), pa.array([w.astype(np.float32).tobytes() for _, w in vectors], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], names=["doc_id", "label", "terms", "weights"])

    learned = rows.select("doc_id", "text", "label").mapInArrow(made, "doc_id long, label long, terms binary, weights binary").orderBy("doc_id").toArrow()
    vectors = [(np.frombuffer(t.as_buffer(), np.int64), np.frombuffer(w.as_buffer(), np.float32)) for t, w in zip(learned.column("terms"), learned.column("weights"))]
    model.learn(learned.column("doc_id").to_numpy(), (learned.column("label").to_numpy() > 0).astype(float), vectors)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) and the row's key to FILE, ROW, doc_id, held_out, score, predicted, evidence (identifiers and
    cosines of the nearest examples).

    Texts without terms, null and empty ones too, get the prior's score. Repeated rows are scored one by one, a null
    doc_id stays null and isn't held out. An empty table gives an empty result; other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Sent(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value.model()
        for batch in batches:
            found = [model.score(text) for text in batch.column(3).to_pylist()]
            near = [pair for _, pairs in found for pair in pairs]
            pairs = pa.StructArray.from_arrays([pa.array([i for i, _ in near], pa.int64()), pa.array([c for _, c in near], pa.float64())], ["doc_id", "cosine"])
            evidence = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(pairs) for _, pairs in found)]), pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([s for s, _ in found], pa.float64()), evidence], names=[FILE, ROW, "doc_id", "score", "evidence"])

    texts = docs.select(FILE, ROW, F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = texts.mapInArrow(run, f"{FILE} long, {ROW} long, doc_id long, score double, evidence array<struct<doc_id long, cosine double>>")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select(FILE, ROW, "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that are predicted to be toxic; the columns stay as they are.

    A row is scored and kept or dropped in one pass; only its text goes to Python. Null and empty texts are judged by the
    prior, repeated rows alike; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Sent(fit(docs, labels)))

    @F.arrow_udf("boolean")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value.model()
        for texts in batches:
            yield pa.array([model.score(text.as_py())[0] < 0.5 for text in texts], pa.bool_())

    return docs.where(clean("text"))


def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = score(located(docs), fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "held_out", "score", "predicted", "evidence")


QUERIES = {"op4_toxicity": op4_toxicity}
