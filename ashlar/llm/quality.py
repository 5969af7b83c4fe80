"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade <= k) = logistic(threshold_k - w . x) with one weight vector for all grades and ordered thresholds. x is the mean
over a text's words of hashed features: the word without case and outer marks, its shape, the marks around it; and of the text
how many words repeat the one before, how many are distinct, and its length. The mean makes a text's value the mean of
its words' values, so scoring is one look-up a word. Expected grade and the probability of at least the wanted grade
follow from the same value.

Learning looks at a bounded sample of rated documents (EXAMPLES, those with the least hashes, of CHARS characters at
most) in the driver.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ashlar.llm.common import FILE, ROW, examples, located, table

EXAMPLES, CHARS, BUCKETS, STEPS, RATE, RIDGE, SCALE, CACHE_WORDS = 4000, 64_000_000, 1 << 16, 150, 0.1, 1e-4, 20.0, 250_000
_INNER = re.compile(r"[^\W_]").search


def parts(word: str) -> tuple[str, str, str]:
    """The marks before, what lies between the first and the last letter or digit, the marks behind; in linear time."""
    first = _INNER(word)
    if first is None:
        return word, "", ""
    end = len(word) - _INNER(word[::-1]).start()
    return word[: first.start()], word[first.start() : end], word[end:]


def features(word: str) -> list[int]:
    """Buckets of a word's features."""
    before, core, after = parts(word)
    shape = "upper" if len(core) > 1 and core.isupper() else "title" if core[:1].isupper() else "digit" if any(map(str.isdigit, core)) else "lower" if core else "none"
    named = (f"w={core.lower()}", f"s={shape}", f"b={before[:4]}", f"a={after[:4]}", f"n={min(len(core), 24)}")
    return [_bucket(name) for name in named]


def _bucket(name: str) -> int:
    return xxhash.xxh32_intdigest(name) % BUCKETS


def whole(words: list[str]) -> dict[int, float]:
    """Features of the text as a whole, as sums over its words."""
    repeats = sum(map(eq, words[1:], words))
    return {_bucket("repeats"): float(repeats), _bucket("distinct"): float(len(set(words))), _bucket(f"length={len(words).bit_length()}"): float(len(words))}


def thresholds_of(free: np.ndarray) -> np.ndarray:
    """Ordered thresholds: the first is free, the others add the exponential of a parameter."""
    return np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))])


def ascent(w: np.ndarray, free: np.ndarray, row: np.ndarray, bucket: np.ndarray, value: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The mean log likelihood less half the ridge, and its gradients by weights and by free parameters.

    Example row has the value in the bucket; y are the examples' classes.
    """
    theta, n = thresholds_of(free), len(y)
    z = np.bincount(row, w[bucket] * value, minlength=n)
    edges = np.concatenate([np.full((n, 1), -np.inf), theta - z[:, None], np.full((n, 1), np.inf)], axis=1)
    upper, lower = edges[np.arange(n), y + 1], edges[np.arange(n), y]
    # Ratios of logistic functions by their logarithms, which don't saturate.
    log = lambda x: -np.logaddexp(0, -x)
    gap = -np.expm1(lower - upper)
    at_upper, at_lower = np.exp(log(-upper) - log(-lower)) / gap, np.exp(log(lower) - log(upper)) / gap
    slope = np.exp(log(upper)) + np.exp(log(lower)) - 1  # of the log likelihood by z
    grad_w = np.bincount(bucket, slope[row] * value, minlength=len(w)) / n - RIDGE * w
    by_theta = np.array([(at_upper[y == k].sum() - at_lower[y == k + 1].sum()) / n for k in range(len(theta))])
    grad_t = np.array([by_theta.sum(), *(by_theta[k:].sum() * math.exp(free[k]) for k in range(1, len(free)))])
    return float((log(upper) + log(-lower) + np.log(gap)).mean() - RIDGE / 2 * (w @ w)), grad_w, grad_t


class Model:
    """Fitted on (text, grade) rows; grades are whole numbers, their distinct values in order are the classes."""

    def __init__(self, rows: list[tuple[str | None, int]], wanted: int | None = None):
        self.grades = sorted({grade for _, grade in rows}) or [0]
        self.wanted = self.grades[-1] if wanted is None else wanted
        self.weights, self.cache = np.zeros(BUCKETS), {}
        self.thresholds = np.zeros(len(self.grades) - 1)
        if len(self.grades) > 1:
            self._fit(rows)

    def _fit(self, rows: list[tuple[str | None, int]]) -> None:
        buckets, values, starts, known = [], [], [0], {}
        for text, _ in rows:
            words = (text or "").split()
            counted, x = Counter(words), Counter(whole(words))
            for word, n in counted.items():
                if word not in known:
                    known[word] = features(word)
                for bucket in known[word]:
                    x[bucket] += n
            total = max(1, sum(counted.values()))
            buckets.append(np.fromiter(x.keys(), np.int32, len(x)))
            values.append(np.fromiter(x.values(), np.float32, len(x)) * (SCALE / total))
            starts.append(starts[-1] + len(x))
        bucket, value = np.concatenate(buckets), np.concatenate(values)
        row = np.repeat(np.arange(len(rows)), np.diff(starts))
        y = np.searchsorted(self.grades, [grade for _, grade in rows])
        shares = np.cumsum(np.bincount(y, minlength=len(self.grades)))[:-1] / len(y)
        base = np.log(shares / (1 - shares))
        free = np.concatenate([base[:1], np.log(np.maximum(np.diff(base), 1e-3))])
        w, speed_w, speed_t = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(len(free))
        for _ in range(STEPS):
            _, grad_w, grad_t = ascent(w, free, row, bucket, value, y)
            speed_w += grad_w**2
            speed_t += grad_t**2
            w += RATE * grad_w / (np.sqrt(speed_w) + 1e-8)
            free += RATE * grad_t / (np.sqrt(speed_t) + 1e-8)
        self.weights = w
        self.thresholds = thresholds_of(free)

    def value(self, text: str | None) -> float:
        found, cache = (text or "").split(), self.cache
        new = set(found).difference(cache)
        if len(cache) + len(new) > CACHE_WORDS:
            cache.clear()
            new = set(found)
        for word in new:
            cache[word] = float(self.weights[features(word)].sum())
        of_text = sum(self.weights[bucket] * n for bucket, n in whole(found).items())
        return SCALE * (math.fsum(map(cache.__getitem__, found)) + of_text) / max(1, len(found))

    def grade(self, text: str | None) -> tuple[float, float]:
        """Expected grade, and the probability of the wanted grade or a better one."""
        z = self.value(text)
        at_least = [1.0, *(1 / (1 + math.exp(min(700.0, t - z))) for t in self.thresholds)]
        expected = self.grades[0] + sum(p * (b - a) for p, a, b in zip(at_least[1:], self.grades, self.grades[1:]))
        reached = [p for p, g in zip(at_least, self.grades) if g >= self.wanted]
        return expected, reached[0] if reached else 0.0


def fit(docs: DataFrame, labels: DataFrame, most: int = EXAMPLES, wanted: int | None = None, chars: int = CHARS) -> Model:
    """From docs(doc_id, text) and labels(doc_id, quality): null ratings, texts and identifiers teach nothing, nor do
    held-out documents (CRC-32 of the identifier divisible by 5). Of a repeated identifier the least text and the least
    rating count. The sample has most documents and chars characters at most."""
    return Model([(text, int(rating)) for _, text, rating in examples(docs, labels, "quality", most, chars, F.min)], wanted)


def grade(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """docs(FILE, ROW, doc_id, text) to FILE, ROW, doc_id, held_out, expected_grade, tail_probability, selected.

    Null and empty texts have value zero and so the grade of a text without known words. Repeated rows are graded one by
    one; an empty table gives an empty result; other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            expected, tail = zip(*[model.grade(text.as_py()) for text in batch.column(3)]) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(expected, pa.float64()), pa.array(tail, pa.float64())], names=[FILE, ROW, "doc_id", "expected_grade", "tail_probability"])

    texts = docs.select(FILE, ROW, F.col("doc_id").cast("long").alias("doc_id"), "text")
    graded = texts.mapInArrow(run, f"{FILE} long, {ROW} long, doc_id long, expected_grade double, tail_probability double")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out")
    return graded.select(FILE, ROW, "doc_id", held_out, "expected_grade", "tail_probability", (F.col("tail_probability") >= least).alias("selected"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """docs whose probability of the best grade is at least least; the columns stay as they are.

    A row is graded and kept or dropped in one pass; only its text goes to Python. Null and empty texts have the grade of
    a text without known words, repeated rows are judged alike; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    @F.arrow_udf("boolean")
    def good(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for texts in batches:
            yield pa.array([model.grade(text.as_py())[1] >= least for text in texts], pa.bool_())

    return docs.where(good("text"))


def op3_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return grade(located(docs), fit(docs, table(spark, sf_dir, "labels"))).drop(FILE, ROW)


QUERIES = {"op3_quality": op3_quality}
