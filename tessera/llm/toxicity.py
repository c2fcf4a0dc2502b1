"""Severity of toxic language by cumulative-link ordinal regression."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, word_list


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


STARTS = (4, 5, 6, 7)


def features_of(word: bytes) -> list[bytes]:
    """A word, and its beginnings of ``STARTS`` bytes, marked by a star, where it is longer."""
    return [word, *(word[:k] + b"*" for k in STARTS if len(word) > k)]


class WordFeatures(dict):
    """Numbers of the features of each word, kept in a bounded table."""

    def __init__(self, vocabulary: dict[bytes, int], most: int = 500_000):
        super().__init__()
        self.vocabulary, self.most = vocabulary, most

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        found = tuple(i for i in map(self.vocabulary.get, features_of(word)) if i is not None)
        self[word] = found
        return found

    def counts(self, words: list[bytes]) -> dict[int, int]:
        out: dict[int, int] = {}
        for word, n in Counter(words).items():
            for i in self[word]:
                out[i] = out.get(i, 0) + n
        return out


@dataclass
class OrdinalModel:
    """P(grade > k) = sigmoid(w.x - cut[k]); the weights are shared by all cuts."""

    vocabulary: dict[bytes, int]
    weights: np.ndarray
    cuts: np.ndarray

    def above(self, counts: dict[int, int]) -> np.ndarray:
        """Probability of exceeding each cut, not increasing, of a text with so many of each feature."""
        x = sum(self.weights[i] * (1 + log(n)) for i, n in counts.items())
        return sigmoid(x - self.cuts)


def fit_ordinal(x: np.ndarray, y: np.ndarray, grades: int, l2: float = 0.02, steps: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending cuts of a proportional-odds model, by accelerated gradient descent.

    ``x`` is a dense block of sampled rows by selected features; grades that
    are absent from ``y`` keep a cut above the highest one present.
    """
    n, d = x.shape
    w = np.zeros(d)
    share = np.array([(y > k).mean() for k in range(grades - 1)]).clip(1e-4, 1 - 1e-4)
    first, gaps = -np.log(share[0] / (1 - share[0])), np.full(max(grades - 2, 0), 0.5)
    raw = np.concatenate((w, [first], np.log(np.maximum(np.diff(-np.log(share / (1 - share))), 0.05)) if len(gaps) else []))
    m = v = np.zeros_like(raw)
    for t in range(1, steps + 1):
        w, cut = raw[:d], np.concatenate(([raw[d]], raw[d] + np.cumsum(np.exp(raw[d + 1 :]))))
        s = x @ w
        p = sigmoid(s[:, None] - cut)  # n by grades - 1
        edge = np.hstack((np.ones((n, 1)), p, np.zeros((n, 1))))
        slope = edge * (1 - edge)
        rows = np.arange(n)
        likely = np.maximum(edge[rows, y] - edge[rows, y + 1], 1e-9)
        ds = (slope[rows, y] - slope[rows, y + 1]) / likely
        dc = np.zeros((n, grades - 1))
        up, down = y > 0, y < grades - 1
        dc[rows[up], y[up] - 1] -= slope[rows[up], y[up]] / likely[up]
        dc[rows[down], y[down]] += slope[rows[down], y[down] + 1] / likely[down]
        cuts = dc.sum(0) / n
        g = np.concatenate((x.T @ ds / n - l2 * w / 10, [cuts.sum()], [cuts[k + 1 :].sum() * np.exp(raw[d + 1 + k]) for k in range(grades - 2)]))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        raw = raw + 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return raw[:d], np.concatenate(([raw[d]], raw[d] + np.cumsum(np.exp(raw[d + 1 :]))))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, most: int, id_col: str, text_col: str) -> DataFrame:
    """(i, y, t): at most ``most`` labelled documents, those of the lowest id hashes, written down.

    A document is marked if any of its labels is. Of rows that share an id the
    text of the lowest hash counts; null texts are left out.
    """
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).cast("long").alias("i"))
        .agg(F.max((F.col(label_col).cast("int") > 0).cast("int")).alias("y"))
        .orderBy(F.xxhash64("i"), "i")
        .limit(most)
    )
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("binary").alias("t"))
    # 12 bytes for each of at most `most` rows
    rows = rows.join(F.broadcast(chosen), "i").where("t is not null")
    return materialise(rows.groupBy("i", "y").agg(F.min_by("t", F.xxhash64("t")).alias("t")), "labelled-sample")


def feature_rows(sample: DataFrame) -> DataFrame:
    """(y, f): each feature of each sampled document, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = list({f for w in set(word_list(t.as_py())) for f in features_of(w)})
                yield pa.RecordBatch.from_arrays([pa.array([y] * len(found), pa.int32()), pa.array(found, pa.binary())], ["y", "f"])

    return sample.select("y", "t").mapInArrow(run, "y int, f binary")


def telling_features(sample: DataFrame, vocabulary: int, least: int, errors: float = 2.5) -> tuple[list[bytes], set[bytes]]:
    """The vocabulary, strongest first, and words of marked documents only.

    The vocabulary holds the features of at least ``least`` sampled documents
    whose log-odds of standing in a marked document, smoothed by a half, are
    at least ``errors`` standard errors over 0, and that stand in marked documents
    at least as often as in others: the ``vocabulary`` strongest. Features of
    clean documents are left out, as they would only tell languages apart.
    Both lists have ``vocabulary`` entries at most; the counts stay in Spark.
    """
    sizes = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    c = F.col
    df = feature_rows(sample).groupBy("f").agg(F.count_if(c("y") == 1).alias("a"), F.count_if(c("y") == 0).alias("b"))
    df = materialise(df.where((c("a") >= c("b")) & (c("a") + c("b") >= min(least, 3))), "feature-counts")
    a, b = c("a") + 0.5, c("b") + 0.5
    odds = F.log(a / (n1 - c("a") + 0.5)) - F.log(b / (n0 - c("b") + 0.5))
    error = F.sqrt(1 / a + 1 / (n1 - c("a") + 0.5) + 1 / b + 1 / (n0 - c("b") + 0.5))
    strength = F.round(odds / error, 9)
    strong = df.where((c("a") + c("b") >= least) & (strength >= errors)).orderBy(F.desc(strength), "f").limit(vocabulary)
    often = df.where((c("b") == 0) & (c("a") >= max(3, 0.02 * n1)) & ~c("f").cast("string").endswith("*")).orderBy(F.desc("a"), "f").limit(vocabulary)
    return [bytes(r.f) for r in strong.select("f").collect()], {bytes(r.f) for r in often.select("f").collect()}


def sparse_rows(sample: DataFrame, vocabulary: dict[bytes, int], marks: set[bytes]) -> list[tuple[int, float, dict[int, int]]]:
    """(y, share of marking words, counts by feature number) of each sampled document, in order of its id."""
    sent = sample.sparkSession.sparkContext.broadcast((vocabulary, marks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, marks = sent.value
        features = WordFeatures(vocabulary)
        for b in batches:
            rows = []
            for i, y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                words = word_list(t.as_py())
                counts = features.counts(words)
                rows.append((i, y, sum(w in marks for w in words) / max(1, len(words)), [*counts], [*counts.values()]))
            kinds = [pa.int64(), pa.int32(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["i", "y", "rate", "at", "n"])

    # at most `sample` rows of at most as many numbers as the vocabulary has
    found = sample.select("i", "y", "t").mapInArrow(run, "i long, y int, rate double, at array<int>, n array<int>").collect()
    return [(r.y, r.rate, dict(zip(r.at, r.n, strict=True))) for r in sorted(found, key=lambda r: r.i)]


def train(sample: DataFrame, grades: int = 3, vocabulary: int = 2048, least: int = 3) -> OrdinalModel:
    """Fit on a bounded labelled sample (i, y, t).

    Labels say yes or no, so grades are made of them: marked documents whose
    share of words that only marked documents use is at or over the median of
    the marked ones are grade 2, the others grade 1.
    """
    strong, marks = telling_features(sample, vocabulary, least)
    numbers = {f: i for i, f in enumerate(strong)}
    rows = sparse_rows(sample, numbers, marks)
    some = sorted(rate for y, rate, _ in rows if y and rate)
    middle = some[len(some) // 2] if some else np.inf
    y = np.array([0 if not y else 2 if rate >= middle else 1 for y, rate, _ in rows], int)
    model = OrdinalModel(numbers, np.zeros(len(numbers)), np.full(grades - 1, 40.0))
    if len(y) and y.any() and not y.all():
        x = np.zeros((len(rows), len(numbers)))
        for k, (_, _, counts) in enumerate(rows):
            for i, n in counts.items():
                x[k, i] = 1 + log(n)
        model.weights, model.cuts = fit_ordinal(x, y, grades)
    return model


def score_severity(
    docs: DataFrame,
    model: OrdinalModel,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.3,
) -> DataFrame:
    """(id, severity, grade, toxic) for each row: expected grade, likeliest grade, verdict.

    Defined cases: a null or empty text has no words and gets the severity of
    a document without any feature; repeated rows are scored one by one; null
    ids pass through; an empty table gives no rows; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        features, none = WordFeatures(model.vocabulary), model.above({})
        for b in batches:
            severity, grade, toxic = [], [], []
            for value in b.column(1):
                counts = features.counts(word_list(value.as_py()))
                above = model.above(counts) if counts else none
                each = -np.diff(np.concatenate(([1.0], above, [0.0])))
                severity.append(round(float(above.sum()), 6))
                grade.append(int(np.argmax(each)))
                toxic.append(bool(above[0] >= threshold))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(severity, pa.float64()), pa.array(grade, pa.int32()), pa.array(toxic, pa.bool_())],
                ["id", "severity", "grade", "toxic"],
            )

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return (
        docs.select(F.col(id_col), F.col(text_col).cast("binary"))
        .mapInArrow(run, f"id {kind}, severity double, grade int, toxic boolean")
        .withColumnRenamed("id", id_col)
    )


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    sample: int = 10_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Train on a bounded labelled sample (``sample`` documents at most), then score every row.

    Cases as in ``labelled_sample`` and ``score_severity``; without marked or
    without clean labels no row is toxic.
    """
    model = train(labelled_sample(docs, labels, label_col, sample, id_col, text_col))
    return score_severity(docs, model, id_col, text_col)
