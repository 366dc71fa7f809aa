"""Quality scores by regularised quadratic discriminant analysis over document statistics.

Statistics of whole texts are transformed so that each is near symmetric, and stored. Class counts, means and second
moments come from one aggregation over all labelled training rows, so nothing is sampled. The covariance of a class is
shrunk towards the pooled one (``alpha``) and towards a multiple of its own diagonal (``gamma``). A score is the logistic
function of the difference of two Gaussian log densities plus the log odds of the classes; each density takes the
Mahalanobis distance through a Cholesky factor that is computed once and sent with the tasks.

Never inputs: labels, language, source, id. Defined results: a null text is empty and gets the finite score of its
statistics; labels other than 0 and 1 and rows without an id do not train; a document labelled more than once trains once
per distinct label; if only one class has training rows every score is 1 or 0, if none has, the share one half.
"""

from __future__ import annotations

import itertools
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cohortspark.llm.common import map_batches, quoted, written

ALPHA, GAMMA = 0.3, 0.005
THRESHOLD = 0.3
FOLDS = 5
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = bytes(range(48, 58))
COMMON = b".,;:'-\"()"
ODD = bytes(c for c in range(33, 127) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122) and c not in COMMON)
NAMES = ("words", "word_length", "upper", "digits", "common_marks", "odd_marks", "line_breaks", "distinct", "repeats",
         "word_spread", "top_word", "distinct_lines")


def statistics(text: bytes) -> tuple[float, ...]:
    """The transformed statistics of one text."""
    words = text.split()
    n, size = len(words), len(text)
    lengths = [len(w) for w in words]
    letters = sum(lengths)
    mean = letters / n if n else 0.0
    share = lambda marks: (size - len(text.translate(None, marks))) / (size + 10.0)
    distinct = set(words)
    again = sum(map(operator.eq, words, itertools.islice(words, 1, None)))
    spread = (sum(map(operator.mul, lengths, lengths)) / n - mean * mean) ** 0.5 if n else 0.0
    top = 0
    if n:
        counts: dict[bytes, int] = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        top = max(counts.values())
    lines = [line for line in text.split(b"\n") if line]
    root = lambda x: x ** 0.5
    return (
        np.log1p(n),
        np.log1p(mean),
        root(share(UPPER)),
        root(share(DIGITS)),
        root(share(COMMON)),
        root(share(ODD)),
        root(text.count(b"\n") / (size + 10.0)),
        # the growth of distinct words with length is taken out: Herdan's exponent
        np.log1p(len(distinct)) / np.log1p(n) if n else 1.0,
        root(again / (n + 10.0)),
        np.log1p(max(spread, 0.0)),
        root(top / (n + 10.0)),
        root(1.0 - len(set(lines)) / len(lines)) if lines else 0.0,
    )


def features(docs: DataFrame) -> DataFrame:
    """doc_id, x: the transformed statistics of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
            flat = pa.array(np.array(rows, np.float64).ravel() if rows else np.zeros(0))
            x = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(NAMES)), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), x], names=["doc_id", "x"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run,
                       "doc_id long, x array<double>")


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """Documents whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % folds == 0, F.lit(False))


@dataclass(frozen=True)
class Discriminant:
    """Per class: mean, Cholesky factor of the shrunk covariance, and its log density at the mean plus the log prior."""

    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.means):
            return np.full(len(x), self.constants[0])
        logs = []
        for mean, factor, constant in zip(self.means, self.factors, self.constants, strict=True):
            z = np.linalg.solve(factor, (x - mean).T)
            logs.append(constant - 0.5 * (z * z).sum(axis=0))
        return 1.0 / (1.0 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit(training: DataFrame, alpha: float = ALPHA, gamma: float = GAMMA) -> Discriminant:
    """Fit on (x, label): one row of moments per class reaches the driver, whatever the number of rows."""
    d = len(NAMES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    x = lambda i: F.col("x")[i]
    moments = {r.label: r for r in training.groupBy("label").agg(
        F.count("*").alias("n"),
        *[F.sum(x(i)).alias(f"s{i}") for i in range(d)],
        *[F.sum(x(i) * x(j)).alias(f"p{i}_{j}") for i, j in pairs],
    ).collect()}
    if set(moments) != {0, 1}:
        only = {(): 0.5, (0,): 0.0, (1,): 1.0}[tuple(sorted(moments))]
        return Discriminant(np.zeros((0, d)), np.zeros((0, d, d)), np.array([only]))
    means, covariances, counts = [], [], []
    for label in (0, 1):
        row, n = moments[label], moments[label]["n"]
        mean = np.array([row[f"s{i}"] for i in range(d)]) / n
        second = np.zeros((d, d))
        for i, j in pairs:
            second[i, j] = second[j, i] = row[f"p{i}_{j}"] / n
        means.append(mean)
        covariances.append(second - np.outer(mean, mean))
        counts.append(n)
    total = sum(counts)
    pooled = sum(n * c for n, c in zip(counts, covariances, strict=True)) / total
    factors, constants = [], []
    for n, covariance in zip(counts, covariances, strict=True):
        shrunk = (1 - alpha) * covariance + alpha * pooled
        shrunk = (1 - gamma) * shrunk + gamma * np.diag(np.diag(shrunk)) + 1e-6 * np.eye(d)
        factor = np.linalg.cholesky(shrunk)
        factors.append(factor)
        constants.append(np.log(n / total) - np.log(np.diag(factor)).sum())
    return Discriminant(np.array(means), np.array(factors), np.array(constants))


def scores(rows: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id, score: the probability of label 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    return rows.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def learn(rows: DataFrame, labels: DataFrame, label: str = "quality", **shrinkage: float) -> Discriminant:
    """Fit on the labelled documents that are not held out."""
    known = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"))).distinct()
    return fit(rows.join(known, "doc_id"), **shrinkage)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    rows = written(features(docs), "quality-features")
    return scores(rows, learn(rows, labels)).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with a score of the threshold or more. Texts are scored where they are read, not moved."""
    model = learn(written(features(docs), "quality-features"), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()]
            if rows:
                yield batch.filter(pa.array(model.score(np.array(rows, np.float64)) >= threshold))

    # other columns travel in a struct, as their names may be of any kind
    rows = docs.select("text", F.struct(*[quoted(c) for c in docs.columns if c != "text"]).alias("rest"))
    good = map_batches(rows, run, rows.schema)
    return good.select(*[F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns])
