"""Hard negatives by segment summaries: rows of another label that score next below an anchor's positives.

A vector is quantised to whole numbers and stored with the mean and the deviation of each segment of its components. The
inner product of two segments is the product of their means (times their length) plus or minus at most the product of
their deviations, so sums over segments bound a score from both sides. A task holds a block of anchors and streams rows
past it: coarse segments are asked first (their summaries follow from the fine ones), then fine ones, and only pairs that
may still enter one of the anchor's lists are scored exactly. A list keeps the ``k`` best rows of a band of scores; the
worst of a full list is the bound for later rows.

Positives come first, from rows of the anchor's label; they give every anchor its bands, and a second pass over all rows
fills them. Anchors are dealt in blocks of ``BLOCK_COMPONENTS``; rows meet every block of their group (the label in the
first pass, all in the second) and are dealt by hash inside it, so a label with a third of all rows is spread. This is a
stated query set against all rows, in blocks; pairs never leave a task, only lists do.

Defined results: rows with a null id or label, a null vector, or a component that is null or not finite (also after
scaling) take no part; rows equal in id, label and quantised vector count once; a row is never its own positive or
negative, nor one of equal id; vectors of different length have no score; a score beyond 64 bits is held at the limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortspark.llm.common import written

#: Components of a segment, coarse to fine. Fine summaries are stored.
SEGMENTS = (16, 4)
#: Components of the anchors that one task holds.
BLOCK_COMPONENTS = 8_000_000
#: Anchors and rows of one matrix of scores.
ANCHORS, ROWS = 256, 2048
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_EXACT = float(1 << 53)
#: Components up to which sums of squares stay finite; summaries of larger ones bound nothing.
_BOUNDED = 1e140


# ---- summaries --------------------------------------------------------------------------------------------------


def summaries(vectors: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of every segment, both times the root of its length, so that products need no weights."""
    n, d = vectors.shape
    vectors = np.clip(vectors, -_BOUNDED, _BOUNDED)
    starts = np.arange(0, d, length)
    if not d:
        return np.zeros((n, 0)), np.zeros((n, 0))
    root = np.sqrt(np.diff(np.append(starts, d)))
    mean = np.add.reduceat(vectors, starts, axis=1) / root
    apart = vectors - np.repeat(mean / root, np.diff(np.append(starts, d)), axis=1)
    return mean, np.sqrt(np.add.reduceat(apart * apart, starts, axis=1))


def coarser(mean: np.ndarray, deviation: np.ndarray, fine: int, coarse: int, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Summaries of segments of ``coarse`` components from those of ``fine`` ones."""
    if not d:
        return mean, deviation
    starts = np.arange(0, mean.shape[1], coarse // fine)
    sizes = np.diff(np.append(np.arange(0, d, fine), d))
    root = np.sqrt(np.add.reduceat(sizes, starts))
    joined = np.add.reduceat(mean * np.sqrt(sizes), starts, axis=1) / root
    square = np.add.reduceat(mean * mean + deviation * deviation, starts, axis=1) - joined * joined
    # rounding must not make a deviation too small
    return joined, np.sqrt(np.maximum(square, 0) + 1e-9 * (joined * joined + 1))


class Vectors:
    """Rows of equal length with their summaries, coarse to fine."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, mean: np.ndarray, deviation: np.ndarray) -> None:
        self.ids, self.labels, self.vectors = ids, labels, vectors
        fine, d = SEGMENTS[-1], vectors.shape[1]
        self.levels = [coarser(mean, deviation, fine, s, d) for s in SEGMENTS[:-1]] + [(mean, deviation)]
        self.norms = np.sqrt((np.clip(vectors, -_BOUNDED, _BOUNDED) ** 2).sum(axis=1))
        self.largest = float(np.abs(vectors).max(initial=0))

    def take(self, at) -> Vectors:
        new = object.__new__(Vectors)
        new.ids, new.labels, new.vectors, new.norms = self.ids[at], self.labels[at], self.vectors[at], self.norms[at]
        new.levels = [(m[at], s[at]) for m, s in self.levels]
        new.largest = self.largest
        return new


def bounds(a: Vectors, b: Vectors, level: int) -> tuple[np.ndarray, np.ndarray]:
    """What the score of every pair is at least and at most."""
    (ma, sa), (mb, sb) = a.levels[level], b.levels[level]
    middle, spread = ma @ mb.T, sa @ sb.T
    spread += 1e-9 * np.outer(a.norms, b.norms) + 1e-6
    return middle - spread, middle + spread


def scores(a: np.ndarray, b: np.ndarray, largest: float, pairs: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Inner products of all rows of ``a`` with all of ``b``, or of the pairs, as exact whole numbers."""
    if a.shape[1] * largest < _EXACT:
        exact = a @ b.T if pairs is None else np.einsum("ij,ij->i", a[pairs[0]], b[pairs[1]])
        return exact.astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)
    a, b = whole(a), whole(b)
    exact = a.dot(b.T) if pairs is None else (a[pairs[0]] * b[pairs[1]]).sum(axis=1)
    return np.clip(exact, _LOW, _HIGH).astype(np.int64)


# ---- lists of one block of anchors --------------------------------------------------------------------------------


class Lists:
    """For each anchor and each of its bands of scores, the ``k`` best rows met so far: higher scores first, then smaller
    ids."""

    def __init__(self, anchors: Vectors, low: np.ndarray, high: np.ndarray, k: int, same_label: bool) -> None:
        self.anchors, self.low, self.high, self.k, self.same_label = anchors, low, high, k, same_label
        n, bands = low.shape
        self.ids = np.zeros((n, bands, k), np.int64)
        self.scores = np.zeros((n, bands, k), np.int64)
        self.count = np.zeros((n, bands), np.int64)
        #: Pairs that were met, and that were scored.
        self.met = self.scored = 0

    def meet(self, rows: Vectors) -> None:
        for at in range(0, len(self.anchors.ids), ANCHORS):
            self._meet(slice(at, at + ANCHORS), rows)

    def _meet(self, block: slice, rows: Vectors) -> None:
        anchors = self.anchors.take(block)
        full = self.count[block] == self.k
        floor = np.where(full, np.maximum(self.low[block], self.scores[block, :, -1]), self.low[block])
        empty = self.low[block] > self.high[block]
        least = np.where(empty, _HIGH, floor).min(axis=1)[:, None].astype(float)
        most = np.where(empty, _LOW, self.high[block]).max(axis=1)[:, None].astype(float)
        wanted = anchors.ids[:, None] != rows.ids
        wanted &= (anchors.labels[:, None] == rows.labels) == self.same_label
        self.met += wanted.size
        for level in range(len(SEGMENTS) if max(anchors.largest, rows.largest) < _BOUNDED else 0):
            down, up = bounds(anchors, rows, level)
            wanted &= (up >= least) & (down <= most)
            some = wanted.any(axis=0)
            if not some.any():
                return
            if some.mean() < 0.5:
                rows, wanted = rows.take(some), wanted[:, some]
        largest = anchors.largest * rows.largest
        if wanted.mean() < 0.125:
            a, r = np.nonzero(wanted)
            self.scored += len(a)
            value = scores(anchors.vectors, rows.vectors, largest, (a, r))
        else:
            self.scored += wanted.size
            value = scores(anchors.vectors, rows.vectors, largest)
            wanted &= (value >= least) & (value <= most)
            a, r = np.nonzero(wanted)
            value = value[a, r]
        for band in range(floor.shape[1]):
            inside = (value >= floor[a, band]) & (value <= self.high[block][a, band])
            if inside.any():
                self._keep(block.start, band, a[inside], rows.ids[r[inside]], value[inside])

    def _keep(self, start: int, band: int, a: np.ndarray, ids: np.ndarray, value: np.ndarray) -> None:
        touched = np.unique(a)
        own = touched + start
        held = np.arange(self.k) < self.count[own, band][:, None]
        a = np.concatenate([a, np.repeat(touched, held.sum(axis=1))])
        ids = np.concatenate([ids, self.ids[own, band][held]])
        value = np.concatenate([value, self.scores[own, band][held]])
        order = np.lexsort((ids, ~value, a))  # ~value falls as the value rises, without overflow
        a, ids, value = a[order], ids[order], value[order]
        first = np.searchsorted(a, a)
        place = np.arange(len(a)) - first
        best = place < self.k
        at, place = a[best] + start, place[best]
        self.ids[at, band, place], self.scores[at, band, place] = ids[best], value[best]
        self.count[own, band] = np.minimum(np.bincount(a, minlength=touched[-1] + 1)[touched], self.k)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, band, id and score of every place that is taken."""
        a, band, place = np.nonzero(np.arange(self.k) < self.count[:, :, None])
        return a, band, self.ids[a, band, place], self.scores[a, band, place]


# ---- on Spark -----------------------------------------------------------------------------------------------------


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)


def stored(vectors: DataFrame, vec_id: Column, vector: Column, label: Column, scale: float) -> DataFrame:
    """row (a number of its own), vec_id, label, dim, v, means, deviations of all rows that take part, stored."""
    rows = vectors.select(vec_id.cast("long").alias("vec_id"), label.cast("long").alias("label"),
                          vector.cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    rows = rows.withColumn("v", F.transform("v", lambda x: x * scale))
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(batch.column("v").offsets.to_numpy())
            for d in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == d))
                v = np.floor(_matrix(part.column("v"), len(part))) + 0.0  # no negative zero
                mean, deviation = summaries(v, SEGMENTS[-1])
                lists = [pa.array(list(x), pa.list_(pa.float64())) for x in (v, mean, deviation)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), part.column("label"), pa.array([d] * len(part), pa.int32()), *lists],
                    names=["vec_id", "label", "dim", "v", "means", "deviations"])

    schema = "vec_id long, label long, dim int, v array<double>, means array<double>, deviations array<double>"
    done = rows.mapInArrow(run, schema).dropDuplicates()
    return written(done.select(F.monotonically_increasing_id().alias("row"), "*"), "negatives-vectors")


def _lists(anchors: DataFrame, rows: DataFrame, group: list[str], k: int, bands: int, same_label: bool) -> DataFrame:
    """anchor (its row), band, vec_id, score: the ``k`` best rows of the group in every band of an anchor.

    ``anchors`` has the columns of ``rows`` and the arrays ``low`` and ``high``.
    """
    spark = rows.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, 1)
    sizes = rows.groupBy(*group).agg(F.count("*").alias("n")).join(
        anchors.groupBy(*group).agg(F.count("*").alias("anchors"), F.max("dim").alias("d")), group)
    everything = sizes.agg(F.sum("n")).first()[0]
    if not everything:
        return spark.createDataFrame([], "anchor long, band int, vec_id long, score long, rank int")
    blocks = F.ceil(F.col("anchors") * F.greatest(F.col("d"), F.lit(1)) / BLOCK_COMPONENTS)
    sizes = written(sizes.select(*[F.col(c).alias(f"_{c}") for c in group], "n", blocks.cast("int").alias("blocks")), "negatives-sizes")
    parts = F.ceil(F.col("n") * tasks / (F.lit(everything) * F.col("blocks"))).cast("int")
    same = [F.col(c) == F.col(f"_{c}") for c in group]
    deal = lambda n: F.pmod(F.xxhash64("row"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    columns = ["row", "vec_id", "label", "v", "means", "deviations"]
    none = F.lit(None).cast("array<long>")
    left = anchors.join(sizes, same).withColumns({"block": deal(F.col("blocks")), "part": every(parts), "kind": F.lit(0)})
    right = rows.join(sizes, same).withColumns(
        {"low": none, "high": none, "part": deal(parts), "block": every(F.col("blocks")), "kind": F.lit(1)})
    key = F.concat_ws(":", *[F.col(c).cast("string") for c in group], "block", "part").alias("cell")
    both = left.select(key, "kind", *columns, "low", "high").unionByName(right.select(key, "kind", *columns, "low", "high"))
    dealt = both.repartition(tasks, "cell").sortWithinPartitions("cell", "kind")

    def vectors_of(batch: pa.RecordBatch) -> Vectors:
        n = len(batch)
        return Vectors(batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(),
                       *(_matrix(batch.column(c), n) for c in ("v", "means", "deviations")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, lists, names = None, [], None, None

        def opened() -> Lists | None:
            nonlocal names
            if not held:
                return None
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            names = table.column("row").to_numpy()
            limits = [table.column(c).flatten().to_numpy().reshape(len(table), bands) for c in ("low", "high")]
            return Lists(vectors_of(table), *limits, k, same_label)

        def closed() -> Iterator[pa.RecordBatch]:
            if lists is not None:
                a, band, ids, score = lists.rows()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[a]), pa.array(band.astype(np.int32)), pa.array(ids), pa.array(score)],
                    names=["anchor", "band", "vec_id", "score"])

        for batch in batches:
            own = batch.column("cell").to_pylist()
            kinds = batch.column("kind").to_numpy()
            at = 0
            while at < len(batch):
                to = at + 1
                while to < len(batch) and to - at < ROWS and own[to] == own[at] and kinds[to] == kinds[at]:
                    to += 1
                if own[at] != cell:
                    yield from closed()
                    cell, lists = own[at], None
                    held.clear()
                part = batch.slice(at, to - at)
                if kinds[at] == 0:
                    held.append(part)
                else:
                    lists = lists or opened()
                    if lists is not None:
                        lists.meet(vectors_of(part))
                at = to
        yield from closed()

    found = dealt.mapInArrow(run, "anchor long, band int, vec_id long, score long")
    best = Window.partitionBy("anchor", "band").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, vec_id: Column, vector: Column, label: Column, positives: int = 5,
         negatives: int = 10, low: str = "0.3", high: str = "0.9", scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on ``vec_id``; ``vec_id``, ``vector`` and ``label`` are expressions on ``vectors``.
    A negative's score is between ``low`` and ``high`` times the positive's, both included.
    """
    rows = stored(vectors, vec_id, vector, label, scale)
    anchors = rows.where(is_anchor)
    every = anchors.withColumns({"low": F.array(F.lit(_LOW)), "high": F.array(F.lit(_HIGH))})
    best = _lists(every, rows, ["dim", "label"], positives, 1, True)
    best = written(best.select("anchor", "rank", "vec_id", "score"), "negatives-positives")
    edge = lambda part: F.col("score").cast("decimal(20,0)") * F.lit(Decimal(part))
    lists = best.select("anchor", F.struct(
        "rank", F.col("vec_id").alias("positive"), F.col("score").alias("positive_score"),
        F.ceil(edge(low)).cast("long").alias("low"), F.floor(edge(high)).cast("long").alias("high")).alias("p"))
    lists = lists.groupBy("anchor").agg(F.array_sort(F.collect_list("p")).alias("ps"))  # ``positives`` at most
    filled = lambda field, empty: F.transform(
        F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.get("ps", i)[field], F.lit(empty).cast("long")))
    banded = anchors.join(lists, F.col("row") == F.col("anchor")).withColumns(
        {"low": filled("low", 1), "high": filled("high", 0)}).drop("ps", "anchor")
    banded = written(banded, "negatives-bands")
    found = _lists(banded, rows, ["dim"], negatives, positives, False)
    known = best.select(F.col("anchor").alias("_anchor"), (F.col("rank") - 1).alias("_band"), F.col("vec_id").alias("positive_id"),
                        F.col("score").alias("positive_score"))
    met = found.join(known, (F.col("anchor") == F.col("_anchor")) & (F.col("band") == F.col("_band")))
    names = anchors.select(F.col("row").alias("_row"), F.col("vec_id").alias("anchor_id"))
    return met.join(names, F.col("anchor") == F.col("_row")).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
