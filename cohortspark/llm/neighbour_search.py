"""Approximate nearest neighbours by low-dimensional stable projections, a kd-tree and a chi-square stopping test.

Vectors are projected onto ``m`` Gaussian directions. The squared projected distance of two points over their squared
true distance follows a chi-square law with m degrees of freedom, so a point that is farther than
``sqrt(quantile) * d`` in the projection is nearer than d in truth only with probability ``1 - confidence``.

A kd-tree over the projections, fitted on a bounded sample (``SAMPLE_ROWS``), cuts the table into cells; every row is
assigned to one. A query first verifies its nearest cells until these hold enough rows for k neighbours; its k-th
distance then says which other cells, and which points in them, the stopping test leaves open, and only these are
verified. Verification takes exact distances in double precision on the original vectors.

Cells and queries meet by shuffle: a cell with many rows (many equal vectors) is cut by id, and its queries are cut into
blocks, so a task holds a piece of a cell and a block of queries. The driver sees the sample and one row per cell, of
which there are ``MOST_CELLS`` at most.

Defined results: vectors that are null, of zero length, or hold null or non-finite components take no part, nor do rows
without an id or with another number of components than most; of rows that repeat an id the smallest vector counts; ties
go to the smaller id; a query with fewer than k candidates gets them all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortspark.llm.common import written

DIRECTIONS = 8
CONFIDENCE = 0.95
SAMPLE_ROWS = 20_000
CELL_ROWS, MOST_CELLS = 500, 4096
PIECE_ROWS, BLOCK_QUERIES = 1000, 500


def chi_square_quantile(confidence: float, degrees: int) -> float:
    """For an even number of degrees of freedom, by bisection of the closed form."""
    def share_above(x: float) -> float:
        return math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(degrees // 2))

    low, high = 0.0, 1.0
    while share_above(high) > 1 - confidence:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if share_above(middle) > 1 - confidence else (low, middle)
    return high


# ---- index -----------------------------------------------------------------------------------------------------


def usable(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, v): rows that take part, one per id, components in double precision."""
    v = F.col(column).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col(column).isNotNull() & finite & F.exists("v", lambda x: x != 0))
    rows = written(rows.groupBy("id").agg(F.min("v").alias("v")), "vectors")
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (usual.n if usual else 0))


def fit_tree(sample: np.ndarray, cells: int) -> list[tuple[int, float, int, int]]:
    """A kd-tree as rows (direction, value, left, right); a leaf has direction -1 and its cell as left."""
    nodes: list[tuple[int, float, int, int]] = [(-1, 0.0, 0, 0)]
    leaves = [(0, np.arange(len(sample)))]
    made = 1
    while made < cells and leaves:
        leaves.sort(key=lambda leaf: len(leaf[1]))
        at, rows = leaves.pop()
        if len(rows) < 2:
            break
        points = sample[rows]
        direction = int(np.argmax(points.max(axis=0) - points.min(axis=0)))
        values = points[:, direction]
        cut = float(np.median(values))
        left = values < cut
        if not left.any() or left.all():
            continue
        nodes[at] = (direction, cut, len(nodes), len(nodes) + 1)
        leaves += [(len(nodes), rows[left]), (len(nodes) + 1, rows[~left])]
        nodes += [(-1, 0.0, 0, 0)] * 2
        made += 1
    cell = 0
    for at, node in enumerate(nodes):
        if node[0] < 0:
            nodes[at] = (-1, 0.0, cell, 0)
            cell += 1
    return nodes


def descend(nodes: list, points: np.ndarray) -> np.ndarray:
    """The cell of every projected point."""
    direction, value, left, right = (np.array(c) for c in zip(*nodes, strict=True))
    at = np.zeros(len(points), np.int64)
    while True:
        open_ = np.flatnonzero(direction[at] >= 0)
        if not len(open_):
            return left[at]
        here = at[open_]
        smaller = points[open_, direction[here]] < value[here]
        at[open_] = np.where(smaller, left[here], right[here])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def build(rows: DataFrame, directions: int = DIRECTIONS, seed: int = 0) -> tuple[DataFrame, dict]:
    """The stored index (id, v, p, cell, piece) and its cells: counts, boxes, pieces."""
    count = rows.count()
    size = rows.select(F.size("v").alias("n")).first()
    if size is None:
        return written(rows.select("id", F.lit(b"").alias("v"), F.lit(b"").alias("p"), F.lit(0).cast("long").alias("cell"),
                                   F.lit(0).cast("long").alias("piece")), "index"), {}
    plane = np.random.default_rng(seed).standard_normal((size.n, directions))
    share = max(1, math.ceil(min(1.0, SAMPLE_ROWS / count) * 1_000_000))
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share).select("v").limit(2 * SAMPLE_ROWS).toPandas()
    sample = sample if len(sample) else rows.select("v").limit(1).toPandas()
    cells = max(1, min(MOST_CELLS, count // CELL_ROWS))
    nodes = fit_tree(np.stack(sample["v"].to_numpy()) @ plane, cells)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            v = _matrix(batch.column(1))
            p = v @ plane
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([row.tobytes() for row in v], pa.binary()),
                 pa.array([row.tobytes() for row in p], pa.binary()), pa.array(descend(nodes, p)),
                 pa.array(p.tolist(), pa.list_(pa.float64()))], names=["id", "v", "p", "cell", "q"])

    stored = written(rows.mapInArrow(assign, "id long, v binary, p binary, cell long, q array<double>"), "index")
    boxes = stored.groupBy("cell").agg(
        F.count("*").alias("n"), *[F.min(F.col("q")[i]).alias(f"low{i}") for i in range(directions)],
        *[F.max(F.col("q")[i]).alias(f"high{i}") for i in range(directions)]).toPandas()
    found = {
        "cell": boxes["cell"].to_numpy(), "n": boxes["n"].to_numpy(),
        "low": boxes[[f"low{i}" for i in range(directions)]].to_numpy(float),
        "high": boxes[[f"high{i}" for i in range(directions)]].to_numpy(float),
        "pieces": np.ceil(boxes["n"].to_numpy() / PIECE_ROWS).astype(np.int64),
    }
    parts = F.create_map(*[F.lit(int(x)) for pair in zip(found["cell"], found["pieces"], strict=True)
                           if pair[1] > 1 for x in pair]) if (found["pieces"] > 1).any() else None
    pieces = F.coalesce(parts[F.col("cell").cast("int")], F.lit(1)) if parts is not None else F.lit(1)
    return stored.select("id", "v", "p", "cell", F.pmod(F.xxhash64("id"), pieces).cast("long").alias("piece")), found


# ---- search ----------------------------------------------------------------------------------------------------

VISIT = "query long, v binary, p binary, limit double, cell long, piece long"
FOUND = "query long, id long, score double"


def _visits(queries: DataFrame, cells: dict, k: int, quantile: float | None) -> DataFrame:
    """The pieces of cells that a query visits. Without a quantile: its nearest cells with more than k rows together,
    or at least two cells; with one: the other cells that the stopping test at its ``limit`` leaves open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                p = np.frombuffer(b"".join(part.column(2).to_pylist())).reshape(len(part), -1)
                gap = np.maximum(cells["low"][None] - p[:, None], 0) + np.maximum(p[:, None] - cells["high"][None], 0)
                far = (gap * gap).sum(axis=2)
                order = np.argsort(far, axis=1, kind="stable")
                held = np.cumsum(cells["n"][order], axis=1)
                first = np.empty_like(order, bool)
                np.put_along_axis(first, order, np.concatenate([np.zeros((len(p), 1), np.int64), held[:, :-1]], axis=1) <= k, 1)
                np.put_along_axis(first, order[:, :2], True, 1)
                limit = part.column(3).to_numpy(zero_copy_only=False)
                chosen = first if quantile is None else ~first & (far <= quantile * (limit ** 2)[:, None])
                rows, which = np.nonzero(chosen)
                pieces = cells["pieces"][which]
                rows, which = np.repeat(rows, pieces), np.repeat(which, pieces)
                piece = np.arange(len(rows)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                yield pa.RecordBatch.from_arrays(
                    [part.column(i).take(pa.array(rows)) for i in range(4)]
                    + [pa.array(cells["cell"][which].astype(np.int64)), pa.array(piece.astype(np.int64))],
                    names=["query", "v", "p", "limit", "cell", "piece"])

    return queries.select("query", "v", "p", "limit").mapInArrow(run, VISIT)


def _nearest(x: np.ndarray, ids: np.ndarray, px: np.ndarray, visits: pd.DataFrame, k: int, quantile: float) -> list:
    """The k nearest of one piece for every visiting query, among the points that the stopping test leaves open."""
    squares = (x * x).sum(axis=1)
    out = []
    for start in range(0, len(visits), 128):
        part = visits.iloc[start:start + 128]
        q = np.frombuffer(b"".join(part["v"])).reshape(len(part), -1)
        pq = np.frombuffer(b"".join(part["p"])).reshape(len(part), -1)
        limits = part["limit"].to_numpy()
        own = (q * q).sum(axis=1)
        rough = own[:, None] + squares[None] - 2 * q @ x.T
        slack = 1e-11 * (own[:, None] + squares.max())
        projected = (pq * pq).sum(axis=1)[:, None] + (px * px).sum(axis=1)[None] - 2 * pq @ px.T
        open_ = projected <= quantile * (limits ** 2)[:, None] * (1 + 1e-9) + 1e-9
        open_ &= ids[None] != part["query"].to_numpy()[:, None]
        rough = np.where(open_, rough, np.inf)
        if rough.shape[1] > k:
            kth = np.partition(rough, k - 1, axis=1)[:, k - 1:k]
        else:
            kth = np.full((len(part), 1), np.inf)
        keep = open_ & (rough <= kth + slack)
        for row, query in enumerate(part["query"].to_numpy()):
            at = np.flatnonzero(keep[row])
            if len(at):
                exact = np.sqrt(((x[at] - q[row]) ** 2).sum(axis=1))
                best = np.lexsort((ids[at], exact))[:k]
                out.append(pd.DataFrame({"query": query, "id": ids[at][best], "score": exact[best]}))
    return out


def _verify(index: DataFrame, visits: DataFrame, k: int, quantile: float) -> DataFrame:
    blocks = visits.groupBy("cell", "piece").agg(F.ceil(F.count("*") / BLOCK_QUERIES).alias("blocks"))
    asked = visits.join(blocks, ["cell", "piece"]).withColumn("block", F.pmod(F.xxhash64("query"), F.col("blocks")))
    held = index.join(blocks, ["cell", "piece"]).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))

    def run(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(points) or not len(queries):
            return pd.DataFrame({"query": [], "id": [], "score": []}).astype({"query": "int64", "id": "int64"})
        points = points.sort_values("id")
        x = np.frombuffer(b"".join(points["v"])).reshape(len(points), -1)
        px = np.frombuffer(b"".join(points["p"])).reshape(len(points), -1)
        found = _nearest(x, points["id"].to_numpy(), px, queries, k, quantile)
        return pd.concat(found) if found else pd.DataFrame({"query": [], "id": [], "score": []}).astype(
            {"query": "int64", "id": "int64"})

    keys = ["cell", "piece", "block"]
    return held.select(*keys, "id", "v", "p").groupBy(*keys).cogroup(
        asked.select(*keys, "query", "v", "p", "limit").groupBy(*keys)).applyInPandas(run, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy("score", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(vectors: DataFrame, is_query: Column, k: int = 10, confidence: float = CONFIDENCE, key: str = "vec_id",
           column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows of every row for which ``is_query`` (over ``id``) holds."""
    index, cells = build(usable(vectors, key, column))
    names = [F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score"]
    if not cells:
        return _best(index.select(F.col("id").alias("query"), "id", F.lit(0.0).alias("score")).limit(0), k).select(*names)
    quantile = chi_square_quantile(confidence, DIRECTIONS)
    queries = index.where(is_query).select(F.col("id").alias("query"), "v", "p").withColumn("limit", F.lit(float("inf")))
    near = written(_verify(index, _visits(queries, cells, k, None), k, float("inf")), "near-cells")
    limits = _best(near, k).groupBy("query").agg(F.max("score").alias("limit"), F.count("*").alias("n"))
    limits = limits.select("query", F.when(F.col("n") < k, float("inf")).otherwise(F.col("limit")).alias("limit"))
    again = queries.drop("limit").join(limits, "query", "left").withColumn(
        "limit", F.coalesce("limit", F.lit(float("inf"))))
    rest = _verify(index, _visits(again, cells, k, quantile), k, quantile)
    return _best(near.unionByName(rest), k).select(*names)
