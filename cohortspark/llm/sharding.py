"""Shards of near equal size by longest-processing-time scheduling: groups that must stay together go, from the largest
down, to the least loaded shard.

A group is all documents of one text. Groups of one size are alike to the schedule, so it sees how many groups there are
of every size, not the groups: one task streams these counts from the largest size down through a heap of shard loads.
Distinct sizes that add up to a table of B bytes are at most sqrt(2 B), and the task holds the loads only. Many groups of
one size are dealt in one step to the level that one after the other would reach. The groups of a size, by their smallest
doc_id, then take the shards chosen for it in ascending order.

Positions, of groups inside a size and of rows inside a shard, come from value ranges (``ordered.row_numbers``), so no size
and no shard is sorted in one task.

Defined results: a null text is empty and belongs to the empty texts; a size is the text's UTF-8 bytes plus ``OVERHEAD``;
repeated rows and rows without an id are rows like others, slots of equal ids follow the order of the input, no id comes
last; an empty table gives an empty result; a group larger than its share has its shard to itself as far as that helps.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortspark.llm.common import text_or_empty, written
from cohortspark.operators.ordered import row_numbers

SHARDS = 40
#: Bytes that a row takes besides its text.
OVERHEAD = 16
#: Rows of one size or one shard that one task may sort; more are cut into value ranges.
SORTED_ROWS = 4096


def level_fill(loads: np.ndarray, size: int, count: int) -> np.ndarray:
    """How many of ``count`` items of one size every shard gets if each goes to the least loaded, the first of equals."""
    low, high = int(loads.min()), int(loads.max()) + size * (count + 1)
    while high - low > 1:  # the highest level below which no more than count items begin
        level = (low + high) // 2
        if int(np.maximum(0, -((loads - level) // size)).sum()) <= count:
            low = level
        else:
            high = level
    dealt = np.maximum(0, -((loads - low) // size))
    at_level = np.flatnonzero(loads + dealt * size == low)
    dealt[at_level[:count - int(dealt.sum())]] += 1
    return dealt


class Schedule:
    """Shard loads in a heap; sizes come from the largest down."""

    def __init__(self, shards: int) -> None:
        self.heap = [(0, shard) for shard in range(shards)]

    def deal(self, size: int, count: int) -> np.ndarray:
        """How many of ``count`` groups of ``size`` each shard gets."""
        dealt = np.zeros(len(self.heap), np.int64)
        if count <= 4 * len(self.heap):
            for _ in range(count):
                load, shard = self.heap[0]
                heapq.heapreplace(self.heap, (load + size, shard))
                dealt[shard] += 1
            return dealt
        loads = np.zeros(len(self.heap), np.int64)
        for load, shard in self.heap:
            loads[shard] = load
        dealt = level_fill(loads, size, count)
        self.heap = [(int(load), shard) for shard, load in enumerate(loads + dealt * size)]
        heapq.heapify(self.heap)
        return dealt


def schedule(classes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """For (group_size, n): group_size, shard, until: the shards a size takes, ascending, and how many of its groups have
    been dealt when each has its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Schedule(shards)
        for batch in batches:
            sizes, taken, until = batch.column(0), [], []
            for size, count in zip(sizes.to_pylist(), batch.column(1).to_pylist(), strict=True):
                dealt = plan.deal(size, count)
                used = np.flatnonzero(dealt)
                taken.append(used.astype(np.int32))
                until.append(np.cumsum(dealt[used]))
            yield pa.RecordBatch.from_arrays(
                [sizes, pa.array(taken, pa.list_(pa.int32())), pa.array(until, pa.list_(pa.int64()))],
                names=["group_size", "shards", "until"])

    one = classes.select("group_size", "n").repartition(1).sortWithinPartitions(F.desc("group_size"))
    return one.mapInArrow(run, "group_size long, shards array<int>, until array<long>")


def shard(docs: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD, sorted_rows: int = SORTED_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row of ``docs`` (doc_id, text): slots count from 0 in each shard."""
    text = text_or_empty("text").cast("string")
    rows = written(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"),
        (F.octet_length(text).cast("long") + overhead).alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.unhex(F.md5(F.encode(text, "utf-8"))).alias("group")), "shard-rows")
    groups = rows.groupBy("group").agg(
        F.sum("size").alias("group_size"), F.min("doc_id").alias("first"), F.min("row").alias("row"))
    groups = written(groups, "shard-groups")
    plan = written(schedule(groups.groupBy("group_size").agg(F.count("*").alias("n")), shards), "shard-plan")
    placed = row_numbers(groups, ["group_size"], [("first", False), ("row", False)], "place", sorted_rows)
    plan = plan.withColumnRenamed("group_size", "_size")
    placed = placed.join(plan, F.col("group_size") == F.col("_size")).select(
        F.col("group").alias("_group"),
        F.get("shards", F.size(F.filter("until", lambda u: u < F.col("place")))).alias("shard"))
    met = rows.join(written(placed, "shard-places"), F.col("group") == F.col("_group"))
    met = written(met.select("row", "doc_id", "size", "text_crc32", "shard"), "shard-members")
    numbered = row_numbers(met, ["shard"], [("doc_id", False), ("row", False)], "slot", sorted_rows)
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("slot") - 1).alias("slot"))
