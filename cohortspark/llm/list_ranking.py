"""Prefix sums along linked lists that are spread over a cluster.

Every round throws a coin per element, by hash. An element that shows heads and follows one that shows tails leaves the
list: the one before takes over its link and its weights. No two neighbours leave at once, about a quarter goes per round,
so all rounds together move about four times the list. When few enough elements are left, one task walks them; then the
rounds are undone in reverse, each element getting the sum of the one it had left to, plus that one's weights at the time.
Links are joined by id, and both sides have every id once at most, so there are no hot keys. Rounds are written to the
shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cohortspark.llm.common import written

#: Elements that one task walks at the end.
WALKED = 100_000


def walk(ids: np.ndarray, following: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sums of weights (a row each) of the elements before every element; ``following``: their ids, -1 at an end."""
    order = np.argsort(ids)
    place = order[np.minimum(np.searchsorted(ids, following, sorter=order), len(ids) - 1)]
    to = np.where((following >= 0) & (ids[place] == following), place, -1)
    begins = np.ones(len(ids), bool)
    begins[to[to >= 0]] = False
    path, starts, steps = [], [], to.tolist()
    for at in np.flatnonzero(begins).tolist():
        starts.append(len(path))
        while at >= 0:
            path.append(at)
            at = steps[at]
    path = np.array(path, np.int64)
    sums = np.cumsum(weights[path], axis=0) - weights[path]
    starts = np.array(starts, np.int64)
    sums -= np.repeat(sums[starts], np.diff(np.append(starts, len(path))), axis=0)
    out = np.zeros_like(weights)
    out[path] = sums
    return out


def _walked(links: DataFrame, weights: Sequence[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if len(b)]) else None
        if held is None:
            return
        ids, following = held["id"].to_numpy(), held["next"].fill_null(-1).to_numpy()
        sums = walk(ids, following, np.stack([held[w].to_numpy() for w in weights], axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(s) for s in sums.T.copy())], names=["id", *weights])

    return links.select("id", "next", *weights).repartition(1).mapInArrow(
        run, ", ".join(["id long", *(f"{w} long" for w in weights)]))


def prefix_sums(links: DataFrame, weights: Sequence[str], walked: int = WALKED) -> DataFrame:
    """``id`` and, per name in ``weights``, the sum of that column over all elements before it in its list.

    ``links`` has ``id`` (0 or more, unique), ``next`` (the id that follows, null at an end) and the weights (long). Lists
    have no cycles.
    """
    links = written(links.select("id", "next", *weights), "list")
    rounds: list[DataFrame] = []
    while links.count() > walked:
        def coin(c: Column, number: int = len(rounds)) -> Column:
            return F.pmod(F.xxhash64(F.lit(number), c), F.lit(2)) == 1

        heads = links.where(coin(F.col("id")))
        tails = links.where(~coin(F.col("id")))
        joins = F.col("next").isNotNull() & coin(F.col("next"))  # a hash of null is a number, too
        into = tails.where(joins).select(F.col("id").alias("_id"), F.col("next").alias("_next"),
                                         *[F.col(w).alias(f"_{w}") for w in weights])
        met = heads.join(into, F.col("id") == F.col("_next"), "left").select(
            F.coalesce("_id", "id").alias("id"), "next", *[(F.coalesce(f"_{w}", F.lit(0)) + F.col(w)).alias(w) for w in weights],
            F.when(F.col("_id").isNotNull(), F.col("id")).alias("gone"), *[F.col(f"_{w}") for w in weights])
        stay = tails.where(~joins).select(
            "id", "next", *weights, F.lit(None).cast("long").alias("gone"),
            *[F.lit(None).cast("long").alias(f"_{w}") for w in weights])
        rounds.append(written(met.unionByName(stay), "list-round"))
        links = rounds[-1].select("id", "next", *weights)
    known = written(_walked(links, weights), "list-sums")
    for number, done in reversed(list(enumerate(rounds))):
        left = done.where("gone IS NOT NULL").select(F.col("id").alias("_to"), "gone", *[f"_{w}" for w in weights])
        back = left.join(known, F.col("_to") == F.col("id")).select(
            F.col("gone").alias("id"), *[(F.col(w) + F.col(f"_{w}")).alias(w) for w in weights])
        known = known.unionByName(back)
        known = written(known, "list-sums") if number else known
    return known
