"""Ranking rows by text similarity, and catalogue search."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from cohortspark.functions.similarity import similarity, trim_query
from cohortspark.operators.predicates import text_pairs
from cohortspark.operators.text_index import TextIndex
from cohortspark.session import written


def rank_by_similarity(
    df: DataFrame,
    pairs: Sequence[tuple[str, str]],
    first_pairs: int = 0,
    limit: int | None = None,
    tie: Sequence[str] = (),
    indexes: Mapping[str, tuple[str, TextIndex]] | None = None,
) -> DataFrame:
    """Rows most similar to the query texts first, one score column per (field, text) pair.

    Of the pairs the first ``first_pairs`` count, 0 meaning all; texts are trimmed of special
    characters. With ``limit`` every task keeps only its own best rows. ``indexes`` has, by field, the key column and the
    index of its texts: with a limit, only rows that the index of the first field finds are then scored. The rows are the
    same; where fewer than ``limit`` share a trigram with the first text, all are scored.
    """
    used = list(pairs)[:first_pairs] if first_pairs else list(pairs)
    if used and limit and used[0][0] in (indexes or {}):
        key, index = indexes[used[0][0]]
        best = index.best(trim_query(used[0][1]), limit)
        if best is not None:
            df = df.join(written(best.select(F.col("key").alias("_key")), "most-similar"), F.col(key) == F.col("_key"), "left_semi")
    scores = {
        f"similarity_{i}": similarity(F.col(field).cast("string"), F.lit(trim_query(text)))
        for i, (field, text) in enumerate(used)
    }
    scored = df.withColumns(scores) if scores else df
    order = [F.col(name).desc_nulls_last() for name in scores] + [F.col(t).asc_nulls_last() for t in tie]
    if order:
        scored = scored.orderBy(*order)
    return scored if limit is None else scored.limit(limit)


def rank_by_filter(df: DataFrame, tree: Mapping, first_pairs: int = 0, **options) -> DataFrame:
    """The same with the text pairs of a filter tree."""
    return rank_by_similarity(df, text_pairs(tree), first_pairs, **options)


def search_catalog(
    catalog: DataFrame,
    name: str = "",
    tag: str | None = None,
    order_by: str = "name",
    descending: bool = False,
) -> DataFrame:
    """Datasets whose name holds a text in any case, optionally with one tag, ordered.

    ``No tags`` stands for datasets without tags.
    """
    if order_by not in ("name", "total"):
        raise ValueError("order_by must be name or total")
    out = catalog
    if name:
        out = out.filter(F.lower("name").contains(name.lower()))
    if tag == "No tags":
        out = out.filter(F.coalesce(F.size("tags"), F.lit(0)) <= 0)
    elif tag is not None and tag != "All":
        out = out.filter(F.array_contains("tags", tag))
    column = F.col(order_by)
    return out.orderBy(column.desc_nulls_last() if descending else column.asc_nulls_last(), "key", "version")
