"""Column-name rules."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

# Fixed value: the shape of names allowed in query descriptions.
IDENTIFIER = re.compile(r"[a-zA-Z_][a-zA-Z0-9_]*")


def is_identifier(name: object) -> bool:
    return isinstance(name, str) and IDENTIFIER.fullmatch(name) is not None


def normalize_name(name: str, lower: bool = True) -> str:
    """``Gene-Name (years)`` -> ``gene_name__years_``; a name never starts with a digit."""
    cleaned = re.sub(r"\W", "_", name.strip())
    if not (cleaned[:1] == "_" or (cleaned[:1].isascii() and cleaned[:1].isalpha())):
        cleaned = f"_{cleaned}"
    return cleaned.lower() if lower else cleaned


def select_positions(df: DataFrame, wanted: list[tuple[int, str]]) -> DataFrame:
    """Select columns by position under new names, so that clashing names never get resolved."""
    by_position = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return by_position.select(*[F.col(f"_c{i}").alias(name) for i, name in wanted])


def normalize_columns(df: DataFrame, lower: bool = True) -> DataFrame:
    """Normalise every column name; of several equal names only the first column stays.

    Names that differ in case only are different columns. Where the session ignores case, the
    later ones get their position appended, so that none is lost.
    """
    return drop_duplicate_columns(df, lambda name: normalize_name(name, lower))


def drop_duplicate_columns(df: DataFrame, rename=lambda name: name) -> DataFrame:
    """Keep the first column of each (renamed) name."""
    case_sensitive = df.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    seen: set[str] = set()
    taken: set[str] = set()
    wanted = []
    for position, original in enumerate(df.columns):
        name = rename(original)
        if name in seen:
            continue
        seen.add(name)
        key = name if case_sensitive else name.lower()
        if key in taken:
            name, key = f"{name}_{position}", f"{key}_{position}"
        taken.add(key)
        wanted.append((position, name))
    return select_positions(df, wanted)


def keep_expected(df: DataFrame, expected: list[str]) -> DataFrame:
    """Only the expected columns, in table order; unknown expected names are ignored."""
    return df.select(*[c for c in df.columns if c in set(expected)])


def default_columns(dictionary: DataFrame, max_order: int = 5, limit: int = 6) -> DataFrame:
    """Keys of the fields shown first: order up to ``max_order``, the first ``limit`` by position."""
    return (
        dictionary.filter(F.col("order") <= max_order)
        .orderBy("position")
        .limit(limit)
        .select("key")
    )
