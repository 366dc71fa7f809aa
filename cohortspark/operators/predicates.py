"""Filter trees as Columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_, eq, ge, gt, le, lt, ne, or_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from cohortspark.functions.similarity import SIMILAR_AT, is_similar
from cohortspark.operators.text_index import TextIndex
from cohortspark.session import written

# Operators allowed for each kind of literal.
ALLOWED = {
    "number": ("=", "!=", ">", "<", "<=", ">="),
    "string": ("=", "!=", "like", "not like", "ilike", "<>", "%"),
    "bool": ("=", "!="),
    "null": ("is", "is not"),
    "list": ("in", "not in"),
}

#: Longer ``in`` and ``not in`` lists are joined as a table of values; the rows are the same either way.
MANY_VALUES = 1000

_COMPARE = {"=": eq, "!=": ne, "<>": ne, "<": lt, ">": gt, "<=": le, ">=": ge}

#: Gives the Column and type of a field name.
Resolver = Callable[[str], tuple[Column, T.DataType]]


def columns_of(df: DataFrame) -> Resolver:
    def resolve(field: str) -> tuple[Column, T.DataType]:
        if field not in df.columns:
            raise ValueError(f"unknown field {field!r}")
        return F.col(f"`{field}`"), df.schema[field].dataType

    return resolve


def literal_kind(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    if isinstance(value, (list, tuple)):
        kinds = {literal_kind(v) for v in value}
        if len(kinds) <= 1 and kinds <= {"bool", "number", "string"}:
            return "list"
    raise ValueError(f"unsupported literal {value!r}")


def typed_literal(value: object, data_type: T.DataType) -> Column:
    """A literal comparable with a column of the given type.

    Number against number stays as it is, since casting 2.5 to an int column would change it.
    """
    literal = F.lit(value)
    is_number = literal_kind(value) == "number"
    if is_number and isinstance(data_type, T.NumericType):
        return literal
    if isinstance(value, str) and isinstance(data_type, T.StringType):
        return literal
    return literal.cast(data_type)


def _like_pattern(pattern: str) -> str:
    # the pattern language has no escape character, Spark's has a backslash
    return pattern.replace("\\", "\\\\")


def leaf(item: Mapping, resolve: Resolver, members: Mapping[int, Column] | None = None) -> Column:
    """One comparison ``{field, operator, value}``; ``members`` has the membership of long lists by their leaf."""
    value, op = item["value"], str(item["operator"]).lower()
    kind = literal_kind(value)
    if op not in ALLOWED[kind]:
        raise ValueError(f"operator {item['operator']!r} does not take {value!r}")
    column, data_type = resolve(item["field"])
    if kind == "null":
        return column.isNull() if op == "is" else column.isNotNull()
    if kind == "list":
        if not value:
            return F.lit(op == "not in")
        if members and id(item) in members:
            member = F.when(column.isNotNull(), members[id(item)])
        else:
            member = column.isin([typed_literal(v, data_type) for v in value])
        return member if op == "in" else ~member
    if op in _COMPARE:
        return _COMPARE[op](column, typed_literal(value, data_type))
    text = column.cast("string")
    if op == "%":
        return is_similar(text, F.lit(value))
    if op == "ilike":
        return text.ilike(_like_pattern(value))
    matched = text.like(_like_pattern(value))
    return matched if op == "like" else ~matched


def predicate(tree: Mapping | None, resolve: Resolver, members: Mapping[int, Column] | None = None) -> Column:
    """A whole tree of ``{operator: and|or, items: [...]}`` and leaves; an empty tree is true."""
    if not tree:
        return F.lit(True)
    if "items" not in tree:
        return leaf(tree, resolve, members)
    joiner = {"and": and_, "or": or_}.get(str(tree["operator"]).lower())
    if joiner is None:
        raise ValueError(f"unknown group operator {tree['operator']!r}")
    parts = [predicate(item, resolve, members) for item in tree["items"]]
    return reduce(joiner, parts) if parts else F.lit(True)


def text_pairs(tree: Mapping | None) -> list[tuple[str, str]]:
    """Distinct (field, text) pairs of a tree in reading order."""
    if not tree:
        return []
    if "items" in tree:
        found = [pair for item in tree["items"] for pair in text_pairs(item)]
    else:
        found = [(tree["field"], tree["value"])] if isinstance(tree["value"], str) else []
    return list(dict.fromkeys(found))


def _is_long_list(tree: Mapping) -> bool:
    return "items" not in tree and isinstance(tree["value"], (list, tuple)) and len(tree["value"]) > MANY_VALUES


def _long_lists(tree: Mapping | None) -> list[Mapping]:
    """All long ``in`` and ``not in`` leaves of a tree."""
    if not tree:
        return []
    if "items" in tree:
        return [found for item in tree["items"] for found in _long_lists(item)]
    return [tree] if _is_long_list(tree) else []


def _value_table(df: DataFrame, values: Sequence, data_type: T.DataType) -> DataFrame:
    """The distinct values of a list, each made comparable as ``typed_literal`` makes a single one."""
    literal_kind(list(values))
    numeric = isinstance(data_type, T.NumericType)
    if numeric and any(isinstance(v, float) for v in values):
        values = [float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in values]
    tables = []
    for kind in (bool, int, float, str):
        own = sorted({v for v in values if type(v) is kind})
        if own:
            table = df.sparkSession.createDataFrame([(v,) for v in own], ["_value"])
            keep = (numeric and kind in (int, float)) or (kind is str and isinstance(data_type, T.StringType))
            tables.append(table if keep else table.select(F.col("_value").cast(data_type).alias("_value")))
    return reduce(DataFrame.unionByName, tables).distinct()


def filter_rows(df: DataFrame, tree: Mapping | None, resolve: Resolver,
                indexes: Mapping[str, tuple[str, TextIndex]] | None = None) -> DataFrame:
    """Rows that satisfy a tree. Long value lists are joined instead of spelled out: an ``in`` that every row must meet as
    a semi join, any other as a mark that the tree then asks for. ``indexes`` has, by field, the key column and the index
    of its texts; a ``%`` that every row must meet then meets the keys that the index finds."""
    if not tree:
        return df
    required = [tree] if "items" not in tree else (
        tree["items"] if str(tree["operator"]).lower() == "and" else [])
    for item in required:
        if "items" not in item and str(item["operator"]) == "%" and item["field"] in (indexes or {}):
            key, index = indexes[item["field"]]
            found = index.similar(item["value"], SIMILAR_AT).select(F.col("key").alias("_similar"))
            df = df.join(written(found, "similar"), resolve(key)[0] == F.col("_similar"), "left_semi")
    joined = [i for i in required if "items" not in i and _is_long_list(i) and str(i["operator"]).lower() == "in"]
    members: dict[int, Column] = {}
    marks = []
    for number, item in enumerate(_long_lists(tree)):
        column, data_type = resolve(item["field"])
        values = _value_table(df, item["value"], data_type)
        if any(item is j for j in joined):
            df = df.join(values, column == F.col("_value"), "left_semi")
            members[id(item)] = F.lit(True)
        else:
            mark = f"_member_{number}"
            table = values.select(F.col("_value").alias(f"_value_{number}"), F.lit(True).alias(mark))
            df = df.join(table, column == F.col(f"_value_{number}"), "left")
            members[id(item)] = F.coalesce(F.col(mark), F.lit(False))
            marks += [mark, f"_value_{number}"]
    return df.filter(predicate(tree, resolve, members)).drop(*marks)


def apply_filter(df: DataFrame, tree: Mapping | None, indexes: Mapping[str, tuple[str, TextIndex]] | None = None) -> DataFrame:
    return filter_rows(df, tree, columns_of(df), indexes)
