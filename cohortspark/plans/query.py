"""Query descriptions: table, joins, filters, grouping, HAVING, order and paging.

A description is a plain dict::

    {"table": "t1",
     "joins": [{"table": "t2", "on": {"type": "expr", "left_table": "t1", "left_field": "id",
                                      "right_table": "t2", "right_field": "id"}}],
     "selects": [{"type": "field", "value": "name"},
                 {"type": "agg_func", "func": "count", "field": "*", "alias": "n"}],
     "filters": {...}, "group_by": ["name"], "having": {...},
     "order_by": [["n", True]], "limit": 10, "offset": 0, "distinct": False}

``True`` in ``order_by`` means descending.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from cohortspark.functions.names import is_identifier
from cohortspark.operators.paging import page_of
from cohortspark.operators.predicates import filter_rows, leaf

_AGGREGATES = {"COUNT": F.count, "AVG": F.avg, "SUM": F.sum, "MIN": F.min, "MAX": F.max}
_HAVING_OPERATORS = ("=", "!=", "<>", "<", ">", "<=", ">=")


def auto_alias(func: str, field: str) -> str:
    """Name of an aggregate without alias: ``count_all``, ``avg_age``."""
    name = field.replace("*", "all")
    return f"{func.lower()}_{''.join(c if c.isalnum() else '_' for c in name)}"


def _identifier(name: object, what: str) -> str:
    if not is_identifier(name):
        raise ValueError(f"invalid {what}: {name!r}")
    return name


class _Scope:
    """The joined tables of one query and the columns their fields stand for."""

    def __init__(self, tables: Mapping[str, DataFrame], description: Mapping):
        names = [description["table"], *[j["table"] for j in description.get("joins") or []]]
        for name in names:
            _identifier(name, "table name")
            if name not in tables:
                raise ValueError(f"unknown table {name!r}")
        if len(set(names)) != len(names):
            raise ValueError("a table can be joined once only")
        self.schemas = {name: tables[name].schema for name in names}
        self.owner = description.get("field_table_map") or {}

    def column(self, table: str, field: str) -> Column:
        _identifier(field, "field name")
        if table not in self.schemas or field not in self.schemas[table].names:
            raise ValueError(f"unknown field {table}.{field}")
        return F.col(f"`{table}`.`{field}`")

    def table_of(self, field: str) -> str:
        _identifier(field, "field name")
        holders = [t for t, schema in self.schemas.items() if field in schema.names]
        wanted = self.owner.get(field)
        if wanted in holders:
            return wanted
        if not holders:
            raise ValueError(f"field {field!r} is in no table")
        if len(holders) > 1:
            raise ValueError(f"field {field!r} is in {holders}; name its table in field_table_map")
        return holders[0]

    def resolve(self, field: str) -> tuple[Column, T.DataType]:
        table = self.table_of(field)
        return self.column(table, field), self.schemas[table][field].dataType


def _joined(tables: Mapping[str, DataFrame], description: Mapping, scope: _Scope) -> DataFrame:
    first = description["table"]
    df = tables[first].alias(first)
    for join in description.get("joins") or []:
        on = join["on"]
        if on["type"] == "raw":
            if not on["value"]:
                raise ValueError("empty join condition")
            condition = F.expr(on["value"])
        else:
            left = scope.column(on["left_table"], on["left_field"])
            condition = left == scope.column(on["right_table"], on["right_field"])
        df = df.join(tables[join["table"]].alias(join["table"]), condition, "inner")
    return df


def _aggregate(func: str, field: str, scope: _Scope) -> Column:
    make = _AGGREGATES.get(str(func).upper())
    if make is None:
        raise ValueError(f"unsupported aggregate {func!r}")
    if field == "*":
        if make is not F.count:
            raise ValueError(f"{func}(*) is not defined")
        return F.count(F.lit(1))
    return make(scope.resolve(field)[0])


class _Having:
    """A HAVING tree over aggregate aliases; function leaves become hidden aggregates."""

    def __init__(self, scope: _Scope, outputs: set[str]):
        self.scope, self.outputs = scope, outputs
        self.hidden: dict[str, Column] = {}

    def condition(self, clause: Mapping) -> Column:
        if clause["type"] == "group":
            joiner = {"AND": and_, "OR": or_}.get(str(clause["operator"]).upper())
            if joiner is None:
                raise ValueError(f"unknown group operator {clause['operator']!r}")
            parts = [self.condition(item) for item in clause["items"]]
            return reduce(joiner, parts) if parts else F.lit(True)
        expr = clause["value"]
        if expr["operator"] not in _HAVING_OPERATORS:
            raise ValueError(f"unknown HAVING operator {expr['operator']!r}")
        left = expr["left"]
        if left["type"] == "alias":
            name = _identifier(left["value"], "alias")
            if name not in self.outputs:
                raise ValueError(f"HAVING alias {name!r} is not an output")
        else:
            name = f"_having_{auto_alias(left['func'], left['field'])}"
            self.hidden[name] = _aggregate(left["func"], left["field"], self.scope)
        value = expr["value"]
        item = {"field": name, "operator": expr["operator"], "value": value}
        data_type = T.StringType() if isinstance(value, str) else T.DoubleType()
        return leaf(item, lambda field: (F.col(f"`{field}`"), data_type))


def _checked_selects(description: Mapping) -> tuple[list[str], list[Mapping]]:
    fields, aggregates, aliases = [], [], set()
    for item in description.get("selects") or []:
        if item["type"] == "field":
            fields.append(_identifier(item["value"], "field name"))
            continue
        alias = item.get("alias")
        if not alias:
            raise ValueError(f"aggregate {item['func']!r} needs an alias")
        _identifier(alias, "alias")
        if alias in aliases:
            raise ValueError(f"duplicate alias {alias!r}")
        aliases.add(alias)
        aggregates.append(item)
    return fields, aggregates


def unpaged(tables: Mapping[str, DataFrame], description: Mapping) -> DataFrame:
    """Rows of a query before order, offset and limit."""
    scope = _Scope(tables, description)
    fields, aggregates = _checked_selects(description)
    group_by = [_identifier(f, "GROUP BY field") for f in description.get("group_by") or []]
    having = description.get("having")
    if aggregates and fields and not group_by:
        raise ValueError("GROUP BY is required when fields and aggregates are mixed")
    if group_by:
        missing = [f for f in fields if f not in group_by]
        if missing:
            raise ValueError(f"fields {missing} must appear in GROUP BY")
        if not fields and not aggregates:
            raise ValueError("a grouped query needs selects")

    df = _joined(tables, description, scope)
    if description.get("filters"):
        df = filter_rows(df, description["filters"], scope.resolve)

    if group_by or aggregates:
        outputs = {a["alias"]: _aggregate(a["func"], a["field"], scope) for a in aggregates}
        tree = _Having(scope, set(outputs) | set(group_by))
        condition = tree.condition(having) if having else None
        computed = [column.alias(name) for name, column in {**outputs, **tree.hidden}.items()]
        keys = [scope.resolve(f)[0].alias(f) for f in group_by]
        df = df.groupBy(*keys).agg(*computed) if computed else df.select(*keys).distinct()
        if condition is not None:
            df = df.filter(condition)
        order = [item["value"] if item["type"] == "field" else item["alias"] for item in description["selects"]]
        df = df.select(*[F.col(f"`{name}`") for name in order])
    elif having:
        raise ValueError("HAVING needs GROUP BY or aggregates")
    elif fields:
        df = df.select(*[scope.resolve(f)[0].alias(f) for f in fields])
    return df.dropDuplicates() if description.get("distinct") else df


def run(tables: Mapping[str, DataFrame], description: Mapping) -> DataFrame:
    """The rows a query description stands for, as one lazy DataFrame.

    Ascending and descending orders both put nulls last.
    """
    df = unpaged(tables, description)
    order = []
    for field, descending in description.get("order_by") or []:
        _identifier(field, "ORDER BY field")
        if field not in df.columns:
            raise ValueError(f"ORDER BY field {field!r} must be selected")
        order.append((field, bool(descending)))
    return page_of(df, order, description.get("offset") or 0, description.get("limit"))


def total(tables: Mapping[str, DataFrame], description: Mapping) -> DataFrame:
    """One row with the number of rows of the query, whatever its order, offset and limit."""
    return unpaged(tables, description).agg(F.count(F.lit(1)).alias("total"))
