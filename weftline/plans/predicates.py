"""Predicates of filters and conditions as Columns.

A leaf is ``{input, operator, value}``; ``all``, ``any`` and ``not`` combine. Equality is null-safe and
strict about types: a number never equals a text. Order comparisons with null keep no row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, MapType, NumericType, StringType

from .expressions import Scope, Typed, literal

COMBINERS = ("all", "any", "not")


def family(kind: DataType) -> str:
    """Types of one family can be equal."""
    if isinstance(kind, BooleanType) or isinstance(kind, NumericType):
        return "number"
    return "text" if isinstance(kind, StringType) else kind.simpleString()


def equal(a: Typed, b: Typed) -> Column:
    """Null-safe equality; values of different families are equal only if both are null."""
    if family(a.kind) != family(b.kind):
        return a.column.isNull() & b.column.isNull()
    if isinstance(a.kind, BooleanType) != isinstance(b.kind, BooleanType):
        return a.column.cast("double").eqNullSafe(b.column.cast("double"))
    return a.column.eqNullSafe(b.column)


def contains(a: Typed, b: Typed) -> Column:
    """``a in b``: substring of a text, element of a list, key of a map."""
    if isinstance(b.kind, StringType):
        return F.coalesce(F.contains(b.column, a.column.cast("string")), F.lit(False))
    if isinstance(b.kind, ArrayType):
        if family(a.kind) != family(b.kind.elementType):
            return F.lit(False)
        return F.coalesce(F.exists(b.column, lambda x: x.eqNullSafe(a.column)), F.lit(False))
    if isinstance(b.kind, MapType):
        return F.coalesce(F.map_contains_key(b.column, a.column), F.lit(False))
    raise TypeError(f"nothing is in {b.kind.simpleString()}")


OPERATORS: dict[str, Callable[[Typed, Typed], Column]] = {
    "eq": equal,
    "neq": lambda a, b: ~equal(a, b),
    "gt": lambda a, b: a.column > b.column,
    "gte": lambda a, b: a.column >= b.column,
    "lt": lambda a, b: a.column < b.column,
    "lte": lambda a, b: a.column <= b.column,
    "in": contains,
    "not-in": lambda a, b: ~contains(a, b),
    "starts-with": lambda a, b: F.startswith(a.column, b.column),
    "ends-with": lambda a, b: F.endswith(a.column, b.column),
    "match": lambda a, b: F.rlike(a.column, F.concat(F.lit("^(?:"), b.column, F.lit(")"))),
}


def predicate(node: Mapping[str, Any] | None, compile_: Callable[[Any], Typed]) -> Column:
    """The Column of a condition; ``compile_`` turns templates into values. No condition is true."""
    if node is None:
        return F.lit(True)
    used = [k for k in COMBINERS if k in node]
    if len(used) > 1 or (used and "operator" in node):
        raise ValueError(f"one of all, any, not or an operator is needed: {sorted(node)}")
    if used == ["all"]:
        return reduce(lambda a, b: a & b, [predicate(x, compile_) for x in node["all"]], F.lit(True))
    if used == ["any"]:
        return reduce(lambda a, b: a | b, [predicate(x, compile_) for x in node["any"]], F.lit(False))
    if used == ["not"]:
        return ~F.coalesce(predicate(node["not"], compile_), F.lit(False))
    if "input" not in node and "value" not in node:
        raise ValueError("a condition needs input or value")
    name = node.get("operator", "eq")
    if name not in OPERATORS:
        raise ValueError(f"unknown operator {name!r}")
    value = node.get("value")
    right = compile_(value) if not isinstance(value, (list, tuple)) or _has_expression(value) else literal(value)
    return OPERATORS[name](compile_(node.get("input")), right)


def _has_expression(value: Any) -> bool:
    if isinstance(value, (list, tuple)):
        return any(map(_has_expression, value))
    return isinstance(value, str) and "${" in value


def status_matches(code: Column, pattern: str | int | Sequence[str | int]) -> Column:
    """Whether a status code fits one of the patterns: three digits, where x stands for any. Null fits none."""
    patterns = [pattern] if isinstance(pattern, (str, int)) else list(pattern)
    parts = [p.strip().lower() for x in patterns for p in str(x).split(",")]
    if any(len(p) != 3 or not set(p) <= set("0123456789x") for p in parts):
        raise ValueError(f"can't read status patterns {patterns}")
    return F.coalesce(F.rlike(code.cast("string"), F.lit("^(" + "|".join(p.replace("x", "[0-9]") for p in parts) + ")$")), F.lit(False))


def field_conditions(spec: Any, scope: Scope) -> Column:
    """Metadata filters: ``{field: value}``, ``{field: {operator: value}}`` or a list of
    ``{field, operator, value}``; all must hold."""
    if not spec:
        return F.lit(True)
    rows = spec if isinstance(spec, list) else [{"field": k, "operator": op, "value": v} for k, x in spec.items() for op, v in (x.items() if isinstance(x, Mapping) else [("eq", x)])]
    none = Typed(F.lit(None).cast("string"), StringType())
    found = [OPERATORS[r.get("operator", "eq")](scope.names.get(r["field"], none), literal(r["value"])) for r in rows]
    return reduce(lambda a, b: a & b, found, F.lit(True))
