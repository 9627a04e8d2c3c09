"""Expressions ``${source.path as type | default}`` compiled to Columns.

A text that is one expression keeps its type; expressions inside other text are written out, null as
nothing. Paths never fail: what is missing is null. A default replaces null only, and a cast comes
after it. Parsing happens once, when a plan is built; rows are never interpreted.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass, field as dc_field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, LongType, StringType, StructField, StructType

from ..functions import casts


@dataclass(frozen=True)
class Typed:
    """A Column with the type that it will have."""

    column: Column
    kind: DataType


@dataclass(frozen=True)
class Step:
    """A step of a path: a key, an index, a slice or all elements."""

    key: str | None = None
    index: int | None = None
    cut: tuple[int | None, int | None] | None = None
    every: bool = False


@dataclass(frozen=True)
class Reference:
    """A parsed expression."""

    source: str
    path: tuple[Step, ...] = ()
    token: str | None = None
    subtype: str | None = None
    default: str | None = None


@dataclass
class Scope:
    """What names stand for while a plan is built."""

    names: dict[str, Typed] = dc_field(default_factory=dict)

    def child(self, **more: Typed) -> Scope:
        return Scope(self.names | more)

    @staticmethod
    def of(df: DataFrame, params: Mapping[str, Any] | None = None, index: Column | None = None) -> Scope:
        """``item`` (and ``result``, ``output``): the row; each column by its name; ``input``: parameters."""
        row = Typed(F.struct(*[F.col(f"`{c}`") for c in df.columns]), df.schema)
        names = {f.name: Typed(F.col(f"`{f.name}`"), f.dataType) for f in df.schema}
        names |= {"item": row, "result": row, "output": row}
        if params is not None:
            names["input"] = literal(dict(params))
        if index is not None:
            names["index"] = Typed(index, LongType())
        return Scope(names)


_REFERENCE = re.compile(r"\$\{((?:[^{}]|\{[^{}]*\})*)\}")
_HEAD = re.compile(r"\s*([A-Za-z_][\w-]*)")
_STEP = re.compile(r"\.([A-Za-z_][\w-]*)|\[\s*(\*)\s*\]|\[\s*(-?\d*)\s*:\s*(-?\d*)\s*\]|\[\s*(-?\d+)\s*\]")
_CAST = re.compile(r"\s+as\s+([a-z0-9]+(?:\[\])?)(?:/([^;|@\[]+))?(?:\[[^\]]*\])?(?:;[a-z0-9-]+)?")


def parse(text: str) -> Reference:
    """The inside of ``${...}``."""
    head = _HEAD.match(text)
    if head is None:
        raise ValueError(f"no source in ${{{text}}}")
    at, path = head.end(), []
    while step := _STEP.match(text, at):
        at = step.end()
        if step[1]:
            path.append(Step(key=step[1]))
        elif step[2]:
            path.append(Step(every=True))
        elif step[5] is not None:
            path.append(Step(index=int(step[5])))
        else:
            path.append(Step(cut=(int(step[3]) if step[3] else None, int(step[4]) if step[4] else None)))
    token = subtype = default = None
    if found := _CAST.match(text, at):
        token, subtype, at = found[1], found[2].strip() if found[2] else None, found.end()
    rest = text[at:].strip()
    if rest.startswith("|"):
        default = re.sub(r"\s*@\(.*\)\s*$", "", rest[1:]).strip()
        rest = ""
    if rest and not rest.startswith("@"):
        raise ValueError(f"can't read {rest!r} in ${{{text}}}")
    return Reference(head[1], tuple(path), token, subtype, default)


def literal(value: Any) -> Typed:
    """A Python value as a literal Column."""
    if isinstance(value, bool):
        return Typed(F.lit(value), BooleanType())
    if isinstance(value, int):
        return Typed(F.lit(value).cast("bigint"), LongType())
    if isinstance(value, float):
        return Typed(F.lit(value), DoubleType())
    if value is None or isinstance(value, str):
        return Typed(F.lit(value).cast("string"), StringType())
    if isinstance(value, Mapping):
        parts = {k: literal(v) for k, v in value.items()}
        return struct_of(parts)
    if isinstance(value, (list, tuple)):
        return array_of([literal(v) for v in value])
    raise TypeError(f"no literal of {type(value).__name__}")


def struct_of(parts: Mapping[str, Typed]) -> Typed:
    """A struct column of named parts."""
    return Typed(F.struct(*[v.column.alias(k) for k, v in parts.items()]), StructType([StructField(k, v.kind) for k, v in parts.items()]))


def array_of(parts: list[Typed]) -> Typed:
    """An array column; parts of different types become text."""
    if not parts:
        return Typed(F.array().cast("array<string>"), ArrayType(StringType()))
    kinds = {p.kind.simpleString() for p in parts}
    if len(kinds) > 1:
        parts = [Typed(casts.to_text(p.column, p.kind), StringType()) for p in parts]
    return Typed(F.array(*[p.column for p in parts]), ArrayType(parts[0].kind))


def walk(value: Typed, path: tuple[Step, ...]) -> Typed:
    """Follows a path; a miss, a wrong container or an index out of range is null."""
    for k, step in enumerate(path):
        c, kind = value.column, value.kind
        if step.key is not None:
            value = Typed(*casts.field(c, kind, step.key))
        elif not isinstance(kind, ArrayType):
            return Typed(F.lit(None).cast("string"), StringType())
        elif step.every:
            inner = walk(Typed(F.lit(None).cast(kind.elementType), kind.elementType), path[k + 1 :]).kind
            return Typed(F.transform(c, lambda x: walk(Typed(x, kind.elementType), path[k + 1 :]).column), ArrayType(inner))
        elif step.index is not None:
            value = Typed(F.try_element_at(c, F.lit(step.index + 1 if step.index >= 0 else step.index)), kind.elementType)
        else:
            n = F.size(c)
            place = lambda v, n=n: F.least(F.lit(v), n) if v >= 0 else F.greatest(n + v, F.lit(0))
            low, high = (place(v) if v is not None else d for v, d in zip(step.cut, (F.lit(0), n), strict=True))
            value = Typed(F.slice(c, low + 1, F.greatest(high - low, F.lit(0))), kind)
    return value


def _default(text: str, kind: DataType) -> Typed:
    try:
        value = json.loads(text)
    except ValueError:
        value = text
    if isinstance(value, (list, dict)):
        return literal(value)
    return Typed(F.lit(text if isinstance(kind, StringType) else value).cast(kind), kind)


def resolve(ref: Reference, scope: Scope) -> Typed:
    """The Column of a reference; unknown sources are null."""
    value = scope.names.get(ref.source)
    value = walk(value, ref.path) if value is not None else Typed(F.lit(None).cast("string"), StringType())
    if ref.default is not None:
        other = _default(ref.default, value.kind)
        value = Typed(F.coalesce(value.column, other.column), value.kind)
    if ref.token is not None:
        value = Typed(*casts.cast(value.column, value.kind, ref.token, ref.subtype))
    return value


def text_template(text: str, scope: Scope) -> Typed:
    """A text with expressions."""
    found = list(_REFERENCE.finditer(text))
    if not found:
        return literal(text)
    if len(found) == 1 and found[0].span() == (0, len(text)):
        return resolve(parse(found[0][1]), scope)
    parts, at = [], 0
    for m in found:
        if m.start() > at:
            parts.append(F.lit(text[at : m.start()]))
        value = resolve(parse(m[1]), scope)
        parts.append(F.coalesce(casts.to_text(value.column, value.kind), F.lit("")))
        at = m.end()
    if at < len(text):
        parts.append(F.lit(text[at:]))
    return Typed(F.concat(*parts), StringType())


def references(template: Any) -> set[str]:
    """Sources that a template names, with the first key of their path: what a plan has to read."""
    if isinstance(template, str):
        found = [parse(m[1]) for m in _REFERENCE.finditer(template)]
        return {r.source + (f".{r.path[0].key}" if r.path and r.path[0].key else "") for r in found}
    if isinstance(template, Mapping):
        return set().union(*map(references, template.values())) if template else set()
    if isinstance(template, (list, tuple)):
        return set().union(*map(references, template)) if template else set()
    return set()
