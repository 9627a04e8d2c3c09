"""Structural templates: dicts, lists, spread, map, split, concatenation and case.

``{"*": source, key: template}`` maps a list, ``{"|": source, key: template}`` splits it into parallel
lists, ``{"+": parts}`` concatenates, ``{"?": conditions}`` chooses, ``"..."`` spreads.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, MapType, StringType, StructType

from ..functions import casts
from .expressions import Scope, Typed, array_of, literal, struct_of, text_template
from .predicates import predicate

SPREAD = "..."


def compile_template(template: Any, scope: Scope) -> Typed:
    """The Column of a template."""
    if isinstance(template, str):
        return text_template(template, scope)
    if isinstance(template, Mapping):
        if set(template) == {"?"}:
            return case(template["?"], scope)
        if set(template) == {"+"}:
            return concatenate(template["+"], scope)
        if "*" in template:
            return map_list(template, scope)
        if "|" in template:
            return split_list(template, scope)
        return dict_template(template, scope)
    if isinstance(template, (list, tuple)):
        return list_template(list(template), scope)
    return literal(template)


def _fields(value: Typed) -> dict[str, Typed]:
    if not isinstance(value.kind, StructType):
        raise TypeError(f"only objects can be spread, not {value.kind.simpleString()}")
    return {f.name: Typed(value.column[f.name], f.dataType) for f in value.kind}


def dict_parts(template: Mapping[str, Any], scope: Scope) -> dict[str, Typed]:
    """Named parts of a dict template; later keys win over earlier and spread ones."""
    out: dict[str, Typed] = {}
    for key, inner in template.items():
        if key == SPREAD or key == "?":
            for k, v in _fields(compile_template(inner, scope) if key == SPREAD else case(inner, scope)).items():
                out.pop(k, None)
                out[k] = v
        else:
            out.pop(key, None)
            out[key] = compile_template(inner, scope)
    return out


def dict_template(template: Mapping[str, Any], scope: Scope) -> Typed:
    """A struct of a dict template."""
    return struct_of(dict_parts(template, scope))


def list_template(template: list[Any], scope: Scope) -> Typed:
    """A list; texts ``...${x}`` spread a list, null spreads nothing."""
    groups: list[Typed] = []
    plain: list[Typed] = []
    for x in template:
        if isinstance(x, str) and x.startswith(SPREAD + "${"):
            value = text_template(x[len(SPREAD) :], scope)
            if not isinstance(value.kind, ArrayType):
                raise TypeError(f"only lists can be spread into a list, not {value.kind.simpleString()}")
            if plain:
                groups.append(array_of(plain))
                plain = []
            groups.append(Typed(F.coalesce(value.column, F.array().cast(value.kind)), value.kind))
        else:
            plain.append(compile_template(x, scope))
    if plain or not groups:
        groups.append(array_of(plain))
    if len(groups) == 1:
        return groups[0]
    kind = next(g.kind for g in groups if isinstance(g.kind, ArrayType))
    return Typed(F.concat(*[g.column.cast(kind) for g in groups]), kind)


def map_list(template: Mapping[str, Any], scope: Scope) -> Typed:
    """``{"*": source | {input, where}, key: template}``: elements that pass, each as a dict.

    ``${item}`` is the element and ``${index}`` its place in the source, dropped ones counted. A null
    source is an empty list.
    """
    spec = template["*"]
    where = spec.get("where") if isinstance(spec, Mapping) else None
    source = compile_template(spec["input"] if isinstance(spec, Mapping) and "input" in spec else spec, scope)
    body = {k: v for k, v in template.items() if k != "*"}
    if not isinstance(source.kind, ArrayType):
        raise TypeError(f"only lists can be mapped, not {source.kind.simpleString()}")
    element = source.kind.elementType
    items = F.coalesce(source.column, F.array().cast(source.kind))
    if where is None and not body:
        return Typed(items, source.kind)
    inside = lambda x, i: scope.child(item=Typed(x, element), index=Typed(i.cast("bigint"), LongType()))
    shape = dict_template(body, inside(F.lit(None).cast(element), F.lit(0))).kind if body else element
    if where is None:
        return Typed(F.transform(items, lambda x, i: dict_template(body, inside(x, i)).column), ArrayType(shape))
    if not body:
        return Typed(F.filter(items, lambda x, i: predicate(where, lambda t: compile_template(t, inside(x, i)))), source.kind)
    placed = F.transform(items, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    passed = F.filter(placed, lambda p: predicate(where, lambda t: compile_template(t, inside(p["x"], p["i"]))))
    return Typed(F.transform(passed, lambda p: dict_template(body, inside(p["x"], p["i"])).column), ArrayType(shape))


def split_list(template: Mapping[str, Any], scope: Scope) -> Typed:
    """``{"|": source, key: template}``: a dict of parallel lists; at least one key is needed."""
    body = {k: v for k, v in template.items() if k != "|"}
    if not body:
        raise ValueError("a split needs a field")
    source = compile_template(template["|"], scope)
    if not isinstance(source.kind, ArrayType):
        raise TypeError(f"only lists can be split, not {source.kind.simpleString()}")
    element = source.kind.elementType
    items = F.coalesce(source.column, F.array().cast(source.kind))
    inside = lambda x, i: scope.child(item=Typed(x, element), index=Typed(i.cast("bigint"), LongType()))

    def one(inner: Any) -> Typed:
        kind = compile_template(inner, inside(F.lit(None).cast(element), F.lit(0))).kind
        return Typed(F.transform(items, lambda x, i: compile_template(inner, inside(x, i)).column), ArrayType(kind))

    return struct_of({key: one(inner) for key, inner in body.items()})


def concatenate(parts: Any, scope: Scope) -> Typed:
    """``{"+": parts}``: nulls are dropped and nothing is null; the first part's type decides between
    joined lists, merged dicts (later keys win) and joined text."""
    if not isinstance(parts, (list, tuple)):
        return flatten(compile_template(parts, scope))
    values = [compile_template(p, scope) for p in parts]
    if not values:
        return literal(None)
    first = values[0].kind
    some = values[0].column.isNotNull()
    for v in values[1:]:
        some = some | v.column.isNotNull()
    if isinstance(first, ArrayType):
        empty = F.array().cast(first)
        return Typed(F.when(some, F.concat(*[F.coalesce(v.column.cast(first), empty) for v in values])), first)
    if isinstance(first, StructType):
        out: dict[str, Typed] = {}
        for v in values:
            for k, x in _fields(v).items():
                before = out.pop(k, None)
                out[k] = x if before is None or before.kind != x.kind else Typed(F.when(v.column.isNull(), before.column).otherwise(x.column), x.kind)
        merged = struct_of(out)
        return Typed(F.when(some, merged.column), merged.kind)
    if isinstance(first, MapType):
        empty = F.create_map().cast(first)
        maps = [F.coalesce(v.column, empty) for v in values]
        merged = maps[0]
        for m in maps[1:]:
            merged = merge_maps(merged, m)
        return Typed(F.when(some, merged), first)
    if isinstance(first, StringType):
        return Typed(F.when(some, F.concat_ws("", *[casts.to_text(v.column, v.kind) for v in values])), StringType())
    raise TypeError(f"can't concatenate {first.simpleString()}")


def merge_maps(a: Column, b: Column) -> Column:
    """Both maps; keys of the later one win, whatever the session says about repeated keys."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def flatten(value: Typed) -> Typed:
    """Concatenation of the parts of one list column."""
    if not isinstance(value.kind, ArrayType):
        raise TypeError("+ needs a list of parts")
    inner, parts = value.kind.elementType, F.array_compact(value.column)
    some = F.size(parts) > 0
    if isinstance(inner, ArrayType):
        return Typed(F.when(some, F.flatten(parts)), inner)
    if isinstance(inner, StringType):
        return Typed(F.when(some, F.array_join(parts, "")), inner)
    if isinstance(inner, MapType):
        return Typed(F.when(some, F.aggregate(parts, F.create_map().cast(inner), merge_maps)), inner)
    raise TypeError(f"can't concatenate {inner.simpleString()}")


def case(entries: Any, scope: Scope) -> Typed:
    """``{"?": entry or entries}``: the first entry that holds gives ``if_true``; an entry with
    ``if_false`` ends the chain; nothing is null."""
    entries = [entries] if isinstance(entries, Mapping) else list(entries)
    out: Typed | None = None
    last = next((k for k, e in enumerate(entries) if "if_false" in e), len(entries) - 1)
    for entry in reversed(entries[: last + 1]):
        yes = compile_template(entry.get("if_true"), scope)
        test = F.coalesce(predicate({k: v for k, v in entry.items() if k not in ("if_true", "if_false")}, lambda t: compile_template(t, scope)), F.lit(False))
        no = compile_template(entry["if_false"], scope) if "if_false" in entry else out
        kind = yes.kind
        if no is None:
            column = F.when(test, yes.column)
        else:
            if no.kind != kind:
                null_yes = entry.get("if_true") is None
                kind = no.kind if null_yes else kind
            column = F.when(test, yes.column.cast(kind)).otherwise(no.column.cast(kind))
        out = Typed(column, kind)
    return out if out is not None else literal(None)


def project(df: DataFrame, template: Mapping[str, Any], scope: Scope | None = None) -> DataFrame:
    """One column per key of a dict template; ``"..."`` spreads the row or an object."""
    parts = dict_parts(template, scope or Scope.of(df))
    return df.select(*[v.column.alias(k) for k, v in parts.items()])


def filter_rows(df: DataFrame, where: Mapping[str, Any] | None, scope: Scope | None = None) -> DataFrame:
    """Rows whose condition holds; without a condition all rows. Works on streams as well."""
    scope = scope or Scope.of(df)
    return df if where is None else df.where(predicate(where, lambda t: compile_template(t, scope)))
