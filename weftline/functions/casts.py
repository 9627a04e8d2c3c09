"""Conversions of the expression language as Columns.

A cast follows the type token of an expression: ``as number``, ``as string[]``, ``as object/a,b.c``.
Null stays null. Booleans never fail: only "true" and "1" (any case) are true.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, LongType, MapType, StringType, StructField, StructType, VariantType

#: Seconds per suffix of a duration, bytes per suffix of a size, factor per SI suffix.
DURATIONS = {"ms": 0.001, "s": 1.0, "m": 60.0, "h": 3600.0, "d": 86400.0}
SIZES = {"B": 1, "K": 1024, "KB": 1024, "M": 1024**2, "MB": 1024**2, "G": 1024**3, "GB": 1024**3}
DECIMALS = {"k": 1000, "m": 1000**2, "g": 1000**3}

CONTAINERS = (ArrayType, MapType, StructType)


def to_text(c: Column, kind: DataType) -> Column:
    """Text of a value: JSON for containers, UTF-8 for bytes, the plain form else."""
    if isinstance(kind, VariantType):
        return F.to_json(c)
    if isinstance(kind, CONTAINERS):
        return F.to_json(c)
    if kind.simpleString() == "binary":
        return F.decode(c, "UTF-8")
    return c.cast("string")


def cast(c: Column, kind: DataType, token: str, subtype: str | None = None) -> tuple[Column, DataType]:
    """The value under a type token, with the type that it has then."""
    if token.endswith("[]"):
        base = token[:-2]
        if not isinstance(kind, ArrayType):
            raise TypeError(f"{token} needs a list, not {kind.simpleString()}")
        _, inner = cast(F.lit(None), kind.elementType, base, subtype)
        return F.transform(c, lambda x: cast(x, kind.elementType, base, subtype)[0]), ArrayType(inner)
    if token in ("string", "text", "markdown"):
        return to_text(c, kind), StringType()
    if token == "number":
        return c.cast("double"), DoubleType()
    if token == "integer":
        return c.cast("bigint"), LongType()
    if token == "boolean":
        return F.when(c.isNotNull(), F.lower(c.cast("string")).isin("true", "1")), BooleanType()
    if token == "json":
        return (F.parse_json(c), VariantType()) if isinstance(kind, StringType) else (c, kind)
    if token == "list":
        if isinstance(kind, StringType):
            return F.parse_json(c).cast("array<variant>"), ArrayType(VariantType())
        if not isinstance(kind, ArrayType):
            raise TypeError(f"list needs a list or JSON text, not {kind.simpleString()}")
        return c, kind
    if token == "object":
        if isinstance(kind, StringType):
            c, kind = F.parse_json(c), VariantType()
        return project_object(c, kind, subtype) if subtype else (c, kind)
    if token == "base64":
        raw = c if kind.simpleString() == "binary" else F.encode(to_text(c, kind), "UTF-8")
        return F.base64(raw), StringType()
    raise ValueError(f"unknown type {token!r}")


def project_object(c: Column, kind: DataType, paths: str) -> tuple[Column, DataType]:
    """A struct of the named paths; the key is a path's last part, and what is missing is null."""
    fields, out = [], []
    for path in (p.strip() for p in paths.split(",")):
        name = path.split(".")[-1]
        if isinstance(kind, VariantType):
            value, found = F.try_variant_get(c, "$." + path, "string"), StringType()
        else:
            value, found = c, kind
            for part in path.split("."):
                value, found = field(value, found, part)
        out.append(value.alias(name))
        fields.append(StructField(name, found))
    return F.when(c.isNotNull(), F.struct(*out)), StructType(fields)


def field(c: Column, kind: DataType, name: str) -> tuple[Column, DataType]:
    """A key of a struct, map or variant; null if there is none."""
    if isinstance(kind, StructType):
        if name in kind.names:
            return c[name], kind[name].dataType
    elif isinstance(kind, MapType):
        return F.try_element_at(c, F.lit(name)), kind.valueType
    elif isinstance(kind, VariantType):
        return F.try_variant_get(c, f"$.{name}", "variant"), VariantType()
    return F.lit(None).cast("string"), StringType()


def parse_duration(c: Column) -> Column:
    """Seconds of ``1h``, ``90s``, ``250ms``, ``2d``, ``1:02:03``, ``02:03`` or a bare number; null else."""
    text = F.trim(c.cast("string"))
    parts = F.transform(F.split(text, ":"), lambda x: F.try_to_number(x, F.lit("999999999.999999")).cast("double"))
    clock = F.aggregate(parts, F.lit(0.0), lambda a, x: a * 60 + x)
    value = F.regexp_extract(text, r"^([0-9]*\.?[0-9]+)", 1).try_cast("double")
    unit = F.lower(F.regexp_extract(text, r"(ms|s|m|h|d)$", 1))
    factor = F.lit(1.0)
    for k, v in DURATIONS.items():
        factor = F.when(unit == k, F.lit(v)).otherwise(factor)
    plain = F.when(F.rlike(F.lower(text), F.lit(r"^[0-9]*\.?[0-9]+\s*(ms|s|m|h|d)?$")), value * factor)
    return F.when(F.rlike(text, F.lit(r"^[0-9]+(:[0-9]{1,2}){1,2}(\.[0-9]+)?$")), clock).otherwise(plain)


def _suffixed(c: Column, factors: dict[str, int], pattern: str, bare: bool) -> Column:
    text = F.trim(c.cast("string"))
    value = F.regexp_extract(text, r"^([0-9]*\.?[0-9]+)", 1).try_cast("double")
    unit = F.regexp_extract(text, pattern, 1)
    factor = F.lit(1.0) if bare else F.lit(None).cast("double")
    for k, v in factors.items():
        factor = F.when(F.upper(unit) == k.upper(), F.lit(float(v))).otherwise(factor)
    return F.when(F.rlike(text, F.lit(rf"^[0-9]*\.?[0-9]+\s*{pattern.removesuffix('$')}{'?' if bare else ''}$")), F.floor(value * factor))


def parse_size(c: Column) -> Column:
    """Bytes of ``10KB``, ``1.5M``, ``3g``: factors of 1024; a bare number counts bytes; null else."""
    return _suffixed(c, SIZES, r"((?i:GB|MB|KB|G|M|K|B))$", bare=True)


def parse_decimal(c: Column) -> Column:
    """Number of ``3k``, ``1.5M``, ``2G``: factors of 1000; null without a suffix."""
    return _suffixed(c, DECIMALS, r"((?i:k|m|g))$", bare=False)


def data_uri(c: Column) -> Column:
    """struct(content_type, content) of a ``data:`` URI, base64 or percent-encoded; null else."""
    head = r"^data:([^;,]*)((?:;[^;,]*)*),(?s:(.*))$"
    kind, options, body = (F.regexp_extract(c, head, k) for k in (1, 2, 3))
    content = F.when(F.contains(options, F.lit(";base64")), F.try_to_binary(body, F.lit("base64"))).otherwise(F.encode(F.try_url_decode(body), "UTF-8"))
    return F.when(F.rlike(c, F.lit(head)), F.struct(F.when(kind == "", F.lit("text/plain")).otherwise(kind).alias("content_type"), content.alias("content")))
