"""Order, position and set operations on whole frames.

A frame has no order of its own: every operation that depends on one takes the key that defines it.
Global positions come from a range partition by that key and a count per partition, never from a
window over all rows in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType


def _keys(order: str | Column | Sequence[str | Column]) -> list[Column]:
    order = [order] if isinstance(order, (str, Column)) else list(order)
    return [F.col(k) if isinstance(k, str) else k for k in order]


#: Sampled keys per bucket, from which the cuts between buckets are taken.
SAMPLED = 40


def with_position(df: DataFrame, order: str | Column | Sequence[str | Column], name: str = "pos") -> DataFrame:
    """Adds the 0-based place of each row in a total ascending order (nulls first).

    A bounded sample of the whole keys (``SAMPLED`` per shuffle partition, by row hash) gives the cuts
    between buckets, the buckets' counts are summed over (one row per bucket), and a window numbers the
    rows within each bucket, so no task holds more than a bucket. Equal first keys, long common
    prefixes and ties are parted by the further keys and then by the row's hash; only rows that are
    equal in all columns stay together. Where the cuts fall makes no difference to the result.
    """
    row_hash = F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema if not _holds_map(f.dataType)]) if any(not _holds_map(f.dataType) for f in df.schema) else F.lit(0)
    keys = [*_keys(order), row_hash]
    rows = df.withColumn("__key", F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]))
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    share = min(1.0, SAMPLED * n / max(df.count(), 1))
    sample = rows.where(F.pmod(F.xxhash64(row_hash), F.lit(1 << 30)) <= share * (1 << 30)).select("__key").orderBy(F.xxhash64("__key")).limit(4 * SAMPLED * n).orderBy("__key").collect()
    picked = [sample[len(sample) * i // n]["__key"] for i in range(1, n)] if sample else []
    cuts = [x for i, x in enumerate(picked) if i == 0 or x != picked[i - 1]]
    kind = rows.schema["__key"].dataType
    bucket = _place(F.col("__key"), [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(c, kind, strict=True)]) for c in cuts])
    rows = rows.withColumn("__bucket", bucket)
    counts = rows.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = counts.select("__bucket", (F.sum("__n").over(Window.orderBy("__bucket")) - F.col("__n")).alias("__before"))
    rows = rows.join(F.broadcast(before), "__bucket")
    inside = F.row_number().over(Window.partitionBy("__bucket").orderBy("__key"))
    return rows.withColumn(name, F.col("__before") + inside - 1).drop("__bucket", "__before", "__key")


def _place(key: Column, cuts: Sequence[Column], first: int = 0) -> Column:
    """How many of the ascending cuts lie below the key, by halving."""
    if not cuts:
        return F.lit(first)
    at = len(cuts) // 2
    return F.when(key > cuts[at], _place(key, cuts[at + 1 :], first + at + 1)).otherwise(_place(key, cuts[:at], first))


def _holds_map(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _holds_map(kind.elementType)
    return isinstance(kind, (MapType, VariantType)) or isinstance(kind, StructType) and any(_holds_map(f.dataType) for f in kind)


def zip_frames(frames: Sequence[DataFrame], orders: Sequence[str], strict: bool = True) -> DataFrame:
    """Rows of several frames side by side, by position. Frames of different length are an error."""
    placed = [with_position(f, o, "__pos") for f, o in zip(frames, orders, strict=True)]
    out = placed[0].withColumn("__in0", F.lit(True))
    for k, other in enumerate(placed[1:], 1):
        out = out.join(other.withColumn(f"__in{k}", F.lit(True)), "__pos", "full_outer" if strict else "inner")
    if strict:
        whole = reduce(lambda a, b: a & b, [F.col(f"__in{k}").isNotNull() for k in range(len(frames))])
        out = out.where(F.when(whole, True).otherwise(F.raise_error(F.lit("zipped sources have different lengths")).cast("boolean")))
    return out.withColumnRenamed("__pos", "pos").drop(*[f"__in{k}" for k in range(len(frames))])


def broadcast_value(df: DataFrame, one: DataFrame) -> DataFrame:
    """Every row with the single row of ``one`` (a parameter, an aggregate)."""
    return df.crossJoin(F.broadcast(one.limit(1)))


def concat_rows(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all frames, columns by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def select_rows(df: DataFrame, order: str, indices: Sequence[int]) -> DataFrame:
    """The rows at the given places, in their order, repeated where an index repeats; adds ``at``."""
    wanted = df.sparkSession.createDataFrame([(k, i) for k, i in enumerate(indices)], "at int, pos long")
    return with_position(df, order).join(F.broadcast(wanted), "pos").drop("pos")


def prefix_fraction(df: DataFrame, order: str | Column | Sequence[str | Column], fraction: float) -> DataFrame:
    """The first share of rows (one at least), cut by position, so that no task takes them all."""
    n = max(int(df.count() * fraction), 1)
    return with_position(df, order, "__pos").where(F.col("__pos") < n).drop("__pos")


def batches(df: DataFrame, order: str, size: int) -> DataFrame:
    """Adds batch and slot numbers of batches of ``size`` rows; the last may be short."""
    placed = with_position(df, order, "__pos")
    return placed.withColumns({"batch": F.floor(F.col("__pos") / size), "slot": F.col("__pos") % size}).drop("__pos")


def page(df: DataFrame, order: str | Sequence[str], size: int, token: int = 0) -> DataFrame:
    """``size`` rows after the first ``token``."""
    return df.orderBy(*_keys(order)).offset(token).limit(size)


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group; the rank limit is applied before the shuffle as well."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= n)


def split_columns(df: DataFrame, group: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Per group, each column as a list in order."""
    rows = F.array_sort(F.collect_list(F.struct(order, *columns)))
    out = df.groupBy(*group).agg(rows.alias("__rows"))
    return out.select(*group, *[F.col(f"__rows.{c}").alias(c) for c in columns])


def repeat(df: DataFrame, n: int) -> DataFrame:
    """Every row n times, numbered from 0."""
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("run"))


def route(df: DataFrame, routes: Sequence[tuple[Column, str]], otherwise: str | None = None) -> DataFrame:
    """Adds the name of the first route whose condition holds."""
    out = F.lit(otherwise).cast("string")
    for test, name in reversed(routes):
        out = F.when(test, F.lit(name)).otherwise(out)
    return df.withColumn("route", out)


def route_random(df: DataFrame, weights: dict[str, float | None], key: str, seed: int = 0) -> DataFrame:
    """Adds a route drawn by weight, fixed by ``key`` and seed; weights of 0 or none never win."""
    known = {k: float(w) for k, w in weights.items() if w is not None and w > 0}
    if not known:
        raise ValueError("no route has a weight")
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40) * sum(known.values())
    out, upto = F.lit(list(known)[-1]), sum(known.values())
    for name, w in reversed(known.items()):
        upto -= w
        out = F.when(draw < upto + w, F.lit(name)).otherwise(out)
    return df.withColumn("route", out)
