"""Key-value tables with expiry: a log of (key, value, seq, expires_at); the latest entry counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(log: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """The last entry of every key. Entries are folded map-side, so a hot key sends one per task."""
    other = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*other), seq).alias("__last")).select(key, *[F.col(f"__last.{c}").alias(c) for c in other])


def alive(now: Column | float, expires: str = "expires_at") -> Column:
    """Whether an entry has not expired."""
    return F.col(expires).isNull() | (F.col(expires) > (now if isinstance(now, Column) else F.lit(now)))


def get(keys: DataFrame, log: DataFrame, now: Column | float, key: str = "key") -> DataFrame:
    """Every wanted key with its live value, or null; repeated keys stay repeated."""
    return keys.join(latest(log, key).where(alive(now)).select(key, "value"), key, "left")


def exists(keys: DataFrame, log: DataFrame, now: Column | float, key: str = "key") -> DataFrame:
    """Every wanted key with whether it has a live value."""
    live = latest(log, key).where(alive(now)).where(F.col("value").isNotNull()).select(key, F.lit(True).alias("__live"))
    return keys.join(live, key, "left").withColumn("exists", F.coalesce("__live", F.lit(False))).drop("__live")


def put(log: DataFrame, entries: DataFrame, now: Column | float, ttl: Column | None = None) -> DataFrame:
    """The log with new entries behind it; ``ttl`` in seconds."""
    expires = (now if isinstance(now, Column) else F.lit(now)) + ttl if ttl is not None else F.lit(None).cast("double")
    return log.unionByName(entries.withColumn("expires_at", expires), allowMissingColumns=True)


def delete(log: DataFrame, keys: DataFrame, now: Column | float, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(log without the keys, each wanted key with whether it was live)."""
    return log.join(keys.select(key).distinct(), key, "left_anti"), exists(keys, log, now, key).withColumnRenamed("exists", "deleted")
