"""Queues as append-only logs of (session, seq, item), in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def enqueue(log: DataFrame, items: DataFrame, spread: bool = False, max_size: int | None = None) -> DataFrame:
    """The log with items (session, item) behind it; ``spread`` enqueues the elements of list items.

    With ``max_size``, a session that would hold more is an error.
    """
    rows = items.select("session", F.posexplode("item").alias("at", "item")) if spread else items.select("session", F.lit(0).alias("at"), "item")
    last = log.groupBy("session").agg(F.max("seq").alias("__last"), F.count("*").alias("__n"))
    order = Window.partitionBy("session").orderBy("at", "item")
    rows = rows.withColumn("__k", F.row_number().over(order)).join(last, "session", "left")
    if max_size is not None:
        full = F.coalesce("__n", F.lit(0)) + F.col("__k") > max_size
        rows = rows.where(F.when(full, F.raise_error(F.lit("the queue is full")).cast("boolean")).otherwise(True))
    rows = rows.select("session", (F.coalesce("__last", F.lit(-1)) + F.col("__k")).alias("seq"), "item")
    return log.select("session", "seq", "item").unionByName(rows)


def dequeue(log: DataFrame, session: str, after: int = -1) -> DataFrame:
    """Items of a session behind a position, in order."""
    return log.where((F.col("session") == session) & (F.col("seq") > after)).orderBy("seq")


def dequeue_stream(spark: SparkSession, path: str, schema: str, session: str | None = None, files_per_trigger: int = 1) -> DataFrame:
    """A stream over a log that is appended as Parquet files; consumers of one query share its items."""
    out = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return out if session is None else out.where(F.col("session") == session)
