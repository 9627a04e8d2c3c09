"""Conversation memory: rows (session, turn, seq, role, content); windows over the newest turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def window(messages: DataFrame, max_turns: int | None = None, max_messages: int | None = None, session: str = "session_id", turn: str = "turn") -> DataFrame:
    """Messages of the newest turns within the limits; the newest turn always stays.

    Turns are sized first (aggregated map-side), then a running sum from the newest turn back decides;
    sizes are not negative, so the turns that pass are a run. 0 or none is no limit.
    """
    turns = messages.groupBy(session, turn).agg(F.count("*").alias("__size"))
    back = Window.partitionBy(session).orderBy(F.col(turn).desc())
    turns = turns.withColumns({"__rank": F.row_number().over(back), "__sum": F.sum("__size").over(back.rowsBetween(Window.unboundedPreceding, 0))})
    inside = F.lit(True)
    if max_turns:
        inside &= F.col("__rank") <= max_turns
    if max_messages:
        inside &= F.col("__sum") <= max_messages
    return messages.join(turns.where(inside | (F.col("__rank") == 1)).select(session, turn), [session, turn])


def load(messages: DataFrame, sessions: DataFrame, session: str = "session_id", turn: str = "turn", **limits: int | None) -> DataFrame:
    """Messages of the wanted sessions within the window limits."""
    return window(messages.join(sessions.select(session).distinct(), session, "left_semi"), session=session, turn=turn, **limits)


def append(messages: DataFrame, turn_rows: DataFrame, session: str = "session_id", turn: str = "turn") -> DataFrame:
    """The messages with a new turn per session behind the last one."""
    last = messages.groupBy(session).agg(F.max(turn).alias("__last"))
    rows = turn_rows.join(last, session, "left").withColumn(turn, F.coalesce(F.col("__last") + 1, F.lit(0)).cast(messages.schema[turn].dataType)).drop("__last")
    return messages.unionByName(rows, allowMissingColumns=True)


def snapshot(messages: DataFrame, version: int) -> DataFrame:
    """Messages with the version that they are saved under."""
    return messages.withColumn("version", F.lit(version))


def restore(saved: DataFrame, version: int | None = None) -> DataFrame:
    """Messages of the last saved version (up to ``version``) of each session."""
    rows = saved if version is None else saved.where(F.col("version") <= version)
    last = rows.groupBy("session_id").agg(F.max("version").alias("version"))
    return rows.join(last, ["session_id", "version"], "left_semi").drop("version")


def forget(messages: DataFrame, sessions: DataFrame, session: str = "session_id") -> DataFrame:
    """Messages of all other sessions."""
    return messages.join(sessions.select(session).distinct(), session, "left_anti")
