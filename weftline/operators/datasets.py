"""Dataset operations: load, select, map, filter, concat."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.templates import filter_rows
from .frames import concat_rows, prefix_fraction, select_rows, with_position, zip_frames

_PLACE = re.compile(r"\{(\w+)\}")


def load(spark: SparkSession, path: str, form: str = "parquet", order: str | None = None, fraction: float | None = None, shuffle_seed: int | None = None, keep: bool = False, **options: Any) -> DataFrame:
    """Reads parquet, csv, json or text files.

    ``fraction`` below 1 keeps that share from the front of ``order``, after ``shuffle_seed`` has put the
    rows into a seeded random order. ``keep`` persists the result.
    """
    df = spark.read.format(form).options(**options).load(path)
    shuffled = F.xxhash64(*[F.col(order)] if order else [F.to_json(F.struct("*"))], F.lit(shuffle_seed))
    if fraction is not None and fraction < 1:
        df = prefix_fraction(df, order if shuffle_seed is None else [shuffled, *([order] if order else [])], fraction)
    if shuffle_seed is not None:
        df = df.orderBy(shuffled)
    return df.persist() if keep else df


def select(df: DataFrame, columns: Sequence[str] | None = None, indices: Sequence[int] | None = None, order: str | None = None) -> DataFrame:
    """Columns in the given order, or rows at the given places of ``order``."""
    return df.select(*columns) if columns is not None else select_rows(df, order, indices)


def map_template(df: DataFrame, template: str, output: str, remove: Sequence[str] = ()) -> DataFrame:
    """Adds a text in which ``{column}`` is the row's value; unknown names stay as they are and null
    reads None. Drops ``remove``."""
    parts, at = [], 0
    for m in _PLACE.finditer(template):
        if m[1] in df.columns:
            parts += [F.lit(template[at : m.start()]), F.coalesce(F.col(m[1]).cast("string"), F.lit("None"))]
            at = m.end()
    parts.append(F.lit(template[at:]))
    return df.withColumn(output, F.concat(*parts)).drop(*remove)


def filter_where(df: DataFrame, where: Mapping[str, Any] | None) -> DataFrame:
    """Rows whose condition holds."""
    return filter_rows(df, where)


def concat(frames: Sequence[DataFrame], direction: str = "vertical", orders: Sequence[str] | None = None) -> DataFrame:
    """All rows (vertical), or all columns by position (horizontal; lengths must agree)."""
    return concat_rows(frames) if direction == "vertical" else zip_frames(frames, orders)


__all__ = ["concat", "filter_where", "load", "map_template", "select", "with_position"]
