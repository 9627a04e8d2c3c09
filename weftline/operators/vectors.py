"""Vector search, aggregates, and a vector collection with upsert and delete."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import vectors as V
from ..functions.scores import nearest, reaching
from ..plans.expressions import Scope
from ..plans.predicates import field_conditions

#: Bytes of query vectors that are broadcast; beyond it queries are cut into blocks of that size.
QUERY_BYTES = 64_000_000


def _scored(queries: DataFrame, candidates: DataFrame, scan: Callable, metric: str, kept: list[str], query_id: str = "query_id", query: str = "query", vector: str = "vector") -> DataFrame:
    """query_id, the kept columns and the score of the pairs that ``scan`` of :mod:`..functions.scores` finds
    among every stated query and every candidate.

    The queries are the stated side: they are gathered into broadcasts of at most ``QUERY_BYTES``. Beyond
    that size they are cut into blocks by the hash of their id, and the candidates are read once per block.
    The candidates are dealt evenly over the cores, in the order of the first kept column: every pair costs
    the same, however the table is cut into files.
    """
    if metric not in V.SIMILARITIES + V.DISTANCES:
        raise ValueError(f"unknown metric {metric!r}")
    context = candidates.sparkSession.sparkContext
    side = queries.select(F.col(query_id).alias("query_id"), V.doubles(F.col(query)).alias("query"))
    n, width = side.agg(F.count("*"), F.max(F.size("query"))).first()
    size = n * 8 * max(width or 1, 1)
    blocks = 1 if size <= QUERY_BYTES else -(-2 * size // QUERY_BYTES)
    typed = F.col(vector) if dict(candidates.dtypes).get(vector) == "array<float>" else V.doubles(F.col(vector))
    held = candidates.select(*[F.col(c).alias(f"__{k}") for k, c in enumerate(kept)], typed.alias("__vector"))
    held = held.repartition(2 * context.defaultParallelism).sortWithinPartitions("__0")
    kinds = StructType([StructField("__query", side.schema["query_id"].dataType), *[StructField(f.name, f.dataType) for f in held.schema.fields[:-1]], StructField("__score", DoubleType())])

    def block(part: DataFrame) -> DataFrame:
        stated = context.broadcast(part.toArrow())
        return held.mapInArrow(lambda batches: scan(batches, stated.value, metric=metric, vector="__vector"), kinds)

    parts = [side] if blocks == 1 else [side.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) for b in range(blocks)]
    pairs = reduce(lambda a, b: a.unionByName(b), map(block, parts))
    return pairs.select(F.col("__query").alias("query_id"), *[F.col(f"__{k}").alias(c) for k, c in enumerate(kept)], F.col("__score").alias("score"))


def _ranked(queries: DataFrame, candidates: DataFrame, k: int, metric: str, id_column: str, output: list[str], names: dict[str, str]) -> DataFrame:
    """The k closest of each query and their rank: those of every part of the candidates, then of all."""
    kept = list(dict.fromkeys([id_column, *output]))
    pairs = _scored(queries, candidates, partial(nearest, k=max(k, 1)), metric, kept, **names)
    order = Window.partitionBy("query_id").orderBy(V.closer_first(metric, F.col("score")), F.col(id_column))
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 1, metric: str = "cosine", id_column: str = "id", **names: str) -> DataFrame:
    """query_id, rank, id, score of the k closest candidates per query; ties go to the smaller id, pairs
    without a score come last."""
    return _ranked(queries, candidates, k, metric, id_column, [], names).select("query_id", "rank", id_column, "score")


def within_threshold(queries: DataFrame, candidates: DataFrame, threshold: float, metric: str = "cosine", id_column: str = "id", **names: str) -> DataFrame:
    """query_id, id, score of all candidates that reach the threshold."""
    return _scored(queries, candidates, partial(reaching, threshold=threshold), metric, [id_column], **names)


def search(queries: DataFrame, collection: DataFrame, k: int = 10, where: Any = None, output: list[str] | None = None, metric: str = "euclidean", id_column: str = "id", **names: str) -> DataFrame:
    """query_id, rank, id, distance, score = 1 / (1 + distance) and the wanted fields.

    The filter runs before any distance is computed.
    """
    rows = collection.where(field_conditions(where, Scope.of(collection)))
    best = _ranked(queries, rows, k, metric, id_column, list(output or []), names)
    return best.select("query_id", "rank", id_column, F.col("score").alias("distance"), (1 / (1 + F.col("score"))).alias("score"), *(output or []))


def mean(df: DataFrame, vector: str, size: int, group: list[str] | None = None, how: str = "mean") -> DataFrame:
    """Element-wise mean or sum of all vectors (of a group), in one pass."""
    out = df.groupBy(*(group or [])).agg(*[c.alias(f"__{k}") for k, c in enumerate(V.element_aggregates(F.col(vector), size, how))])
    return out.select(*(group or []), F.array(*[f"__{k}" for k in range(size)]).alias(how))


def insert(collection: DataFrame, rows: DataFrame) -> DataFrame:
    """The collection with new rows; missing fields are null."""
    return collection.unionByName(rows, allowMissingColumns=True)


def upsert(collection: DataFrame, rows: DataFrame, id_column: str = "id", insert_missing: bool = True) -> DataFrame:
    """Rows replace those of equal id; others are added, or dropped without ``insert_missing``."""
    other = [c for c in collection.columns if c != id_column]
    new = rows.select(id_column, F.struct(*other).alias("__new"))
    old = collection.select(id_column, F.struct(*other).alias("__old"))
    both = old.join(new, id_column, "full_outer" if insert_missing else "left")
    return both.select(id_column, *[F.coalesce(F.col("__new"), F.col("__old"))[c].alias(c) for c in other])


def delete(collection: DataFrame, ids: DataFrame, id_column: str = "id", where: Any = None) -> DataFrame:
    """The collection without rows whose id is named and whose fields pass the filter."""
    gone = collection.where(field_conditions(where, Scope.of(collection))).join(ids.select(id_column).distinct(), id_column, "left_semi").select(id_column)
    return collection.join(gone, id_column, "left_anti")
