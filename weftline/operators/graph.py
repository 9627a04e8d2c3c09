"""Property graphs as two frames: nodes (id, label, ...) and edges (id, src, dst, type, ...)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def insert_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes with new ones."""
    return nodes.unionByName(new, allowMissingColumns=True)


def insert_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with those new ones whose ends both exist."""
    ids = nodes.select("id").distinct()
    known = new.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return edges.unionByName(known, allowMissingColumns=True)


def update_nodes(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """Properties (map) are merged, later keys win; labels (array) are united. ``changes``: id, props, labels."""
    new = changes.select("id", F.col("props").alias("__props"), F.col("labels").alias("__labels"))
    merged = F.map_concat(F.map_filter("props", lambda k, _: ~F.map_contains_key("__props", k)), F.col("__props"))
    both = nodes.join(new, "id", "left").withColumns({"props": F.when(F.col("__props").isNull(), F.col("props")).otherwise(merged), "labels": F.when(F.col("__labels").isNull(), F.col("labels")).otherwise(F.array_union("labels", "__labels"))})
    return both.drop("__props", "__labels")


def update_edges(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """Properties (map) of relationships are merged, later keys win; a new type replaces the old.
    ``changes``: id, props, type (null: as it was)."""
    new = changes.select("id", F.col("props").alias("__props"), F.col("type").alias("__type"))
    merged = F.map_concat(F.map_filter("props", lambda k, _: ~F.map_contains_key("__props", k)), F.col("__props"))
    both = edges.join(new, "id", "left").withColumns({"props": F.when(F.col("__props").isNull(), F.col("props")).otherwise(merged), "type": F.coalesce("__type", "type")})
    return both.select(*edges.columns)


def delete_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame, detach: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without the ids; with ``detach`` their edges go too, else linked nodes are an error
    of the caller and stay."""
    gone = ids.select("id").distinct()
    if not detach:
        linked = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
        gone = gone.join(linked, "id", "left_anti")
    left = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(gone, "id", "left_anti"), left


def traverse(nodes: DataFrame, edges: DataFrame, start: DataFrame, direction: str = "out", max_depth: int = 3, types: Sequence[str] | None = None, labels: Sequence[str] | None = None) -> DataFrame:
    """start, node, depth, types of every path of 1 to ``max_depth`` edges; no edge twice in a path.

    One equi-join per step, all in one plan; ``types`` limits edges, ``labels`` the end node only.
    """
    used = edges.where(F.col("type").isin(list(types))) if types else edges
    forward = used.select(F.col("src").alias("__from"), F.col("dst").alias("__to"), F.col("id").alias("__edge"), F.col("type").alias("__type"))
    backward = used.select(F.col("dst").alias("__from"), F.col("src").alias("__to"), F.col("id").alias("__edge"), F.col("type").alias("__type"))
    steps = {"out": forward, "in": backward, "both": forward.unionByName(backward)}[direction]
    path = start.select(F.col("id").alias("start"), F.col("id").alias("node"), F.array().cast("array<string>").alias("seen"), F.array().cast("array<string>").alias("types"))
    out = None
    for depth in range(1, max_depth + 1):
        path = path.join(steps, path["node"] == steps["__from"]).where(~F.array_contains("seen", F.col("__edge").cast("string")))
        path = path.select("start", F.col("__to").alias("node"), F.concat("seen", F.array(F.col("__edge").cast("string"))).alias("seen"), F.concat("types", F.array("__type")).alias("types"))
        rows = path.select("start", "node", F.lit(depth).alias("depth"), "types")
        out = rows if out is None else out.unionByName(rows)
    ends = nodes.where(F.col("label").isin(list(labels))) if labels else nodes
    return out.join(ends.select(F.col("id").alias("node")), "node", "left_semi").select("start", "node", "depth", "types")


def query(spark, sql: str, nodes: DataFrame, edges: DataFrame, **params) -> DataFrame:
    """A SQL query over {nodes} and {edges} with named parameters."""
    return spark.sql(sql, args=params, nodes=nodes, edges=edges)
