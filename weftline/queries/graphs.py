"""Graphs: nations, regions and customers as nodes, foreign keys as edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import graph
from ._registry import query


def nodes(t):
    r = t("region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("region").alias("label"))
    n = t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit("nation").alias("label"))
    c = t("customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.lit("customer").alias("label"))
    return reduce(lambda a, b: a.unionByName(b), (r, n, c))


def edges(t):
    n = t("nation").select(F.concat(F.lit("e"), "n_nationkey").alias("id"), F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"), F.lit("in").alias("type"))
    c = t("customer").select(F.concat(F.lit("f"), "c_custkey").alias("id"), F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"), F.lit("of").alias("type"))
    return n.unionByName(c)


NODES = "nodes AS (SELECT 'r' || r_regionkey AS id, 'region' AS label FROM region UNION ALL SELECT 'n' || n_nationkey, 'nation' FROM nation UNION ALL SELECT 'c' || c_custkey, 'customer' FROM customer)"
EDGES = "edges AS (SELECT 'e' || n_nationkey AS id, 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'in' AS type FROM nation UNION ALL SELECT 'f' || c_custkey, 'c' || c_custkey, 'n' || c_nationkey, 'of' FROM customer)"


def _traversal(start: str, step: str, depth: int, where: str = "") -> str:
    """Edge-unique paths in SQL."""
    return (
        f"WITH RECURSIVE {NODES}, {EDGES}, step AS ({step}), path(start, node, depth, seen, types) AS ("
        f"SELECT id, id, 0, []::VARCHAR[], []::VARCHAR[] FROM nodes WHERE {start} UNION ALL "
        "SELECT p.start, s.t, p.depth + 1, list_append(p.seen, s.id), list_append(p.types, s.type) FROM path p JOIN step s ON p.node = s.f "
        f"WHERE p.depth < {depth} AND NOT list_contains(p.seen, s.id)) "
        f"SELECT start, node, depth::BIGINT AS depth, array_to_string(types, '>') AS types FROM path WHERE depth > 0 {where}"
    )


FORWARD, BACKWARD = "SELECT src AS f, dst AS t, id, type FROM edges", "SELECT dst AS f, src AS t, id, type FROM edges"


def _walk(t, start, **how):
    n = nodes(t)
    out = graph.traverse(n, edges(t), n.where(start), **how)
    return out.select("start", "node", F.col("depth").cast("bigint").alias("depth"), F.array_join("types", ">").alias("types"))


@query(_traversal("label = 'customer'", FORWARD, 3))
def graph_traverse_out(t):
    return _walk(t, "label = 'customer'", direction="out", max_depth=3)


@query(_traversal("label = 'region'", BACKWARD, 2))
def graph_traverse_in(t):
    return _walk(t, "label = 'region'", direction="in", max_depth=2)


@query(_traversal("id IN ('r0', 'n3')", f"{FORWARD} UNION ALL {BACKWARD}", 3, "AND node LIKE 'n%'"))
def graph_traverse_both(t):
    return _walk(t, "id in ('r0', 'n3')", direction="both", max_depth=3, labels=["nation"])


@query("SELECT 'o' || o_orderkey AS id, 'c' || o_custkey AS src, 'c' || (o_custkey + 1) AS dst FROM orders WHERE o_custkey + 1 IN (SELECT c_custkey FROM customer) AND o_custkey IN (SELECT c_custkey FROM customer)")
def graph_insert_edges(t):
    new = t("orders").select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("c"), F.col("o_custkey") + 1).alias("dst"), F.lit("next").alias("type"))
    return graph.insert_edges(edges(t), new, nodes(t)).where("type = 'next'").select("id", "src", "dst")


@query("SELECT 'n' || n_nationkey AS id, CASE WHEN n_nationkey < 5 THEN 'changed' ELSE n_name END AS name, CASE WHEN n_nationkey < 5 THEN 'nation,small' ELSE 'nation' END AS labels FROM nation")
def graph_update(t):
    n = t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.create_map(F.lit("name"), F.col("n_name"), F.lit("kept"), F.lit("yes")).alias("props"), F.array(F.lit("nation")).alias("labels"))
    change = t.spark.range(0, 5).select(F.concat(F.lit("n"), "id").alias("id"), F.create_map(F.lit("name"), F.lit("changed")).alias("props"), F.array(F.lit("small"), F.lit("nation")).alias("labels"))
    return graph.update_nodes(n, change).select("id", F.col("props")["name"].alias("name"), F.array_join("labels", ",").alias("labels"))


@query(f"WITH {NODES}, {EDGES} SELECT type, count(*) AS n FROM edges WHERE src NOT IN ('n1', 'r2', 'c5') AND dst NOT IN ('n1', 'r2', 'c5') GROUP BY type")
def graph_delete_detach(t):
    ids = t.spark.createDataFrame([("n1",), ("r2",), ("c5",)], "id string")
    return graph.delete_nodes(nodes(t), edges(t), ids)[1].groupBy("type").agg(F.count("*").alias("n"))


@query(f"WITH {NODES}, {EDGES} SELECT n.label, e.type, count(*) AS n FROM edges e JOIN nodes n ON e.dst = n.id WHERE e.type = 'of' GROUP BY ALL")
def graph_query(t):
    sql = "SELECT n.label, e.type, count(*) AS n FROM {edges} e JOIN {nodes} n ON e.dst = n.id WHERE e.type = :kind GROUP BY ALL"
    return graph.query(t.spark, sql, nodes(t), edges(t), kind="of")
