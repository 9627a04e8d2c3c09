"""Datasets, positions, joins by position, sets, limits, and plain relational steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import datasets, frames
from ..plans.pipeline import compile_pipeline
from ..sources import files, queue
from ._registry import query


@query("SELECT doc_id, lang, n_chars FROM documents")
def datasets_load(t):
    return datasets.load(t.spark, f"{t.dir}/documents.parquet").select("doc_id", "lang", "n_chars")


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT (SELECT greatest(floor(count(*) * 0.25)::BIGINT, 1) FROM documents)")
def datasets_load_fraction(t):
    return datasets.load(t.spark, f"{t.dir}/documents.parquet", order="doc_id", fraction=0.25).select("doc_id")


@query("SELECT u.at::BIGINT AS at, d.doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents) d JOIN (SELECT unnest([5, 3, 3, 150]) AS pos, unnest([0, 1, 2, 3]) AS at) u ON d.pos = u.pos")
def datasets_select_rows(t):
    return datasets.select(t("documents"), indices=[5, 3, 3, 150], order="doc_id").select(F.col("at").cast("bigint").alias("at"), "doc_id")


@query("SELECT r_regionkey AS key, r_name AS name, 'region' AS kind FROM region UNION ALL SELECT n_nationkey, n_name, 'nation' FROM nation")
def datasets_concat_vertical(t):
    a = t("region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"), F.lit("region").alias("kind"))
    b = t("nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.lit("nation").alias("kind"))
    return datasets.concat([a, b])


@query("SELECT a.pos, a.c_name, b.c_mktsegment FROM (SELECT c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer) a JOIN (SELECT c_mktsegment, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer) b ON a.pos = b.pos")
def datasets_concat_horizontal(t):
    c = t("customer")
    return datasets.concat([c.select("c_custkey", "c_name"), c.select(F.col("c_custkey").alias("k2"), "c_mktsegment")], "horizontal", ["c_custkey", "k2"]).select("pos", "c_name", "c_mktsegment")


@query("SELECT a.pos, a.s_name, b.s_acctbal FROM (SELECT s_name, row_number() OVER (ORDER BY s_suppkey) - 1 AS pos FROM supplier) a JOIN (SELECT s_acctbal, row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1 AS pos FROM supplier) b ON a.pos = b.pos")
def zip_join(t):
    s = t("supplier")
    placed = frames.with_position(s, ["s_acctbal", "s_suppkey"], "p2").select("p2", "s_acctbal")
    return frames.zip_frames([s.select("s_suppkey", "s_name"), placed], ["s_suppkey", "p2"]).select("pos", "s_name", "s_acctbal")


@query("SELECT n_name, (SELECT count(*) FROM customer) AS customers FROM nation")
def broadcast_scalar(t):
    return frames.broadcast_value(t("nation").select("n_name"), t("customer").agg(F.count("*").alias("customers")))


@query("SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM customer) AS customers, (SELECT round(sum(l_quantity), 2) FROM lineitem) AS quantity")
def fan_in_scalars(t):
    one = t("orders").agg(F.count("*").alias("orders"))
    for other in (t("customer").agg(F.count("*").alias("customers")), t("lineitem").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"))):
        one = frames.broadcast_value(one, other)
    return one


@query("SELECT vec_id, floor((row_number() OVER (ORDER BY vec_id) - 1) / 64)::BIGINT AS batch, (row_number() OVER (ORDER BY vec_id) - 1) % 64 AS slot FROM embeddings")
def batch_ids(t):
    return frames.batches(t("embeddings").select("vec_id"), "vec_id", 64)


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50 OFFSET 100")
def paginate(t):
    return frames.page(t("orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 50, 100)


@query("SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 3")
def topn_per_group(t):
    out = frames.top_per_group(t("events"), ["user_id"], [F.col("value").desc(), F.col("event_id")], 3)
    return out.select("user_id", "event_id", F.col("rank").cast("bigint").alias("rank"))


@query("SELECT r_regionkey, run::BIGINT AS run FROM region, unnest(range(3)) AS x(run)")
def repeat_count(t):
    return frames.repeat(t("region").select("r_regionkey"), 3).select("r_regionkey", F.col("run").cast("bigint").alias("run"))


@query()
def file_list(t):
    return files.list_files(t.spark, f"{t.dir}/nation.parquet").select("name", "size", "content_type")


def _log(t):
    return t("events").select(F.col("user_id").alias("session"), (F.row_number().over(_by_user()) - 1).cast("bigint").alias("seq"), F.col("event_type").alias("item"))


def _by_user():
    from pyspark.sql import Window

    return Window.partitionBy("user_id").orderBy("event_id")


@query("SELECT seq, item FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, event_type AS item FROM events) WHERE user_id = 7 AND seq > 4")
def queue_dequeue(t):
    return queue.dequeue(_log(t), 7, 4).select("seq", "item")


@query(
    "WITH log AS (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, event_type AS item FROM events) "
    "SELECT * FROM log UNION ALL SELECT s.session, l.last + i, x FROM (SELECT DISTINCT session FROM log) s JOIN (SELECT session, max(seq) AS last FROM log GROUP BY session) l ON s.session = l.session, (VALUES (1, 'more'), (2, 'yet')) v(i, x)"
)
def queue_enqueue_spread(t):
    log = _log(t)
    return queue.enqueue(log, log.select("session").distinct().withColumn("item", F.array(F.lit("more"), F.lit("yet"))), spread=True)


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus")
def pipeline_aggregate(t):
    spec = {"jobs": [{"id": "a", "input": "orders", "do": "aggregate", "by": ["o_orderstatus"], "n": "count(*)", "total": "round(sum(o_totalprice), 2)"}]}
    return compile_pipeline(t.spark, spec, frames_in={"orders": t("orders")})["a"]


@query("SELECT c_mktsegment, o_orderstatus, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000 GROUP BY ROLLUP (c_mktsegment, o_orderstatus)")
def pipeline_join_rollup(t):
    spec = {
        "jobs": [
            {"id": "big", "input": "orders", "do": "filter", "where": {"input": "${item.o_totalprice}", "operator": "gt", "value": 100000}},
            {"id": "both", "input": "big", "with": "customer", "do": "join", "on": "o_custkey = c_custkey"},
            {"id": "out", "input": "both", "do": "aggregate", "by": {"rollup": ["c_mktsegment", "o_orderstatus"]}, "n": "count(*)"},
        ]
    }
    return compile_pipeline(t.spark, spec, frames_in={"orders": t("orders"), "customer": t("customer")})["out"]
