"""Vectors: arithmetic, aggregates, search, collections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import vectors
from ._registry import query

#: Each vector with that whose id is one larger.
PAIRS = "(SELECT a.vec_id, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"
#: Queries: every 20th vector.
QUERIES_SQL = "(SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0)"


def pairs(t):
    e = t("embeddings")
    return e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")


def stated(t):
    return t("embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def _pairwise(name, sql, f):
    query(f"SELECT vec_id, round({sql}, 6) AS score FROM {PAIRS}", name)(lambda t: pairs(t).select("vec_id", F.round(f(F.col("a"), F.col("b")), 6).alias("score")))


_pairwise("vec_cosine", "list_cosine_similarity(a, b)", V.cosine)
_pairwise("vec_euclidean", "list_distance(a, b)", V.euclidean)
_pairwise("vec_dot", "list_inner_product(a, b)", V.dot)
_pairwise("vec_pairwise", "list_cosine_similarity(a, b) + list_distance(a, b)", lambda a, b: V.cosine(a, b) + V.euclidean(a, b))


@query("SELECT vec_id, i AS pos, round(x / n, 6) AS x FROM (SELECT vec_id, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS i FROM embeddings)")
def vec_normalize(t):
    out = t("embeddings").select("vec_id", F.posexplode(V.normalize(F.col("embedding"))).alias("pos", "x"))
    return out.select("vec_id", F.col("pos").cast("bigint").alias("pos"), F.round("x", 6).alias("x"))


ELEMENTS = "(SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(64)) AS pos FROM embeddings)"


def _elements(t, how):
    out = vectors.mean(t("embeddings"), "embedding", 64, ["label"], how).select("label", F.posexplode(how).alias("pos", "x"))
    return out.select("label", F.col("pos").cast("bigint").alias("pos"), F.round("x", 5).alias("x"))


@query(f"SELECT label, pos, round(avg(x), 5) AS x FROM {ELEMENTS} GROUP BY label, pos")
def vec_mean(t):
    return _elements(t, "mean")


@query(f"SELECT label, pos, round(sum(x), 5) AS x FROM {ELEMENTS} GROUP BY label, pos")
def vec_sum(t):
    return _elements(t, "sum")


@query("SELECT vec_id, round(list_avg(embedding::DOUBLE[]), 6) AS x FROM embeddings")
def vec_mean_axis1(t):
    return t("embeddings").select("vec_id", F.round(V.total(V.doubles(F.col("embedding"))) / F.size("embedding"), 6).alias("x"))


RANKED = "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY {score} {way}, vec_id) AS rank, vec_id, {score} AS s FROM " + QUERIES_SQL + " q, embeddings e {where}"


@query(f"SELECT query_id, rank, vec_id, round(s, 6) AS score FROM ({RANKED.format(score='list_cosine_similarity(q, embedding::DOUBLE[])', way='DESC', where='')}) WHERE rank <= 5")
def vec_topk(t):
    out = vectors.top_k(stated(t), t("embeddings"), 5, "cosine", "vec_id", vector="embedding")
    return out.select("query_id", F.col("rank").cast("bigint").alias("rank"), "vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT query_id, vec_id, round(list_distance(q, embedding::DOUBLE[]), 6) AS score FROM {QUERIES_SQL} q, embeddings WHERE list_distance(q, embedding::DOUBLE[]) <= 1.2")
def vec_threshold_join(t):
    return vectors.within_threshold(stated(t), t("embeddings"), 1.2, "euclidean", "vec_id", vector="embedding").withColumn("score", F.round("score", 6))


def _search(t, where=None):
    out = vectors.search(stated(t), t("embeddings"), 10, where, ["label"], "euclidean", "vec_id", vector="embedding")
    return out.select("query_id", F.col("rank").cast("bigint").alias("rank"), "vec_id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"), "label")


SEARCHED = "SELECT query_id, rank, vec_id, round(s, 6) AS distance, round(1 / (1 + s), 6) AS score, label FROM (" + RANKED.replace("vec_id, {score} AS s", "vec_id, label, {score} AS s") + ") WHERE rank <= 10"


@query(SEARCHED.format(score="list_distance(q, embedding::DOUBLE[])", way="ASC", where=""))
def vec_search(t):
    return _search(t)


@query(SEARCHED.format(score="list_distance(q, embedding::DOUBLE[])", way="ASC", where="WHERE label IN (1, 2, 3) AND vec_id >= 100"))
def vec_search_filtered(t):
    return _search(t, {"label": {"in": [1, 2, 3]}, "vec_id": {"gte": 100}})


def _collection(t):
    return t("embeddings").select(F.col("vec_id").alias("id"), "label", F.lit("old").alias("note"))


def _changes(t):
    return t("embeddings").where("vec_id % 3 = 0").select((F.col("vec_id") + 100).alias("id"), F.lit(99).alias("label"), F.lit("new").alias("note"))


OLD, NEW = "(SELECT vec_id AS id, label, 'old' AS note FROM embeddings)", "(SELECT vec_id + 100 AS id, 99 AS label, 'new' AS note FROM embeddings WHERE vec_id % 3 = 0)"


@query(f"SELECT * FROM {OLD} UNION ALL SELECT * FROM {NEW}")
def vec_insert(t):
    return vectors.insert(_collection(t), _changes(t))


@query(f"SELECT coalesce(n.id, o.id) AS id, coalesce(n.label, o.label) AS label, coalesce(n.note, o.note) AS note FROM {OLD} o FULL JOIN {NEW} n ON o.id = n.id")
def vec_upsert(t):
    return vectors.upsert(_collection(t), _changes(t))


@query(f"SELECT o.id, coalesce(n.label, o.label) AS label, coalesce(n.note, o.note) AS note FROM {OLD} o LEFT JOIN {NEW} n ON o.id = n.id")
def vec_update_only(t):
    return vectors.upsert(_collection(t), _changes(t), insert_missing=False)


@query(f"SELECT * FROM {OLD} WHERE NOT (id IN (SELECT id FROM {NEW}) AND label = 4)")
def vec_delete(t):
    return vectors.delete(_collection(t), _changes(t), where={"label": 4})


#: Four token vectors of 16 elements per embedding; the last is masked in odd ones.
TOKENS = "(SELECT vec_id, k, pos, embedding[k * 16 + pos + 1]::DOUBLE AS x, CASE WHEN vec_id % 2 = 1 AND k = 3 THEN 0 ELSE 1 END AS m FROM embeddings, unnest(range(4)) AS a(k), unnest(range(16)) AS b(pos))"


def _pooled(t, how):
    v = V.doubles(F.col("embedding"))
    tokens = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.slice(v, k * 16 + 1, F.lit(16)))
    mask = F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.when(F.col("vec_id") % 2 == 1, 0.0).otherwise(1.0))
    out = t("embeddings").select("vec_id", tokens.alias("tokens"), mask.alias("mask"))
    out = out.select("vec_id", F.posexplode(V.pool(F.col("tokens"), F.col("mask"), how)).alias("pos", "x"))
    return out.select("vec_id", F.col("pos").cast("bigint").alias("pos"), F.round("x", 6).alias("x"))


for _how, _sql in (("mean", "sum(x * m) / greatest(sum(m), 1e-9)"), ("cls", "max(CASE WHEN k = 0 THEN x END)"), ("max", "max(CASE WHEN m = 1 THEN x ELSE -1e9 END)")):
    query(f"SELECT vec_id, pos, round({_sql}, 6) AS x FROM {TOKENS} GROUP BY vec_id, pos", f"pool_{_how}")(lambda t, how=_how: _pooled(t, how))
