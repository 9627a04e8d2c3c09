"""Full-text search, reranking and fuzzy similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import align, search
from ._registry import query

TERMS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{M}}\\p{{N}}]+')"
DOC_TERMS = TERMS.format("text")
#: The index folds accents.
FOLDED = TERMS.format("strip_accents(text)")
#: Queries: two neighbouring words of each benchmark item.
PHRASES = f"(SELECT item_id AS query_id, list_slice({FOLDED}, 3, 4) AS q FROM benchmark)"
BODY = f"(SELECT doc_id, {FOLDED} AS t, ' ' || array_to_string({FOLDED}, ' ') || ' ' AS body FROM documents)"
HITS = f"(SELECT query_id, doc_id, len(list_filter(range(1, len(t) - len(q) + 2), lambda i: t[i:i + len(q) - 1] = q)) AS tf, len(t) AS length FROM {BODY} b JOIN {PHRASES} p ON len(q) > 0 AND contains(body, ' ' || array_to_string(q, ' ') || ' '))"


def phrases(t):
    return t("benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(search.terms(F.col("text")), 3, 2), " ").alias("query"))


@query(f"SELECT doc_id, len({DOC_TERMS}) AS n_terms, array_to_string({DOC_TERMS}, ' ') AS terms FROM documents")
def word_tokens(t):
    words = T.word_tokens(F.col("text"))
    return t("documents").select("doc_id", F.size(words).cast("bigint").alias("n_terms"), F.array_join(words, " ").alias("terms"))


@query(f"SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS occurrences FROM (SELECT doc_id, unnest({FOLDED}) AS term FROM documents) GROUP BY term")
def fts_index_stats(t):
    return search.index_stats(t("documents"), ["text"], "doc_id")


@query(f"SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS occurrences FROM (SELECT doc_id, unnest({FOLDED}) AS term FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark)) GROUP BY term")
def fts_delete(t):
    left, _ = search.delete(t("documents"), t("benchmark").select(F.col("item_id").alias("doc_id")), "doc_id")
    return search.index_stats(left, ["text"], "doc_id")


@query("SELECT doc_id, CASE WHEN b.item_id IS NULL THEN d.text ELSE b.text END AS text FROM documents d LEFT JOIN benchmark b ON d.doc_id = b.item_id")
def fts_upsert(t):
    new = t("benchmark").select(F.col("item_id").alias("doc_id"), "text", F.lit(1).alias("seq")).unionByName(t("benchmark").select(F.col("item_id").alias("doc_id"), F.lit("stale").alias("text"), F.lit(0).alias("seq")))
    return search.upsert(t("documents").select("doc_id", "text"), new, "doc_id")


@query(f"SELECT query_id, doc_id, tf::BIGINT AS tf, length::BIGINT AS length FROM {HITS}")
def fts_phrase(t):
    out = search.phrase_hits(t("documents"), phrases(t), "text", "doc_id")
    return out.select("query_id", "doc_id", F.col("tf").cast("bigint").alias("tf"), F.col("length").cast("bigint").alias("length"))


@query(
    f"WITH hits AS {HITS}, stats AS (SELECT count(*) AS total, avg(len({FOLDED})) AS avgdl FROM documents), n AS (SELECT query_id, count(*) AS n FROM hits GROUP BY query_id), "
    "scored AS (SELECT hits.query_id, doc_id, greatest(ln((total - n.n + 0.5) / (n.n + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / avgdl)) AS s FROM hits JOIN n ON hits.query_id = n.query_id, stats) "
    "SELECT query_id, rank, doc_id, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM scored) WHERE rank <= 10"
)
def fts_bm25(t):
    out = search.bm25(t("documents"), phrases(t), "text", 10, "doc_id")
    return out.select("query_id", F.col("rank").cast("bigint").alias("rank"), "doc_id", F.round("score", 6).alias("score"))


@query("SELECT a.p_partkey, round(1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)), 6) AS similarity FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def fuzzy_similarity(t):
    p = t("part").select("p_partkey", "p_name")
    other = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return p.join(other, "p_partkey").select("p_partkey", F.round(T.similarity(F.col("p_name"), F.col("other")), 6).alias("similarity"))


@query(
    "WITH c AS (SELECT n_nationkey AS q, n_name, r_name, 1 - levenshtein(n_name, r_name) / greatest(length(n_name), length(r_name)) AS s FROM nation, region), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, r_name) AS rank FROM c) SELECT q, r_name, rank, round(s, 6) AS score FROM r WHERE s >= 0.1 AND rank <= 2"
)
def rerank_topk(t):
    pairs = t("nation").select(F.col("n_nationkey").alias("q"), "n_name").crossJoin(F.broadcast(t("region").select("r_name")))
    out = align.rerank(pairs, ["q"], T.similarity(F.col("n_name"), F.col("r_name")), 0.1, 2, ["r_name"])
    return out.select("q", "r_name", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))
