"""Full-text index and phrase search with BM25."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Constants of the score.
K1, B = 1.2, 0.75


#: Accented Latin letters, by the plain letter that a search takes them for.
ACCENTED = {
    "a": "àáâãäåāăąǎ", "c": "çćĉċč", "d": "ď", "e": "èéêëēĕėęě", "g": "ĝğġģ", "h": "ĥ", "i": "ìíîïĩīĭįǐ", "j": "ĵ", "k": "ķ", "l": "ĺļľ",
    "n": "ñńņň", "o": "òóôõöōŏőǒ", "r": "ŕŗř", "s": "śŝşšș", "t": "ţťț", "u": "ùúûüũūŭůűųǔ", "w": "ŵ", "y": "ýÿŷ", "z": "źżž",
}


def terms(text: Column, fold: bool = True) -> Column:
    """Lower-case runs of letters, marks and digits; none for null. With ``fold``, accents are stripped:
    those of Latin letters and all combining marks."""
    low = F.lower(F.coalesce(text, F.lit("")))
    if fold:
        low = F.translate(low, "".join(ACCENTED.values()), "".join(k * len(v) for k, v in ACCENTED.items()))
        low = F.regexp_replace(low, r"\p{Mn}+", "")
    return F.regexp_extract_all(low, F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))


def upsert(documents: DataFrame, new: DataFrame, id_column: str = "id", order: str = "seq") -> DataFrame:
    """Documents where the last of the new ones replaces those of equal id."""
    last = new.groupBy(id_column).agg(F.max_by(F.struct(*[c for c in documents.columns if c != id_column]), order).alias("__d"))
    last = last.select(id_column, *[F.col(f"__d.{c}").alias(c) for c in documents.columns if c != id_column])
    return documents.join(last, id_column, "left_anti").unionByName(last)


def delete(documents: DataFrame, ids: DataFrame, id_column: str = "id") -> tuple[DataFrame, DataFrame]:
    """(documents without the ids, one row with how many of them existed)."""
    gone = ids.select(id_column).distinct()
    return documents.join(gone, id_column, "left_anti"), documents.join(gone, id_column, "left_semi").agg(F.countDistinct(id_column).alias("affected"))


def index_stats(documents: DataFrame, fields: Sequence[str], id_column: str = "id") -> DataFrame:
    """term, documents (with it) and occurrences, over the fields."""
    rows = documents.select(id_column, F.explode(F.concat(*[terms(F.col(f)) for f in fields])).alias("term"))
    return rows.groupBy("term").agg(F.countDistinct(id_column).alias("documents"), F.count("*").alias("occurrences"))


def phrase_hits(documents: DataFrame, queries: DataFrame, field: str, id_column: str = "id") -> DataFrame:
    """query_id, id, tf, length of documents that hold the query's terms as a phrase.

    Windows of a document's terms are hashed once per length that a query has, and hash-joined with
    the queries, so the work does not grow with their number; overlapping occurrences all count.
    """
    side = queries.select("query_id", terms(F.col("query")).alias("__terms")).where(F.size("__terms") > 0)
    side = side.select("query_id", F.size("__terms").alias("__width"), F.xxhash64(F.transform("__terms", lambda x: F.xxhash64(x))).alias("__hash"))
    body = documents.select(id_column, F.transform(terms(F.col(field)), lambda x: F.xxhash64(x)).alias("__h"))
    widths = sorted(w for (w,) in map(tuple, side.select("__width").distinct().collect()))
    of = lambda w: F.transform(_windows(F.slice("__h", F.lit(1), F.greatest(F.size("__h") - (w - 1), F.lit(0))), w), lambda h: F.struct(F.lit(w).alias("__width"), h.alias("__hash")))
    hashes = F.concat(*map(of, widths)) if widths else F.array().cast("array<struct<__width:int,__hash:bigint>>")
    rows = body.select(id_column, F.size("__h").alias("length"), F.explode(hashes).alias("__x")).select(id_column, "length", "__x.*")
    out = rows.join(side.select("query_id", "__width", "__hash"), ["__width", "__hash"])
    return out.groupBy("query_id", id_column, "length").agg(F.count("*").alias("tf")).select("query_id", id_column, "tf", "length")


def _windows(starts: Column, width: int) -> Column:
    """Hashes of all windows of ``width`` terms, from the terms' hashes in ``__h``."""
    return F.transform(starts, lambda _, i: F.xxhash64(F.slice("__h", i + 1, F.lit(width))))


def bm25(documents: DataFrame, queries: DataFrame, field: str, limit: int = 10, id_column: str = "id") -> DataFrame:
    """query_id, rank, id, score of the best documents per phrase query; ties go to the smaller id.

    A phrase counts as one term: idf = ln((total - n + 0.5) / (n + 0.5)), at least 1e-6.
    """
    hits = phrase_hits(documents, queries, field, id_column)
    stats = documents.agg(F.count("*").alias("total"), F.avg(F.size(terms(F.col(field)))).alias("avgdl"))
    n = hits.groupBy("query_id").agg(F.count("*").alias("n"))
    rows = hits.join(n, "query_id").crossJoin(F.broadcast(stats))  # stats is one row
    idf = F.greatest(F.log((F.col("total") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(1e-6))
    score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avgdl")))
    rows = rows.withColumn("score", score)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(id_column))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "rank", id_column, "score")
