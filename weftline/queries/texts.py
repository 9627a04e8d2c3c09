"""Chunks, sentences, HTML, alignment, and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import models
from ..functions import text as T
from ..operators import align
from ..sources import files
from ..streaming import steps
from ._registry import query


@query()
def text_chunks(t):
    return t("documents").select("doc_id", F.posexplode(T.chunks(F.col("text"), 500, 100)).alias("pos", "chunk"))


ENDS = "[.!?。！？…\n]"


@query(
    f"SELECT doc_id, count(*) AS n, sum(length(s))::BIGINT AS chars FROM (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(text, '[^.!?。！？…\n]*{ENDS}+|[^.!?。！？…\n]+')), '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g') AS s FROM documents) WHERE regexp_replace(s, '[.!?。！？…\\s]', '', 'g') <> '' GROUP BY doc_id"
)
def sentences_basic(t):
    rows = t("documents").select("doc_id", F.explode(T.basic_sentences(F.col("text"))).alias("s"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("s")).alias("chars"))


@query()
def sentences_minmax(t):
    return t("documents").select("doc_id", F.posexplode(T.sentence_list(F.col("text"), 40, 200)).alias("pos", "sentence"))


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')) AS n_tokens FROM documents")
def token_count(t):
    return t("documents").select("doc_id", F.size(F.filter(F.split("text", r"[ \t\n\r\f\x0B]+"), lambda x: x != "")).cast("bigint").alias("n_tokens"))


@query()
def html_text(t):
    return t("pages").select("page_id", T.html_page_text(F.col("html")).alias("text"))


@query("SELECT page_id, (i - 1)::INT AS pos, l[i] AS href FROM (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a href=\"([^\"]*)\"', 1) AS l FROM pages), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)")
def html_links(t):
    return t("pages").select("page_id", F.posexplode(T.html_select(F.col("html"), "nav a[href]", "attribute", "href")).alias("pos", "href"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&quot;?', '\"', 'g'), '&amp;?', '&', 'g')) AS title FROM pages")
def html_title(t):
    return t("pages").select("page_id", F.get(T.html_select(F.col("html"), "title"), F.lit(0)).alias("title"))


@query()
def transcript_align(t):
    """Whole texts as references; of every 24 words, 8 were heard."""
    words = F.split("text", r"\s+")
    starts = F.sequence(F.lit(0), F.floor((F.size(words) - 1) / 24).cast("int"))
    heard = F.transform(starts, lambda k: F.struct(F.array_join(F.slice(words, k * 24 + 1, F.lit(8)), " ").alias("text"), (k * 12.0).alias("start_time"), (k * 12.0 + 4).alias("end_time")))
    return align.align_transcripts(t("documents").select("doc_id", heard.alias("segments"), F.col("text").alias("reference")), "doc_id")


def _folder(t):
    return files.scratch(t.spark, "stream")


def _stream(t, table, **options):
    return steps.source(t.spark, f"{t.dir}/{table}.parquet*", t(table).schema, **options)


@query("SELECT event_id, event_type AS kind FROM events WHERE value > 90")
def stream_filter_map(t):
    stream = steps.map_stream(steps.filter_stream(_stream(t, "events"), {"input": "${value}", "operator": "gt", "value": 90}), {"event_id": "${event_id}", "kind": "${event_type}"})
    return steps.run_available(stream, f"s{uuid.uuid4().hex}", _folder(t))


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def stream_join_text(t):
    """The turns of conversations as fragments of a stream; the last turn of each is known beforehand."""
    ends = t("conversations").groupBy("conv_id").agg(F.max("turn").alias("__end"))
    stream = _stream(t, "conversations").join(ends, "conv_id").withColumn("__last", F.col("turn") == F.col("__end"))
    out = steps.join_fragments(stream.withColumn("turn", F.col("turn").cast("long")), "conv_id", "turn", "text", "__last")
    return steps.run_available(out, f"s{uuid.uuid4().hex}", _folder(t))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(t):
    stream = _stream(t, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = steps.windowed_counts(stream, "ts", "1 day", None, "2 days", ["event_type"])
    return steps.run_available(out, f"s{uuid.uuid4().hex}", _folder(t), "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(
    "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS o FROM events), "
    "g AS (SELECT user_id, ts, sum(o) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS start, max(ts) AS \"end\", count(*) AS n FROM g GROUP BY user_id, k"
)
def session_windows(t):
    rows = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = steps.sessions(rows, "ts", "6 hours", "1 day", ["user_id"])
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query()
def model_embedding(t):
    return t("benchmark").select("item_id", models.infer("text-embedding", "hashing", F.col("text")).alias("embedding"))


@query("SELECT doc_id, CASE WHEN len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')) >= 100 THEN 'long' ELSE 'short' END AS label FROM documents")
def model_classification(t):
    return t("documents").select("doc_id", models.infer("text-classification", "length", F.col("text"))["label"].alias("label"))
