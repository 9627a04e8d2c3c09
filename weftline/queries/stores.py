"""Key-value tables, conversation memory."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kv, memory
from ._registry import query

#: The moment of every query, in epoch seconds: 2024-01-15 00:00:00.
NOW = 1_705_276_800.0
#: Entries of users: the last event type is the value, odd events expire five days after their time.
LOG = (
    "(SELECT user_id AS key, event_type AS value, event_id AS seq, CASE WHEN event_id % 2 = 1 THEN epoch(ts) + 432000 END AS expires_at FROM events)"
)
LATEST = f"(SELECT key, arg_max(value, seq) AS value, max(seq) AS seq, first(expires_at ORDER BY seq DESC) AS expires_at FROM {LOG} GROUP BY key)"
LIVE = f"(SELECT * FROM {LATEST} WHERE expires_at IS NULL OR expires_at > {NOW})"


def log(t):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return t("events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 2 == 1, at + 432000).alias("expires_at"))


def keys(t):
    """Every key of the log, and three that it lacks."""
    return t("events").select(F.col("user_id").alias("key")).distinct().unionByName(t.spark.range(-3, 0).select(F.col("id").cast("long").alias("key")))


KEYS = "(SELECT user_id AS key FROM events UNION SELECT unnest([-3, -2, -1]))"


@query(f"SELECT k.key, l.value FROM {KEYS} k LEFT JOIN {LIVE} l ON k.key = l.key")
def kv_get(t):
    return kv.get(keys(t), log(t), NOW)


@query(f"SELECT k.key, l.key IS NOT NULL AS exists FROM {KEYS} k LEFT JOIN {LIVE} l ON k.key = l.key")
def kv_exists(t):
    return kv.exists(keys(t), log(t), NOW)


@query(f"SELECT k.key, coalesce(n.value, l.value) AS value FROM {KEYS} k LEFT JOIN {LIVE} l ON k.key = l.key LEFT JOIN (SELECT unnest(range(5)) AS key, 'new' AS value) n ON k.key = n.key")
def kv_set_latest(t):
    new = t.spark.range(0, 5).select(F.col("id").alias("key"), F.lit("new").alias("value"), F.lit(1 << 40).alias("seq"))
    return kv.get(keys(t), kv.put(log(t), new, NOW, F.lit(60.0)), NOW)


@query(f"SELECT k.key, l.key IS NOT NULL AS deleted FROM {KEYS} k LEFT JOIN {LIVE} l ON k.key = l.key")
def kv_delete(t):
    return kv.delete(log(t), keys(t), NOW)[1]


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 'plain ' || event_id AS raw FROM events")
def kv_json_roundtrip(t):
    df = t("events").withColumn("stored", F.to_json(F.struct(F.from_json("props", "k bigint").alias("v"))))
    return df.select("event_id", F.try_variant_get(F.try_parse_json("stored"), "$.v.k", "bigint").alias("k"), F.coalesce(F.try_variant_get(F.try_parse_json(F.concat(F.lit("plain "), F.col("event_id"))), "$", "string"), F.concat(F.lit("plain "), F.col("event_id"))).alias("raw"))


def messages(t):
    return t("conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", F.length("text").alias("size"))


@query("SELECT conv_id AS session_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3")
def memory_window_turns(t):
    return memory.window(messages(t), max_turns=3).select("session_id", "turn", "role")


#: Two messages make a turn here.
PAIRS = "(SELECT conv_id AS session_id, turn // 2 AS turn, turn AS seq, role FROM conversations)"


@query(f"SELECT m.session_id, m.turn, m.seq, m.role FROM {PAIRS} m JOIN (SELECT session_id, turn, sum(n) OVER w AS s, row_number() OVER w AS r FROM (SELECT session_id, turn, count(*) AS n FROM {PAIRS} GROUP BY ALL) WINDOW w AS (PARTITION BY session_id ORDER BY turn DESC)) x ON m.session_id = x.session_id AND m.turn = x.turn WHERE x.s <= 3 OR x.r = 1")
def memory_window_messages(t):
    rows = t("conversations").select(F.col("conv_id").alias("session_id"), F.floor(F.col("turn") / 2).alias("turn"), F.col("turn").alias("seq"), "role")
    return memory.window(rows, max_messages=3)


@query("SELECT session_id, turn, role FROM (SELECT conv_id AS session_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 4")
def memory_load(t):
    wanted = t("conversations").select(F.col("conv_id").alias("session_id")).distinct()
    return memory.load(messages(t), wanted, max_turns=4).select("session_id", "turn", "role")


@query("SELECT conv_id AS session_id, count(*) + 1 AS n, max(turn) + 1 AS last FROM conversations GROUP BY conv_id")
def memory_append(t):
    m = messages(t)
    new = m.select("session_id").distinct().withColumns({"role": F.lit("user"), "size": F.lit(1)})
    return memory.append(m, new).groupBy("session_id").agg(F.count("*").alias("n"), F.max("turn").alias("last"))


@query("SELECT conv_id AS session_id, turn, role FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE turn >= 4)")
def memory_forget_restore(t):
    saved = memory.snapshot(messages(t), 1).unionByName(memory.snapshot(messages(t).where("turn = 0"), 2).where("false"))
    gone = t("conversations").where("turn >= 4").select(F.col("conv_id").alias("session_id"))
    return memory.forget(memory.restore(saved), gone).select("session_id", "turn", "role")
