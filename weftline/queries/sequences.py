"""Sequence analytics on events per user."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import media
from ..operators import sequence
from ._registry import query

EVENTS = "(SELECT event_id, user_id, event_type, value, epoch(ts)::DOUBLE AS s FROM events)"


def events(t):
    return t("events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


HOUR = 3600.0


@query(
    f"WITH i AS (SELECT user_id, s, s + value * 60 AS e FROM {EVENTS}), m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM i), "
    "g AS (SELECT *, sum(CASE WHEN b IS NULL OR s - b > 7200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM m) "
    'SELECT user_id, round(min(s), 3) AS start, round(max(e), 3) AS "end", count(*) AS n FROM g GROUP BY user_id, isl HAVING max(e) - min(s) >= 600'
)
def merge_gap_intervals(t):
    df = events(t).select("user_id", "s", (F.col("s") + F.col("value") * 60).alias("e"))
    out = sequence.merge_gaps(df, "user_id", "s", "e", 7200.0, 600.0)
    return out.select("user_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "n")


@query(
    f"WITH l AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) <= 21600 + 1e-6 THEN 0 ELSE 1 END AS o FROM {EVENTS}), "
    "g AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) - 1 AS seg FROM l) "
    'SELECT user_id, seg::BIGINT AS segment, min(s) AS start, max(s) AS "end", count(*) AS n, first(event_id ORDER BY value DESC, s, event_id) AS best FROM g GROUP BY user_id, seg HAVING count(*) >= 2'
)
def segments_merge_gap(t):
    return sequence.segments(events(t), "user_id", "s", 18000.0, 3600.0, 2, "value", "event_id", ["event_id"])


@query(
    f"WITH f AS (SELECT *, value > 50 AS h FROM {EVENTS}), c AS (SELECT *, CASE WHEN h = lag(h) OVER (PARTITION BY user_id ORDER BY s, event_id) THEN 0 ELSE 1 END AS o FROM f), "
    "g AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS r FROM c) "
    'SELECT user_id, min(s) AS start, max(s) AS "end", count(*) AS n, max(s) - min(s) AS duration FROM g WHERE h GROUP BY user_id, r HAVING max(s) - min(s) >= 3600'
)
def threshold_intervals(t):
    return sequence.threshold_intervals(events(t), "user_id", "s", F.col("value") > 50, HOUR, ["event_id"])


@query(
    f"WITH c AS (SELECT *, CASE WHEN abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY s, event_id)) > 60 THEN 1 ELSE 0 END AS o FROM {EVENTS}) "
    "SELECT event_id, sum(o) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS scene FROM c"
)
def change_point_segments(t):
    return sequence.change_points(events(t), "user_id", "s", "value", 60.0, ["event_id"]).select("event_id", "scene")


@query("SELECT user_id, (event_id // 50) AS bucket, round(sqrt(avg(value * value)) * sign(avg(value)), 6) AS value FROM events GROUP BY ALL")
def waveform_rms(t):
    return sequence.waveform(events(t), ["user_id"], "event_id", "value", 50, "rms", True).withColumn("value", F.round("value", 6))


@query("SELECT user_id, (event_id // 50) AS bucket, max(abs(value)) AS value FROM events GROUP BY ALL")
def waveform_peak(t):
    return sequence.waveform(events(t), ["user_id"], "event_id", "value", 50, "peak")


@query(
    "WITH p AS (SELECT user_id, floor(epoch(ts) / 3600)::BIGINT AS h, avg(value) AS value FROM events GROUP BY ALL), "
    "e AS (SELECT *, lead(h) OVER w AS h2, lead(value) OVER w AS v2 FROM p WINDOW w AS (PARTITION BY user_id ORDER BY h)), "
    "f AS (SELECT user_id, h, value, h2, v2, unnest(range(h + 1, h2)) AS pos FROM e WHERE h2 - h > 1 AND h2 - h <= 6) "
    "SELECT user_id, h AS hour, round(value, 5) AS value, false AS filled FROM p UNION ALL SELECT user_id, pos, round(value + (v2 - value) * ((pos - h) / (h2 - h)), 5), true FROM f"
)
def gap_interpolate(t):
    df = events(t).select("user_id", F.floor(F.col("s") / 3600).alias("hour"), "value")
    return sequence.interpolate(df, "user_id", "hour", "value", 1, 6).withColumn("value", F.round("value", 5))


@query("SELECT event_id, x AS span FROM events, (VALUES (0, 10, 200), (1, 150, 400), (2, 900, 901)) v(x, a, b) WHERE event_id >= a AND event_id < b")
def clip_spans(t):
    spans = t.spark.createDataFrame([(0, 10, 200), (1, 150, 400), (2, 900, 901)], "span int, start long, end long")
    return sequence.clip(t("events").select("event_id"), "event_id", spans).select("event_id", "span")


@query(
    "WITH g AS (SELECT event_type, avg(value) AS mean, min(value) AS min, max(value) AS max, stddev_pop(value) AS std, sqrt(avg(value * value)) AS rms, quantile_cont(value, 0.01) AS p01, quantile_cont(value, 0.99) AS p99, count(*) AS n, count(*) FILTER (value <= 1) AS n_low, count(*) FILTER (value >= 99) AS n_high FROM events GROUP BY event_type) "
    "SELECT event_type, round(mean, 5) AS mean, min, max, round(std, 5) AS std, round(rms, 5) AS rms, round(p01, 5) AS p01, round(p99, 5) AS p99, n, n_low, n_high, round((p99 - p01) / (p99 + p01), 5) AS contrast FROM g"
)
def numeric_profile(t):
    out = sequence.profile(t("events"), "value", ["event_type"], 1.0, 99.0)
    return out.select("event_type", *[F.round(c, 5).alias(c) if c in ("mean", "std", "rms", "p01", "p99", "contrast") else F.col(c) for c in out.columns if c != "event_type"])


@query("SELECT user_id, round(avg(value), 5) AS mean, min(value) AS min, max(value) AS max, round(stddev_pop(value), 5) AS std FROM events GROUP BY user_id")
def timeline_summary(t):
    out = sequence.profile(t("events"), "value", ["user_id"])
    return out.select("user_id", F.round("mean", 5).alias("mean"), "min", "max", F.round("std", 5).alias("std"))


@query()
def vad_segments(t):
    df = events(t).select("user_id", "s", (F.col("value") / 100).alias("p"))
    return sequence.speech_segments(df, "user_id", "s", "p", threshold=0.5, low=0.35, min_silence=HOUR, min_speech=HOUR)


@query()
def spectrum_bands(t):
    return sequence.spectrum_bands(t("events"), "user_id", "event_id", "value", 64, 32, 4)


@query()
def face_tracks(t):
    e = t("embeddings").select(F.lit("v").alias("video"), F.floor(F.col("vec_id") / 4).cast("double").alias("ts"), F.col("embedding").cast("array<double>").alias("embedding"), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("box"), "vec_id", (F.col("vec_id") % 8).cast("string").alias("clip"))
    return sequence.assign_tracks(e, "clip", "ts", "embedding", "box", 0.3).select("vec_id", "track")


@query(
    "WITH g AS (SELECT vec_id, i, embedding[i + 1] AS x, i // 8 AS r, i % 8 AS c, len(embedding) // 8 AS h FROM embeddings, LATERAL (SELECT unnest(range(len(embedding))) AS i)), "
    "l AS (SELECT a.vec_id, a.x, CASE WHEN a.r BETWEEN 1 AND a.h - 2 AND a.c BETWEEN 1 AND 6 THEN n.x + s.x + w.x + e.x - 4 * a.x ELSE 0 END AS d FROM g a "
    "LEFT JOIN g n ON n.vec_id = a.vec_id AND n.i = a.i - 8 LEFT JOIN g s ON s.vec_id = a.vec_id AND s.i = a.i + 8 LEFT JOIN g w ON w.vec_id = a.vec_id AND w.i = a.i - 1 LEFT JOIN g e ON e.vec_id = a.vec_id AND e.i = a.i + 1) "
    "SELECT vec_id, round(avg(x::DOUBLE), 5) AS mean, round(stddev_pop(x::DOUBLE), 5) AS std, round(var_pop(d::DOUBLE), 5) AS sharpness FROM l GROUP BY vec_id"
)
def image_sharpness(t):
    """Embeddings taken as pictures eight pixels wide."""
    v = F.col("embedding").cast("array<double>")
    rows = F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / 8).cast("int") - 1), lambda k: F.slice(v, k * 8 + 1, F.lit(8)))
    m = t("embeddings").select("vec_id", media.image_measures(rows).alias("m"))
    return m.select("vec_id", F.round("m.mean", 5).alias("mean"), F.round("m.std", 5).alias("std"), F.round("m.laplacian_variance", 5).alias("sharpness"))


@query("SELECT user_id, round(20 * log10(max(abs(value / 100))), 5) AS peak, round(20 * log10(sqrt(avg((value / 100) ** 2))), 5) AS rms, round(avg(value / 100), 5) AS dc_offset, count(*) FILTER (value >= 99) AS clipped FROM events GROUP BY user_id HAVING max(abs(value)) > 0")
def audio_levels(t):
    """Values of users taken as samples; a missing value is no sample."""
    samples = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: x["value"] / 100)
    m = t("events").where("value is not null").groupBy("user_id").agg(samples.alias("samples")).select("user_id", media.audio_measures(F.col("samples"), 100, 0.99).alias("m")).where("m.sample_peak_dbfs is not null")
    rounded = lambda c: F.round(F.col(c) * 1e5) / 1e5  # noqa: E731  of the double as SQL rounds, not of its shortest decimals
    return m.select("user_id", rounded("m.sample_peak_dbfs").alias("peak"), rounded("m.rms_dbfs").alias("rms"), rounded("m.dc_offset").alias("dc_offset"), F.col("m.clipped_sample_count").alias("clipped"))
