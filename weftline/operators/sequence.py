"""Analytics on ordered rows: gaps and islands, intervals, hopping summaries, interpolation.

All windows are partitioned by a key of the data. Times are seconds (double).
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_gaps(df: DataFrame, key: str, start: str, end: str, gap: float, min_duration: float = 0.0) -> DataFrame:
    """key, start, end, n of intervals merged where the next starts within ``gap`` of the running end.

    A gap of 0 merges nothing. Merged intervals shorter than ``min_duration`` are dropped.
    """
    order = Window.partitionBy(key).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col(start) - before > gap) | F.lit(gap <= 0), 1).otherwise(0)
    marked = df.withColumn("__open", opens).withColumn("__island", F.sum("__open").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = marked.groupBy(key, "__island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n")).drop("__island")
    return out.where(F.col("end") - F.col("start") >= min_duration)


def segments(df: DataFrame, key: str, ts: str, gap: float, period: float = 0.0, min_count: int = 1, score: str | None = None, best: str | None = None, tie: Sequence[str] = ()) -> DataFrame:
    """key, start, end, n (and best) of runs whose neighbours lie within ``period + gap``.

    ``best`` is the value of the row with the highest score, the earliest of ties.
    """
    order = Window.partitionBy(key).orderBy(ts, *tie)
    opens = F.when(F.col(ts) - F.lag(ts).over(order) <= period + gap + 1e-6, 0).otherwise(1)
    marked = df.withColumn("__open", opens).withColumn("segment", F.sum("__open").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    parts = [F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n")]
    if best is not None:
        rank = F.struct(F.col(score), -F.col(ts), *[-F.col(t) for t in tie])
        parts.append(F.max_by(best, rank).alias("best"))
    return marked.groupBy(key, "segment").agg(*parts).where(F.col("n") >= min_count)


def threshold_intervals(df: DataFrame, key: str, ts: str, holds: Column, min_duration: float = 0.0, tie: Sequence[str] = ()) -> DataFrame:
    """key, start, end, duration, n of runs of rows where a condition holds, of a duration at least."""
    order = Window.partitionBy(key).orderBy(ts, *tie)
    rows = df.withColumn("__on", F.coalesce(holds, F.lit(False)))
    rows = rows.withColumn("__turn", F.when(F.col("__on") == F.lag("__on").over(order), 0).otherwise(1))
    rows = rows.withColumn("__run", F.sum("__turn").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("__on")
    out = rows.groupBy(key, "__run").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n")).drop("__run")
    return out.withColumn("duration", F.col("end") - F.col("start")).where(F.col("duration") >= min_duration)


def interval_summary(intervals: DataFrame, spans: DataFrame, key: str, length: str) -> DataFrame:
    """key, total, ratio of the intervals' durations over each key's whole length (0 if unknown)."""
    total = intervals.groupBy(key).agg(F.sum("duration").alias("total"))
    out = spans.join(total, key, "left").withColumn("total", F.coalesce("total", F.lit(0.0)))
    return out.withColumn("ratio", F.when(F.col(length) > 0, F.col("total") / F.col(length)).otherwise(0.0)).select(key, "total", "ratio")


def change_points(df: DataFrame, key: str, ts: str, value: str, threshold: float, tie: Sequence[str] = ()) -> DataFrame:
    """Adds the number of the scene: a jump of the value beyond the threshold opens a new one."""
    order = Window.partitionBy(key).orderBy(ts, *tie)
    cut = F.when(F.abs(F.col(value) - F.lag(value).over(order)) > threshold, 1).otherwise(0)
    return df.withColumn("__cut", cut).withColumn("scene", F.sum("__cut").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__cut")


def waveform(df: DataFrame, key: Sequence[str], pos: str, value: str, bucket: int, how: str = "rms", signed: bool = False) -> DataFrame:
    """key, bucket, value: peak or root mean square of ``bucket`` neighbouring samples each.

    Signed peaks keep the sign of the larger magnitude, signed rms that of the mean.
    """
    grouped = df.groupBy(*key, F.floor(F.col(pos) / bucket).alias("bucket"))
    if how == "rms":
        out = F.sqrt(F.avg(F.col(value) * F.col(value)))
        out = out * F.signum(F.avg(value)) if signed else out
    else:
        out = F.max_by(value, F.struct(F.abs(value), value)) if signed else F.max(F.abs(value))
    return grouped.agg(out.alias("value"))


def interpolate(df: DataFrame, key: str, ts: str, value: str, step: int, max_gap: int) -> DataFrame:
    """Rows (key, ts, value, filled) with missing steps inside gaps up to ``max_gap`` filled linearly.

    ``ts`` is an integer grid of width ``step``; equal times are averaged first.
    """
    points = df.groupBy(key, ts).agg(F.avg(value).alias(value))
    order = Window.partitionBy(key).orderBy(ts)
    ends = points.withColumns({"__to": F.lead(ts).over(order), "__next": F.lead(value).over(order)})
    gap = F.col("__to") - F.col(ts)
    inner = F.when((gap > step) & (gap <= max_gap), F.sequence(F.col(ts) + step, F.col("__to") - 1, F.lit(step).cast(points.schema[ts].dataType)))
    filled = ends.select(key, F.col(ts).alias("__from"), value, "__to", "__next", F.explode(inner).alias("__at"))
    share = (F.col("__at") - F.col("__from")) / (F.col("__to") - F.col("__from"))
    filled = filled.select(key, F.col("__at").alias(ts), (F.col(value) + (F.col("__next") - F.col(value)) * share).alias(value), F.lit(True).alias("filled"))
    return points.select(key, ts, value, F.lit(False).alias("filled")).unionByName(filled)


def clip(df: DataFrame, ts: str, spans: DataFrame) -> DataFrame:
    """Rows whose time lies in [start, end) of a span; ``spans``: span, start, end (start < end).

    Time is cut into buckets of the spans' mean length; a span is sent to the buckets that it touches
    (about three per span over all), and rows meet only the spans of their own bucket.
    """
    good = spans.where(F.when(F.col("end") > F.col("start"), True).otherwise(F.raise_error(F.lit("a span must end after its start")).cast("boolean")))
    mean = good.agg(F.avg(F.col("end") - F.col("start"))).first()[0]
    width = F.lit(float(mean or 1.0))
    of = lambda c: F.floor(c / width)
    good = good.withColumn("__bucket", F.explode(F.sequence(of(F.col("start")), of(F.col("end")))))
    rows = df.withColumn("__at", of(F.col(ts)))
    return rows.join(good, (F.col("__at") == F.col("__bucket")) & (F.col(ts) >= F.col("start")) & (F.col(ts) < F.col("end"))).drop("__at", "__bucket")


def profile(df: DataFrame, value: str, group: Sequence[str] = (), low: float | None = None, high: float | None = None) -> DataFrame:
    """mean, min, max, std (population), rms, p01, p99 (exact, interpolated), contrast and clipped counts
    of a measure."""
    v = F.col(value)
    parts = [F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_pop(v).alias("std"), F.sqrt(F.avg(v * v)).alias("rms"), F.count(v).alias("n")]
    parts += [F.count_if(v <= low).alias("n_low")] if low is not None else []
    parts += [F.count_if(v >= high).alias("n_high")] if high is not None else []
    out = df.groupBy(*group).agg(*parts)
    places = percentiles(df, value, {"p01": 0.01, "p99": 0.99}, group)
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)], F.lit(True))
    out = out.join(F.broadcast(places) if not group else places, same, "left").drop(*[f"__g{i}" for i in range(len(group))])
    return out.withColumn("contrast", F.when(F.col("p99") + F.col("p01") != 0, (F.col("p99") - F.col("p01")) / (F.col("p99") + F.col("p01"))).otherwise(0.0))


#: Groups of up to this many values are ranked whole; of larger ones, only values within this share of a
#: wanted place on both sides. The sketch that finds them is ten times as accurate.
RANKED, NEAR = 10_000, 0.001


def percentiles(df: DataFrame, value: str, wanted: Mapping[str, float], group: Sequence[str] = ()) -> DataFrame:
    """__g0, __g1, ... (the group) and the exact interpolated percentiles of its values.

    A mergeable sketch brackets each place, values below a bracket are counted map-side, and only the
    distinct values inside it are ranked, so that no task holds a group's values.
    """
    keys = [F.col(g).alias(f"__g{i}") for i, g in enumerate(group)]
    names = [f"__g{i}" for i in range(len(group))]
    rows = df.select(*keys, F.col(value).cast("double").alias("__v")).where("__v is not null")
    near = [x for q in wanted.values() for x in (max(q - NEAR, 0.0), min(q + NEAR, 1.0))]
    sketch = rows.groupBy(*names).agg(F.count("*").alias("__n"), F.percentile_approx("__v", near, int(10 / NEAR)).alias("__q"))
    brackets = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(q).alias("q"), F.when(F.col("__n") > RANKED, F.col("__q")[2 * i]).otherwise(F.lit(float("-inf"))).alias("low"), F.when(F.col("__n") > RANKED, F.col("__q")[2 * i + 1]).otherwise(F.lit(float("inf"))).alias("high")) for i, (name, q) in enumerate(wanted.items())])
    sketch = sketch.select(*[F.col(n).alias(f"_{n}") for n in names], "__n", F.explode(brackets).alias("__b"))
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names], F.lit(True))
    # values below a bracket are one row of the result (null), those inside it one row each
    inside = F.when(F.col("__v") >= F.col("__b.low"), F.col("__v"))
    held = rows.join(F.broadcast(sketch) if not names else sketch, same).where(F.col("__v") <= F.col("__b.high"))
    held = held.groupBy(*names, "__n", "__b", inside.alias("__v")).agg(F.count("*").alias("__c"))
    order = Window.partitionBy(*names, "__b").orderBy(F.col("__v").asc_nulls_first())
    held = held.withColumn("__to", F.sum("__c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.col("__b.q") * (F.col("__n") - 1)
    holds = lambda k: (F.col("__to") > k) & (F.col("__to") - F.col("__c") <= k)
    ends = held.groupBy(*names, "__b", "__n").agg(F.max(F.when(holds(F.floor(place)), F.col("__v"))).alias("a"), F.max(F.when(holds(F.ceil(place)), F.col("__v"))).alias("z"))
    found = F.col("a") + (F.col("z") - F.col("a")) * (place - F.floor(place))
    ends = ends.withColumn("__x", found)
    return ends.groupBy(*names).agg(*[F.max(F.when(F.col("__b.name") == name, F.col("__x"))).alias(name) for name in wanted])


def spectrum_bands(df: DataFrame, key: str, pos: str, value: str, width: int, hop: int, bands: int, percentile: float | None = None) -> DataFrame:
    """key, frame, bands: mean magnitude per band of the spectrum of hopping windows; with ``percentile``
    (a share) over that of all bands and frames of the key, at most 1 (0 where it is 0).

    A sample is sent to the windows it lies in; each window is transformed by itself.
    """
    import numpy as np

    per = -(-width // hop)
    frames = F.filter(F.transform(F.sequence(F.lit(0), F.lit(per - 1)), lambda k: F.floor(F.col(pos) / hop) - k), lambda f: (f >= 0) & (F.col(pos) - f * hop < width))
    rows = df.select(key, pos, value, F.explode(frames).alias("frame")).groupBy(key, "frame").agg(F.array_sort(F.collect_list(F.struct(pos, value))).alias("__s"))
    rows = rows.select(key, "frame", F.transform("__s", lambda x: x[value].cast("double")).alias("samples"))

    @F.pandas_udf("array<double>")
    def bands_of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda s: [float(x.mean()) if len(x) else 0.0 for x in np.array_split(np.abs(np.fft.rfft(np.pad(s, (0, width - len(s))) * np.hanning(width))), bands)])

    out = rows.select(key, "frame", bands_of("samples").alias("bands"))
    if percentile is None:
        return out
    tops = percentiles(out.select(key, F.explode("bands").alias("__band")), "__band", {"__top": percentile}, [key])
    out = out.join(tops, F.col(key).eqNullSafe(F.col("__g0")), "left")
    return out.select(key, "frame", F.transform("bands", lambda x: F.when(F.col("__top") > 0, F.least(x / F.col("__top"), F.lit(1.0))).otherwise(0.0)).alias("bands"))


class SpeechSegmenter:
    """Hysteresis over frame probabilities, fed one frame at a time.

    Speech starts at ``p >= threshold``. The first frame below ``low`` marks a possible end, which a
    frame at the threshold cancels and a later frame below ``low``, ``min_silence`` after the mark,
    confirms; values between leave it. Segments longer than ``min_speech`` are emitted with the mean of
    their probabilities, widened by ``pad`` on both sides as far as neither 0 nor the end of the segment
    before is passed.
    """

    def __init__(self, threshold: float = 0.5, low: float | None = None, min_silence: float = 0.1, min_speech: float = 0.25, pad: float = 0.0):
        self.threshold, self.low = threshold, threshold - 0.15 if low is None else low
        self.min_silence, self.min_speech, self.pad = min_silence, min_speech, pad
        self.start: float | None = None
        self.maybe_end: float | None = None
        self.last = self.total = self.n = self.before = 0.0

    def feed(self, ts: float, p: float) -> Iterator[tuple[float, float, float]]:
        """Takes a frame; gives a finished segment, if there is one."""
        self.last = ts
        if p >= self.threshold:
            self.maybe_end = None
            if self.start is None:
                self.start, self.total, self.n = ts, 0.0, 0.0
        if self.start is None:
            return
        self.total, self.n = self.total + p, self.n + 1
        if p < self.low:
            if self.maybe_end is None:
                self.maybe_end = ts
            elif ts - self.maybe_end >= self.min_silence:
                yield from self._end(self.maybe_end)

    def flush(self) -> Iterator[tuple[float, float, float]]:
        """The segment that is open at the end."""
        if self.start is not None:
            yield from self._end(self.last)

    def _end(self, end: float) -> Iterator[tuple[float, float, float]]:
        start, self.start, self.maybe_end = self.start, None, None
        if end - start > self.min_speech:
            floor = min(start, max(self.before, 0.0))
            found = max(start - self.pad, floor), end + self.pad, self.total / max(self.n, 1.0)
            self.before = found[1]
            yield found

    def snapshot(self) -> tuple:
        """What a later segmenter needs to go on."""
        return self.start, self.maybe_end, self.last, self.total, self.n, self.before

    def restore(self, held: Sequence) -> None:
        """Goes on from a :meth:`snapshot`, in which numbers that are none may have become NaN."""
        self.start, self.maybe_end, self.last, self.total, self.n, self.before = (None if x is None or x != x else x for x in held)


def speech_segments(df: DataFrame, key: str, ts: str, probability: str, **limits: float) -> DataFrame:
    """key, start, end, mean_probability of speech per key, by :class:`SpeechSegmenter` over its frames
    in order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        machine, out = SpeechSegmenter(**limits), []
        for t, p in pdf.sort_values([ts, probability])[[ts, probability]].itertuples(index=False):
            out += machine.feed(float(t), float(p))
        out += machine.flush()
        return pd.DataFrame([(pdf[key].iloc[0], *x) for x in out], columns=[key, "start", "end", "mean_probability"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, ts, probability).groupBy(key).applyInPandas(run, f"{key} {kind}, start double, end double, mean_probability double")


def assign_tracks(df: DataFrame, video: str, ts: str, embedding: str, box: str, threshold: float = 0.5, max_distance: float = 2.0, fresh: float = 2.0) -> DataFrame:
    """Adds ``track`` to detections: greedy best-first matching of each frame to running centroids.

    A pair needs a cosine of ``threshold``; while the track is fresh its centre must lie within
    ``max_distance`` box sizes. Pairs are taken by cosine + 0.05 * overlap, each side once; what is
    left opens a track. A centroid is the renormalised running mean.
    """
    import numpy as np

    def overlap(a, b) -> float:
        w = min(a[2], b[2]) - max(a[0], b[0])
        h = min(a[3], b[3]) - max(a[1], b[1])
        if w <= 0 or h <= 0:
            return 0.0
        both = w * h
        return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tracks: list[dict] = []
        out = []
        for when, frame in pdf.sort_values(ts, kind="stable").groupby(ts, sort=True):
            vectors = [np.asarray(v, float) / (np.linalg.norm(v) or 1.0) for v in frame[embedding]]
            boxes = [np.asarray(b, float) for b in frame[box]]
            pairs = []
            for i, (v, b) in enumerate(zip(vectors, boxes, strict=True)):
                for j, t in enumerate(tracks):
                    cosine = float(v @ t["centre"])
                    size = max(b[2] - b[0], b[3] - b[1], 1e-9)
                    away = float(np.hypot((b[0] + b[2] - t["box"][0] - t["box"][2]) / 2, (b[1] + b[3] - t["box"][1] - t["box"][3]) / 2)) / size
                    if cosine >= threshold and not (when - t["at"] <= fresh and away > max_distance):
                        pairs.append((-(cosine + 0.05 * overlap(b, t["box"])), i, j))
            chosen: dict[int, int] = {}
            for _, i, j in sorted(pairs):
                if i not in chosen and j not in chosen.values():
                    chosen[i] = j
            for i, (v, b) in enumerate(zip(vectors, boxes, strict=True)):
                if i not in chosen:
                    chosen[i] = len(tracks)
                    tracks.append({"centre": v, "n": 1, "box": b, "at": when})
                else:
                    t = tracks[chosen[i]]
                    mean = t["centre"] * t["n"] + v
                    t |= {"centre": mean / (np.linalg.norm(mean) or 1.0), "n": t["n"] + 1, "box": b, "at": when}
            out.append(frame.assign(track=[chosen[i] for i in range(len(frame))]))
        return pd.concat(out) if out else pdf.assign(track=[])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", track long"
    return df.groupBy(video).applyInPandas(run, schema)
