"""Streaming forms: filters, maps, windows, fragments, splitters and segmenters.

Stateless steps are the batch functions themselves. Stateful ones keep one small state per key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import chunk_text, sentences
from ..operators.sequence import SpeechSegmenter
from ..plans.templates import filter_rows, project


def source(spark: SparkSession, path: str, schema: Any, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of Parquet files."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def filter_stream(stream: DataFrame, where: Mapping[str, Any]) -> DataFrame:
    """Items whose condition holds."""
    return filter_rows(stream, where)


def map_stream(stream: DataFrame, template: Mapping[str, Any]) -> DataFrame:
    """Items through a dict template."""
    return project(stream, template)


def windowed_counts(stream: DataFrame, ts: str, width: str, slide: str | None, late: str, by: list[str]) -> DataFrame:
    """start, end, keys, n of tumbling or sliding windows; rows later than ``late`` are dropped."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = stream.withWatermark(ts, late).groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def sessions(stream: DataFrame, ts: str, gap: str, late: str, by: list[str]) -> DataFrame:
    """start, end (last event), keys, n of sessions that a pause of ``gap`` ends."""
    out = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n"), F.max(ts).alias("end"))
    return out.select(F.col("w.start").alias("start"), "end", *by, "n")


def join_fragments(stream: DataFrame, key: str, seq: str, piece: str, last: str, idle: int | None = None) -> DataFrame:
    """key, text of values whose pieces arrive in any order; emitted once all up to the piece marked
    ``last`` are there. The state of a key is its pieces so far. With ``idle``, a key that gets no piece
    for so many milliseconds gives what it has and is forgotten; later pieces begin it anew."""

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, end = (dict(zip(state.get[0], state.get[1], strict=True)), state.get[2]) if state.exists else ({}, -1)
        for part in parts:
            held |= dict(zip(part[seq].tolist(), part[piece].fillna("").tolist(), strict=True))
            ends = part.loc[part[last].astype(bool), seq]
            end = int(ends.iloc[0]) if len(ends) else end
        if state.hasTimedOut or end >= 0 and len(held) > end:
            state.remove()
            yield pd.DataFrame({key: [k[0]], "text": ["".join(held[i] for i in sorted(held))]})
        else:
            state.update((list(held), list(held.values()), end))
            if idle:
                state.setTimeoutDuration(idle)

    kind = stream.schema[key].dataType.simpleString()
    return stream.select(key, seq, piece, last).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, text string", "seqs array<bigint>, pieces array<string>, end bigint", "append", _timeout(idle))


def _timeout(idle: int | None) -> str:
    return GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout


def _buffered(stream: DataFrame, key: str, seq: str, piece: str, last: str, cut: Callable[[str, bool], tuple[list[str], str]]) -> DataFrame:
    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, n = state.get if state.exists else ("", 0)
        done, out = False, []
        for part in parts:
            part = part.sort_values(seq)
            held += "".join(part[piece].fillna(""))
            done = done or bool(part[last].any())
        found, held = cut(held, done)
        out = [(k[0], n + i, x) for i, x in enumerate(found)]
        state.remove() if done else state.update((held, n + len(found)))
        if out:
            yield pd.DataFrame(out, columns=[key, "pos", "text"])

    kind = stream.schema[key].dataType.simpleString()
    return stream.select(key, seq, piece, last).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, pos bigint, text string", "held string, n bigint", "append", GroupStateTimeout.NoTimeout)


def split_sentences(stream: DataFrame, key: str, seq: str, piece: str, last: str) -> DataFrame:
    """key, pos, text: sentences as soon as they are complete; pieces of a key arrive in order."""

    def cut(held: str, done: bool) -> tuple[list[str], str]:
        found = sentences(held)
        return (found, "") if done or not found else (found[:-1], held[held.rfind(found[-1]) :])

    return _buffered(stream, key, seq, piece, last, cut)


def split_text(stream: DataFrame, key: str, seq: str, piece: str, last: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """key, pos, text: chunks of whole values, emitted when a value ends (as the batch form cuts it)."""
    return _buffered(stream, key, seq, piece, last, lambda held, done: (chunk_text(held, size, overlap), "") if done else ([], held))


def speech_stream(stream: DataFrame, key: str, ts: str, probability: str, last: str | None = None, idle: int | None = None, **limits: float) -> DataFrame:
    """key, start, end, mean_probability of speech that has ended; the state of a key is six numbers.

    A key ends with its row marked ``last`` (a column of booleans), or after ``idle`` milliseconds
    without a row: its open segment is given then, and its state is dropped.
    """

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = SpeechSegmenter(**limits)
        if state.exists:
            machine.restore(state.get)
        found, done = [], state.hasTimedOut
        for part in parts:
            part = part.sort_values(ts)
            for t, p in part[[ts, probability]].itertuples(index=False):
                found += machine.feed(float(t), float(p))
            done = done or bool(last and part[last].any())
        if done:
            found += machine.flush()
            state.remove()
        else:
            state.update(machine.snapshot())
            if idle:
                state.setTimeoutDuration(idle)
        if found:
            yield pd.DataFrame([(k[0], *x) for x in found], columns=[key, "start", "end", "mean_probability"])

    kind = stream.schema[key].dataType.simpleString()
    rows = stream.select(key, ts, probability, *([last] if last else []))
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, start double, end double, mean_probability double", "start double, maybe double, last double, total double, n double, before double", "append", _timeout(idle))


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is available now; its result as a frame, read from Parquet files in
    ``<checkpoint>-<name>``. A batch that is run again overwrites its own files."""
    spark, path = stream.sparkSession, f"{checkpoint}-{name}"
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{path}/__batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/__batch={number if mode == 'append' else 0}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path).select(*stream.columns)


def split_to_sinks(stream: DataFrame, sinks: Mapping[str, Callable[[DataFrame], DataFrame]], folder: str, checkpoint: str):
    """Writes several projections of one stream, in step, below a folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        for name, f in sinks.items():
            f(batch).write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
