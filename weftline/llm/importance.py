"""Quality selection by importance resampling.

Two generative models over hashed words and word pairs: one of the target (documents that the labels
call good and not toxic), one of all raw text. A document's weight is the ratio of its n-grams under
the two, and documents are drawn without replacement by Gumbel top-k on its logarithm.

Equal texts count once. A document's own n-grams count in neither model when it is weighed. Otherwise every rare word of a
labelled document would speak for it and every rare word of an unlabelled one against it, and the draw
would repeat the labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._hashing import mix, word_hashes, words_of
from ._shared import in_arrow, sized_broadcast, stash

#: Hash buckets of words, and as many of word pairs, and the blocks in which their counts are added up.
BUCKETS, BLOCKS = 1 << 17, 64
#: Occurrences that are added to those of a bucket under both models: for words and for word pairs.
PRIOR = (1.0, 16.0)
#: Standard deviations by which a bucket's target count must differ from what raw text lets expect; where
#: it does not, the models are taken to agree on it.
SURE = 2.0
#: Texts whose n-grams are counted at once.
PART = 200
#: Bound of the labelled rows that are learned from: those of the smallest hash.
LABELLED_ROWS = 50_000
#: Buckets of one histogram of keys, and its rounds at most.
BINS, ROUNDS = 1024, 12


def features(text: str | None) -> np.ndarray:
    """Buckets of the words, then of the word pairs of a text."""
    h = word_hashes(words_of(text))
    pairs = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    return np.concatenate([mix(h) >> shift, (pairs >> shift) + np.uint64(BUCKETS)]).astype(np.int64)


def labelled_rows(labels: DataFrame) -> DataFrame:
    """(doc_id, good, target) of at most ``LABELLED_ROWS`` labelled documents, by hash.

    good: quality 1; target: good and not toxic. A document with several label rows has its worst.
    Labels without doc_id or quality decide nothing.
    """
    found = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce(F.col("toxic"), F.lit(0))).alias("t"))
    found = found.where("doc_id is not null and q is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_ROWS)
    return found.select(F.col("doc_id").alias("__labelled"), (F.col("q") == 1).alias("good"), ((F.col("q") == 1) & (F.col("t") == 0)).alias("target"))


@dataclass
class Models:
    """Occurrences of every bucket in all text and in target text."""

    raw: np.ndarray
    target: np.ndarray

    def __post_init__(self):
        self.raw_total, self.target_total = (x.reshape(2, BUCKETS).sum(1) for x in (self.raw, self.target))

    def log_weight(self, buckets: np.ndarray, chosen: bool) -> float:
        """log(p_target / p_raw) of a text with these :func:`features`, without its own occurrences;
        ``chosen``: it is one of the target texts.

        A bucket with t occurrences in the target, where its share of raw text lets e be expected,
        counts log((t + prior) / (e + prior)) each time, if t is ``SURE`` standard deviations off e.
        Otherwise the scatter of thousands of rare buckets would drown the few that tell.
        """
        at, n = np.unique(buckets, return_counts=True)
        kind = (at >= BUCKETS).astype(np.int64)
        own = np.bincount(kind, n, 2)
        share = ((self.target_total - own * chosen) / np.maximum(self.raw_total - own, 1))[kind]
        prior = np.array(PRIOR)[kind]
        expected = np.maximum(self.raw[at] - n, 0) * share + prior
        found = np.maximum(self.target[at] - n * chosen, 0) + prior
        sure = np.abs(found - expected) > SURE * np.sqrt(expected)
        return float((np.log(found / expected) * n)[sure].sum())


def with_target(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """doc_id, text, target (whether a labelled target has this text), counted (whether the models count
    this row): of equal texts, the one of the smallest doc_id, so that copies weigh as one."""
    chosen = F.broadcast(labelled.where("target").select("__labelled", F.lit(True).alias("__target")))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("__hash")).join(chosen, F.col("doc_id") == F.col("__labelled"), "left")
    groups = rows.groupBy(F.col("__hash").alias("__group")).agg(F.count("*").alias("__n"), F.min("doc_id").alias("__first"), F.max("__target").alias("__any")).where("__n > 1")
    groups = sized_broadcast(stash(groups, "importance-copies"), width=3)
    rows = rows.join(groups, F.col("__hash") == F.col("__group"), "left")
    counted = F.col("__group").isNull() | F.col("doc_id").eqNullSafe(F.col("__first"))
    return rows.select("doc_id", "text", F.coalesce("__any", "__target", F.lit(False)).alias("target"), counted.alias("counted"))


def fit_models(rows: DataFrame) -> Models:
    """All different texts of :func:`with_target` are counted for the raw model, those of targets for the
    target model.

    A task sends its counts as ``BLOCKS`` rows, each block is added up by itself, and what reaches the
    driver is two numbers per bucket, whatever the size of the corpus.
    """
    size = 2 * BUCKETS
    width = size // BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((2, size), np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, PART):
                part = batch.slice(a, PART)
                found = [features(x) for x in part.column(0).to_pylist()]
                chosen = [x for x, y in zip(found, part.column(1).to_pylist(), strict=True) if y]
                both[0] += np.bincount(np.concatenate(found), minlength=size)
                if chosen:
                    both[1] += np.bincount(np.concatenate(chosen), minlength=size)
        blocks = both.astype("<u4").reshape(2, BLOCKS, width)
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([blocks[:, k].tobytes() for k in range(BLOCKS)])], ["block", "counts"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * width, np.int64)
        for batch in batches:
            for x in batch.column(1).to_pylist():
                total += np.frombuffer(x, "<u4")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()])], ["block", "counts"])

    rows = in_arrow(rows.where("counted").select("text", "target"), count, "block int, counts binary")
    out = np.zeros((2, BLOCKS, width))
    for row in rows.groupBy("block").applyInArrow(add, "block int, counts binary").collect():
        out[:, row["block"]] = np.frombuffer(row["counts"], np.int64).reshape(2, width)
    return Models(out[0].reshape(-1), out[1].reshape(-1))


def log_weights(rows: DataFrame, models: Models) -> DataFrame:
    """doc_id, log_weight of every row of :func:`with_target`; a text without words weighs 0."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shared.value.log_weight(features(t), c) for t, c in each], pa.float64())], ["doc_id", "log_weight"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return in_arrow(rows.select("doc_id", "text", "target"), run, f"doc_id {kind}, log_weight double")


def gumbel(doc_id: Column) -> Column:
    """Standard Gumbel noise, fixed by the doc_id."""
    u = (F.shiftrightunsigned(F.xxhash64(doc_id, F.lit("gumbel")), 11).cast("double") + 0.5) * 2.0**-53
    return -F.log(-F.log(u))


def kth_largest(df: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value of a column, by histograms that close in on it; nulls don't count.

    Each round counts the values between two bounds in ``BINS`` bins (aggregated map-side) and keeps
    the bin that holds the rank, until it holds one distinct value. No value is collected.
    """
    values = df.select(F.col(column).alias("v")).where("v is not null")
    low, high, n = values.agg(F.min("v"), F.max("v"), F.count("v")).first()
    if not n or k < 1:
        return None
    k = min(k, n)
    for _ in range(ROUNDS):
        if low == high:
            return low
        width = (high - low) / BINS
        spot = F.least(F.lit(BINS - 1), F.floor((F.col("v") - low) / width).cast("int")) if width > 0 else F.lit(0)
        bins = values.where(F.col("v").between(low, high)).groupBy(spot.alias("b")).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        for row in sorted(bins, key=lambda r: -r["low"]):
            if k <= row["n"]:
                low, high = row["low"], row["high"]
                break
            k -= row["n"]
    # bins cannot part the values any further than neighbouring doubles: few distinct values are left
    for row in values.where(F.col("v").between(low, high)).groupBy("v").count().orderBy(F.desc("v")).collect():
        if k <= row["count"]:
            return row["v"]
        k -= row["count"]
    return low


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """doc_id, log_weight, key, kept: ``k`` rows drawn by their importance weight.

    ``key`` is the log weight plus Gumbel noise that the doc_id fixes; the k largest keys are kept,
    and rows whose key equals the k-th are kept with it (repeated rows share their fate). Without
    ``k``, the share of rows is drawn that targets have among the labelled rows; without any target
    label all rows are kept. Null texts weigh 0; one row per input row; an empty table gives an empty
    result.
    """
    labelled = stash(labelled_rows(labels), "importance-labels")
    share = labelled.agg(F.avg(F.col("target").cast("double"))).first()[0] or 0.0
    if not share and k is None:
        return docs.select("doc_id", F.lit(0.0).alias("log_weight"), gumbel(F.col("doc_id")).alias("key"), F.lit(True).alias("kept"))
    rows = with_target(docs, labelled)
    weights = log_weights(rows, fit_models(rows))
    scored = stash(weights.withColumn("key", F.col("log_weight") + gumbel(F.col("doc_id"))), "importance-scores")
    limit = kth_largest(scored, "key", round(share * scored.count()) if k is None else k)
    return scored.select("doc_id", "log_weight", "key", (F.col("key") >= limit if limit is not None else F.lit(False)).alias("kept"))
