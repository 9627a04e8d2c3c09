"""A corpus pipeline: language ID, near-duplicates, decontamination, personal data, tokens.

Each stage reads what its predecessor kept. SQL cannot express the stages (code lengths of context
trees, weighted sampling, byte pairs), so ``ORACLE_SQL`` is None and tests hold them against
brute-force versions.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, decontaminate, language_id, near_dup, pii
from weftline.llm._shared import stash, table
from weftline.llm.queries import vocabulary

#: Texts below this many bytes are too short for the bits-per-byte test.
LEAST_BYTES = 32
#: Rows that Spark sends to a Python worker at once. Stages carry whole documents there and back, so the
#: pipeline lowers this setting of the session; :func:`run` puts it back.
BATCH_KEY, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(stage: Stage) -> Stage:
    """The stage, with at most ``BATCH_ROWS`` rows a batch in the session that computes its result."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        now = int(spark.conf.get(BATCH_KEY))
        if now <= 0 or now > BATCH_ROWS:
            spark.conf.set(BATCH_KEY, str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run_stage


@in_small_batches
def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter (null and empty ones too) and texts that no learned language
    explains; the rest stays unchanged."""
    trees = language_id.learn(docs.select("doc_id", "lang", "text"))
    found = language_id.predict_languages(docs, trees, ("__lang_pred", "__score", "__bits"))
    strange = (F.col("__bits") > language_id.MOST_BITS) & (F.octet_length("text") >= LEAST_BYTES)
    return found.where((F.col("__lang_pred") != language_id.UNDETERMINED) & ~strange).select(*docs.columns)


@in_small_batches
def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each near-duplicate class."""
    return near_dup.keep_one(docs)


@in_small_batches
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark items."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


@in_small_batches
def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data and disclosing terms in texts."""
    return pii.sanitise(docs)


@in_small_batches
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids, decoded of every document."""
    return bpe.encode_documents(docs, vocabulary())


STAGES = [
    ("language ID", by_language),
    ("near-duplicates", without_copies),
    ("decontamination", without_benchmark),
    ("personal data", without_personal_data),
    ("BPE", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read by the next."""
    before, docs = spark.conf.get(BATCH_KEY), table(spark, sf_dir, "documents")
    try:
        for name, stage in STAGES:
            docs = stash(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    finally:
        spark.conf.set(BATCH_KEY, before)
    return docs
