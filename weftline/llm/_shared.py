"""Reading inputs and keeping intermediate tables where every executor can reach them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of 64-bit keys that may be broadcast (16 MB); larger sides are joined by shuffle.
BROADCAST_KEYS = 2_000_000
#: Rows of text that a Python worker takes in hand at once.
BATCH_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read through Spark so that any Hadoop store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) a temporary folder is made and
    set; a cluster without a shared folder is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='weftline-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def in_arrow(df: DataFrame, f, kinds) -> DataFrame:
    """``df.mapInArrow`` in slices of at most :data:`BATCH_ROWS` rows, so that the Python objects of
    long texts stay few. No setting of the session is touched: Spark itself bounds the bytes of the
    batches that it sends."""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH_ROWS):
                yield batch.slice(a, BATCH_ROWS)

    return df.mapInArrow(lambda batches: f(sliced(batches)), kinds)


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A folder name under :func:`shared_dir` that nothing else uses."""
    return f"{shared_dir(spark)}/weftline/{label}-{uuid.uuid4().hex}"


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = fresh_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stash(df: DataFrame) -> None:
    """Delete the files of a stashed table that no later plan reads."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sized_broadcast(df: DataFrame, rows: int | None = None, width: int = 1) -> DataFrame:
    """``df`` with a broadcast hint if it holds at most :data:`BROADCAST_KEYS` numbers: rows of ``width``
    each (a digest is two).

    Beyond that the hint is left out and Spark joins by shuffle, splitting skewed partitions.
    """
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n * width <= BROADCAST_KEYS else df


_keeps: dict[str, Callable[[], None]] = {}


def begin(owner: str, drop: Callable[[], None]) -> None:
    """At the start of a task: what other operators keep in this worker is dropped by their ``drop``, as
    workers live on between stages; then ``owner`` may keep something."""
    for other in [x for x in _keeps if x != owner]:
        _keeps.pop(other)()
    _keeps[owner] = drop


def nothing() -> None:
    """The ``drop`` of an operator that keeps nothing."""


def give_back() -> None:
    """At the end of a task: returns freed memory to the system, as workers live on between stages."""
    import ctypes
    import gc

    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def filesystem(uri: str):
    """(pyarrow file system, path) of a folder on an executor: local, hdfs, s3, gs."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)
