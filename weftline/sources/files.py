"""File stores: listing, reading, writing and deleting through Spark and Hadoop file systems."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Content types by suffix.
TYPES = {"txt": "text/plain", "json": "application/json", "csv": "text/csv", "html": "text/html", "parquet": "application/vnd.apache.parquet", "png": "image/png", "jpg": "image/jpeg", "pdf": "application/pdf", "wav": "audio/wav", "mp4": "video/mp4"}


def list_files(spark: SparkSession, root: str, recursive: bool = False, pattern: str | None = None, size: int | None = None, token: int = 0) -> DataFrame:
    """path, name, size, content_type, modified_at of files below a folder, by path; a page of ``size``
    after ``token``. Contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    suffix = F.lower(F.regexp_extract("path", r"\.(\w+)$", 1))
    kind = F.lit("application/octet-stream")
    for k, v in TYPES.items():
        kind = F.when(suffix == k, F.lit(v)).otherwise(kind)
    out = reader.load(root).select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("size"), kind.alias("content_type"), F.col("modificationTime").alias("modified_at"))
    return out if size is None else out.orderBy("path").offset(token).limit(size)


def read_files(spark: SparkSession, root: str, pattern: str | None = None, text: bool = False) -> DataFrame:
    """path and content of files, as bytes or whole text."""
    reader = spark.read.format("binaryFile")
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    out = reader.load(root).select("path", "content")
    return out.withColumn("content", F.decode("content", "UTF-8")) if text else out


def read_chunks(spark: SparkSession, root: str, size: int = 1 << 20, pattern: str | None = None) -> DataFrame:
    """path, chunk, content of files in pieces of ``size`` bytes; an empty file has none."""
    rows = read_files(spark, root, pattern)
    rows = rows.where(F.octet_length("content") > 0)
    last = (F.ceil(F.octet_length("content") / size) - 1).cast("int")
    rows = rows.select("path", "content", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    return rows.select("path", "chunk", F.substring("content", F.col("chunk") * size + 1, F.lit(size)).alias("content"))


def save(spark: SparkSession, path: str, save_to: str) -> None:
    """Copies a file or folder of any store to another place of any store."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    a, b = hadoop.Path(path), hadoop.Path(save_to)
    hadoop.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, True, conf)


def files_exist(spark: SparkSession, wanted: DataFrame, root: str) -> DataFrame:
    """Every wanted name with whether the folder has it."""
    have = list_files(spark, root).select("name", F.lit(True).alias("__have"))
    return wanted.join(have, "name", "left").select("name", F.coalesce("__have", F.lit(False)).alias("exists"))


def put(df: DataFrame, path: str, form: str = "parquet", mode: str = "overwrite", partition_by: list[str] | None = None, **options: str) -> None:
    """Writes a frame."""
    writer = df.write.format(form).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def scratch(spark: SparkSession, label: str) -> str:
    """The name of a new folder that all executors share, below ``spark.checkpoint.dir``; where that is
    unset, a local one in local mode and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}"
    return f"{root.rstrip('/')}/weftline/{label}-{uuid.uuid4().hex}"


def write_once(df: DataFrame, label: str) -> DataFrame:
    """Runs a frame now: writes it to a :func:`scratch` folder and reads it back."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> bool:
    """Removes a file or folder; whether there was one."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def read(spark: SparkSession, spec: Mapping[str, object]) -> DataFrame:
    """A source of a pipeline: {"format", "path", ...options} or {"view"}."""
    if "view" in spec:
        return spark.table(str(spec["view"]))
    options = {k: v for k, v in spec.items() if k not in ("format", "path")}
    return spark.read.format(str(spec.get("format", "parquet"))).options(**options).load(str(spec["path"]))
