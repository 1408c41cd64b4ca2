"""The folder that driver and executors share, and tables written there to cut the lineage."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: list[str] = []
_used: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session (tests) that has none gets a temporary folder, a cluster an error, because
    executors wouldn't see each other's files."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="sourcelore-"))
        path = _own[0]
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. What is written there goes by ``dropped``, or when the Python process ends."""
    folder = f"{shared_folder(spark)}/sourcelore-{spark.sparkContext.applicationId}"
    if folder not in _used:
        _used.add(folder)
        atexit.register(_delete, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str = "table", by: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: a cut of the lineage that outlives executors.
    Rows of one value of ``by`` go to a folder of their own, so that a filter on it reads no others.

    The shuffle files of the write go as soon as it ends, so that the steps of a long job don't pile up on disk.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def version(spark: SparkSession, path: str) -> str:
    """What tells one state of a stored table from another: the newest change and the size of all its files."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    summary, listing = fs.getContentSummary(at), fs.listFiles(at, True)
    newest = 0
    while listing.hasNext():
        newest = max(newest, listing.next().getModificationTime())
    return f"{summary.getFileCount()}-{summary.getLength()}-{newest}"


def dropped(*tables: DataFrame) -> None:
    """Delete what ``durable`` wrote for tables that no later step reads."""
    for table in tables:
        _delete(table.stored_at)


def _delete(path: str) -> None:
    context = SparkContext._active_spark_context
    if context is not None:
        with contextlib.suppress(Py4JError, OSError):  # what isn't deleted only takes room
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
