"""The given tables in the shapes that the jobs take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelore.functions.ids import stable_id
from sourcelore.functions.text import decoded, terms
from sourcelore.operators import index
from sourcelore.operators.chunks import chunk_rows, line_chunks
from sourcelore.sources.tree import scan
from sourcelore.storage import durable, scratch, version

CHUNK_LINES, CHUNK_OVERLAP = 6, 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: the source is the repository, language and id the path."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("repository"), F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").cast("binary").alias("content"))


def changed_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next version: a tenth of the files is gone, a tenth has one more line."""
    docs = table(spark, sf_dir, "documents").where("doc_id % 10 <> 3")
    text = F.when(F.col("doc_id") % 10 == 7, F.concat("text", F.lit("\none more line"))).otherwise(F.col("text"))
    return docs.select(F.col("source").alias("repository"), F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), text.cast("binary").alias("content"))


#: What ingest has stored in this process: by application, table and the table's version.
_stored: dict[tuple, object] = {}


def once(spark: SparkSession, sf_dir: str, what: str, make, tables: tuple[str, ...] = ("documents",)):
    key = (what, spark.sparkContext.applicationId, sf_dir, *[version(spark, f"{sf_dir}/{t}.parquet") for t in tables])
    if key not in _stored:
        _stored[key] = make()
    return _stored[key]


def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks as ingest stores them: cut once for each version of the documents, and read by every search."""
    return spark.read.parquet(once(spark, sf_dir, "chunks", lambda: durable(chunks(spark, sf_dir), "chunks").stored_at))


def word_index(spark: SparkSession, sf_dir: str) -> index.WordIndex:
    """The stored index of these chunks, written in two batches: the repositories of even number, then the others."""

    def made() -> str:
        path, rows = scratch(spark, "index"), chunk_table(spark, sf_dir)
        index.add_snapshots(rows.where("cast(substring(repository, 4) as int) % 2 = 0"), path)
        index.add_snapshots(rows, path)
        return path

    return index.WordIndex(spark, once(spark, sf_dir, "index", made))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the tree at revision r1, one snapshot for each repository."""
    files = scan(tree(spark, sf_dir)).withColumn("snapshot_id", stable_id("snapshot", "repository", F.lit("r1"))).withColumn("file_id", stable_id("file", "snapshot_id", "path")).withColumn("text", decoded("content"))
    found = chunk_rows(line_chunks(files, CHUNK_LINES, CHUNK_OVERLAP))
    return found.select(F.col("id").alias("chunk_id"), "snapshot_id", "file_id", "repository", F.lit("r1").alias("revision"), "path", "blob_id", "ordinal", "kind", "start_line", "end_line", "symbol", "generator", "content_hash", "content")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms of each benchmark text."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(terms("text"), " ").alias("query"))
