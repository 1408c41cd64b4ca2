"""The two jobs that are streams by nature: audit events, and sources that arrive in batches of files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcelore.functions.ids import stable_id
from sourcelore.functions.text import decoded
from sourcelore.plans.ingest import analysed
from sourcelore.plans.snapshots import PAYLOAD, STATES, absent, artifact_ids, artifacts
from sourcelore.sources.tree import scan
from sourcelore.storage import dropped, durable

# fixed values: outcomes an audit event may have
OUTCOMES = ("success", "denied", "error")


def audit_ids(events: DataFrame) -> DataFrame:
    """Events with the id that makes repeats the same: domain, principal, request, tool. Others than known outcomes are left out."""
    return events.where(F.col("outcome").isin(*OUTCOMES)).withColumn("id", stable_id("audit", "security_domain_id", "principal_id", "request_id", "tool"))


def append_audit(events: DataFrame, log: DataFrame) -> DataFrame:
    """What a batch adds to the log: each id once, none that is there."""
    return absent(audit_ids(events).dropDuplicates(["id"]), log)


def stream_audit(events: DataFrame, path: str, checkpoint: str, watermark: str = "10 minutes"):
    """Append a stream of events (with ``ts``) to a table, each id once; state is kept for the watermark's length only."""
    once = audit_ids(events).withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["id"])
    return once.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_sources(files: DataFrame, path: str, checkpoint: str, profile: str):
    """A stream of files ``(repository, path, content)`` to four tables under ``path``.

    ``artifacts`` has the nested analysis (chunks and facts) of each new content: a batch analyses only what the table lacks.
    ``files`` has a row for each file that came and its artifact, ``blobs`` each content once, and ``events`` the states of the
    batch, the last of them written last. A batch that is run again adds nothing.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession

        def absent_from(table: str, found: DataFrame, key: list[str]) -> DataFrame:
            try:
                known = spark.read.parquet(f"{path}/{table}").select(*key).distinct()
            except AnalysisException as e:  # the first batch finds no table
                if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                    raise
                return found
            return found.join(known, key, "left_anti")

        def add(table: str, found: DataFrame, key: list[str]) -> None:
            absent_from(table, found, key).write.mode("append").parquet(f"{path}/{table}")

        came = durable(artifact_ids(scan(rows), profile), "batch")
        one = came.dropDuplicates(["artifact_id"]).select("artifact_id", F.col("artifact_id").alias("file_id"), "language", decoded("content").alias("text"))
        fresh = durable(absent_from("artifacts", one, ["artifact_id"]), "fresh")
        made: list[DataFrame] = []
        found = {name: df.withColumn("artifact_id", F.col("file_id")) for name, df in analysed(fresh.drop("artifact_id"), made).items() if name in PAYLOAD}
        artifacts(found).write.mode("append").parquet(f"{path}/artifacts")
        add("blobs", came.dropDuplicates(["blob_id"]).select(F.col("blob_id").alias("id"), "size_bytes", "content"), ["id"])
        add("files", came.select("repository", "path", "blob_id", "artifact_id").distinct(), ["repository", "path", "blob_id"])
        states = came.select("repository").distinct().select("repository", F.lit(number).alias("batch"), F.posexplode(F.array(*map(F.lit, STATES))).alias("place", "state"))
        add("events", states.select("repository", "batch", (F.lit(number) * len(STATES) + F.col("place") + 1).alias("event_seq"), "state"), ["repository", "batch", "state"])
        dropped(came, fresh, *made)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
