"""Retrieval quality against annotated questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcelore.functions.ids import citation


def file_metrics(evidence: DataFrame, results: DataFrame, top_k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Recall over distinct expected files, and mean reciprocal rank over questions; null where nothing is expected.

    ``evidence(question_id, path)``, ``results(question_id, rank, path)``, both with the columns ``by``.
    """
    wanted = evidence.select("question_id", "path").distinct()
    first = results.where(F.col("rank") <= top_k).groupBy(*by, "question_id", "path").agg(F.min("rank").alias("rank"))
    if by:
        wanted = wanted.crossJoin(results.select(*by).distinct())  # a row for each of a few retrievers
    ranks = wanted.join(first, [*by, "question_id", "path"], "left")
    per = ranks.groupBy(*by, "question_id").agg(F.count("*").alias("expected"), F.count("rank").alias("found"), F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("rr"))
    return per.groupBy(*by).agg(F.sum("found").alias("files_found"), F.sum("expected").alias("files_total"), (F.sum("found") / F.sum("expected")).alias("file_recall"), F.avg("rr").alias("file_mrr"))


def range_ranks(evidence: DataFrame, results: DataFrame, top_k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Each expected range with the first rank whose lines overlap it."""
    e = evidence.select("question_id", "path", F.col("start_line").alias("from_line"), F.col("end_line").alias("to_line"))
    if by:
        e = e.crossJoin(results.select(*by).distinct())  # a row for each of a few retrievers
    r = results.where(F.col("rank") <= top_k).select(*by, "question_id", "path", "rank", "start_line", "end_line")
    both = e.join(r, [*by, "question_id", "path"], "left").withColumn("hit", F.when((F.col("from_line") <= F.col("end_line")) & (F.col("start_line") <= F.col("to_line")), F.col("rank")))
    return both.groupBy(*by, "question_id", "path", "from_line", "to_line").agg(F.min("hit").alias("rank"))


def question_status(ranges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    per = ranges.groupBy(*by, "question_id").agg(F.count("*").alias("ranges"), F.count("rank").alias("found"), F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("rr"))
    return per.withColumn("status", F.when(F.col("found") == F.col("ranges"), "complete").when(F.col("found") > 0, "partial").otherwise("missed"))


def range_metrics(evidence: DataFrame, results: DataFrame, top_k: int, by: tuple[str, ...] = ()) -> DataFrame:
    per = question_status(range_ranks(evidence, results, top_k, by), by)
    count = lambda s: F.count_if(F.col("status") == s).alias(f"questions_{s}")
    return per.groupBy(*by).agg(F.sum("found").alias("ranges_found"), F.sum("ranges").alias("ranges_total"), (F.sum("found") / F.sum("ranges")).alias("range_recall"), F.avg("rr").alias("range_mrr"), count("complete"), count("partial"), count("missed"))


def compare(evidence: DataFrame, results: DataFrame, top_k: int, base: str, other: str) -> DataFrame:
    """Two retrievers (column ``retriever``) side by side: ``(metric, base, other, delta)``."""
    by = ("retriever",)
    both = file_metrics(evidence, results, top_k, by).join(range_metrics(evidence, results, top_k, by), "retriever")
    names = ["file_recall", "file_mrr", "range_recall", "range_mrr"]
    wide = both.unpivot(["retriever"], [F.col(n).cast("double").alias(n) for n in names], "metric", "value").groupBy("metric").pivot("retriever", [base, other]).agg(F.max("value"))
    return wide.select("metric", F.col(base).alias("base"), F.col(other).alias("other"), (F.col(other) - F.col(base)).alias("delta"))


def routing(expected: DataFrame, hits: DataFrame, pinned: DataFrame) -> DataFrame:
    """Share of questions whose hits cover exactly the expected repositories, and of hits from pinned snapshots.

    ``expected(question_id, repository)``, ``hits(question_id, repository, snapshot_id)``, ``pinned(snapshot_id)``."""
    own = hits.groupBy("question_id").agg(F.array_sort(F.collect_set("repository")).alias("got"))
    want = expected.groupBy("question_id").agg(F.array_sort(F.collect_set("repository")).alias("wanted"))
    recall = want.join(own, "question_id", "left").agg(F.avg(F.coalesce(F.col("got") == F.col("wanted"), F.lit(False)).cast("double")).alias("routing_recall"))
    marked = hits.join(pinned.select("snapshot_id").distinct().withColumn("ok", F.lit(1.0)), "snapshot_id", "left")
    return recall.crossJoin(marked.agg(F.avg(F.coalesce("ok", F.lit(0.0))).alias("version_accuracy")))  # one row each


def evidence_violations(evidence: DataFrame, files: DataFrame) -> DataFrame:
    """Annotations without a file, or with lines out of its bounds."""
    known = files.select("path", "line_count")
    return evidence.join(known, "path", "left").withColumn("problem", F.when(F.col("line_count").isNull(), "missing_file").when((F.col("end_line") > F.col("line_count")) | (F.col("start_line") < 1) | (F.col("start_line") > F.col("end_line")), "lines_out_of_bounds")).where("problem is not null").drop("line_count")


def report_violations(report: DataFrame, questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(question_id, chunk_id, problem)`` of a stored candidate report: unknown question or chunk, another query text, and a
    citation or content hash that isn't what the chunk says."""
    c = chunks.select("chunk_id", F.col("content_hash").alias("true_hash"), citation("repository", "revision", "path", "start_line", "end_line").alias("true_citation"))
    q = questions.select("question_id", F.col("query").alias("true_query"))
    joined = report.join(q, "question_id", "left").join(c, "chunk_id", "left")
    problem = F.when(F.col("true_query").isNull(), "unknown_question").when(F.col("query") != F.col("true_query"), "other_query").when(F.col("true_hash").isNull(), "unknown_chunk").when(F.col("citation") != F.col("true_citation"), "other_citation").when(F.col("content_hash") != F.col("true_hash"), "other_content")
    return joined.withColumn("problem", problem).where("problem is not null").select("question_id", "chunk_id", "problem")
