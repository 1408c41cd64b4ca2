"""The corpus pipeline: toxicity, line dedup, SimHash near-dedup, mixing sources to target weights, packing.

Documents have at least ``doc_id``, ``text`` and ``source``; all stages but the last return the columns they get, whatever others
there are. Null texts count as empty, at any length texts are taken whole, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelore.llm import lines, mixing, packing, simhash, toxicity
from sourcelore.llm.common import stored, whole_text


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine scores under 0.5; it learns from the labelled documents outside the held-out fold.

    Each row is judged by its own text: repeated ids and rows stay or go one by one, null and empty texts get the score of no
    terms. Without labels of both classes the score is constant: the share of toxic labels, and all stay if it is under 0.5;
    without any label all stay.
    """
    machine = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), toxicity.training_rows())
    rejected = toxicity.score_column(machine, whole_text()) >= 0.5
    return docs.where(~rejected) if len(machine.at) or machine.bias else docs


def _lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that five or more of them share; ``n_chars`` follows, if there is such a column.

    All rows stay, those that lose all lines too. Rows that repeat an id count as one document; lines of rows without an id stay.
    A document that lost no line keeps its text as it was, null too.
    """
    found = lines.drop_common_lines(docs.withColumn("__text", F.col("text")))
    changed = F.col("lines_dropped") > 0
    found = found.withColumn("text", F.when(changed, F.col("text")).otherwise(F.col("__text")))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return found.select(docs.columns)


def _simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, texts without words included: that of the smallest id.

    Rows that share an id, or have none, are told apart by their texts; equal rows are one. Ties between texts of one id go to the
    smaller fingerprint, then hash.
    """
    return simhash.keep_one(docs).select(docs.columns)


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their source's target rate, in random order. A null source is a source; one of empty texts only goes."""
    return mixing.mix(docs).select(docs.columns)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, placed in sequences: a row for each piece; each copy of a document is packed for itself."""
    return packing.pack(docs).withColumnRenamed("doc", "doc_id")


STAGES = [("toxicity", _toxicity), ("line dedup", _lines), ("simhash near-dedup", _simhash), ("mixing", _mixing), ("packing", _packing)]

#: SQL can't express the toxicity machine, XXH64 fingerprints or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = stored(docs, f"stage-{at}")
    return docs
