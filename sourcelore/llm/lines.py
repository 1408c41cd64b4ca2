"""Line dedup with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelore.llm.common import ASCII_SPACE, ascii_lower, stored, whole_text


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def _occurrences(rows: DataFrame, min_chars: int) -> DataFrame:
    lines = rows.select("id", "row", F.posexplode(F.split("body", "\n", -1)).alias("pos", "line"))
    long = lines.where(F.char_length("line") >= min_chars).select("id", "row", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return long.select("id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def drop_common_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the shared lines dropped from ``text_col``, and the columns ``line_count`` (before) and ``lines_dropped``.

    Lines are split at \\n (null or empty text: one empty line). A key (see ``line_key``) of at least ``min_chars`` code
    points found in at least ``min_docs`` distinct ids loses all its lines except those in the largest id that holds
    it. Keys are compared by 128 bits of XXH64. Lines of rows with a null id count for no document and stay. Rows that
    repeat an id count as one document; each comes out. Empty tables give an empty result. Other columns pass
    through; should ``docs`` have columns with the two added names, they are replaced.

    Distinct ids are counted in two steps (by key and id, then by key), so a line that most documents hold is summed
    up before it meets; dropping is one equi-join on the key, and texts move once, to meet their dropped positions.
    """
    # a row is found again by its id and the hash of its text: rows that repeat an id may have different texts
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("body")).select("id", F.xxhash64("body").alias("row"), "body")
    found = _occurrences(rows.where("id is not null"), min_chars)
    common = found.groupBy("h1", "h2").agg(F.countDistinct("id").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs).select("h1", "h2", "keeper")
    common = stored(common, "common-lines")  # of known size, and the join below has plain shuffles that Spark can split by skew
    drops = found.join(common, ["h1", "h2"]).where(F.col("id") != F.col("keeper")).groupBy("id", "row").agg(F.collect_set("pos").alias("__drops")).withColumnsRenamed({"id": "__id", "row": "__row"})
    body = whole_text(text_col)
    joined = docs.join(drops, (docs[id_col] == drops["__id"]) & (F.xxhash64(body) == drops["__row"]), "left")
    lines = F.split(body, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__drops"))
    return joined.withColumns({
        "line_count": F.size(lines).cast("long"),
        "lines_dropped": F.coalesce(F.size("__drops"), F.lit(0)).cast("long"),
        text_col: F.when(F.col("__drops").isNull(), body).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")),
    }).drop("__drops", "__id", "__row")
