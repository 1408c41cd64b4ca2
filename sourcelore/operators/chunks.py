"""Chunks of files: line windows, parts of large chunks, symbols, rows with ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelore.functions.ids import col, stable_id
from sourcelore.functions.text import lines

LINES, OVERLAP, MOST_LINES = 120, 20, 240
LINE_GENERATOR = "line-window-v1"


def windows(all_lines: Column, size: int = LINES, overlap: int = OVERLAP, first_line: Column | None = None) -> Column:
    """Array of (start_line, end_line, content) over an array of lines; none for none. The last reaches the end.

    The lines are to be a column by then: inside the array function an expression would be evaluated for each window."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than the window")
    base = first_line if first_line is not None else F.lit(1)
    n = F.size(all_lines)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), n - overlap - 1), F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct((s + base).alias("start_line"), (F.least(s + size, n) - 1 + base).alias("end_line"), F.array_join(F.slice(all_lines, s + 1, size), "").alias("content")))


def line_chunks(files: DataFrame, size: int = LINES, overlap: int = OVERLAP, text_col: str = "text") -> DataFrame:
    """One row for each line window: the file's columns without its text, and ordinal, kind, lines, content, symbol, generator."""
    rest = [c for c in files.columns if c not in (text_col, "content")]
    dealt = files.select(*rest, lines(text_col).alias("__lines")).select(*rest, F.posexplode(windows(F.col("__lines"), size, overlap)).alias("ordinal", "w"))
    return dealt.select(*rest, "ordinal", F.lit("line_window").alias("kind"), "w.start_line", "w.end_line", "w.content", F.lit(None).cast("string").alias("symbol"), F.lit(LINE_GENERATOR).alias("generator"))


def split_large(chunks: DataFrame, most_lines: int = MOST_LINES, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of over ``most_lines`` lines as overlapping parts, with ``_part`` at their kind; others as they are."""
    parts = windows(F.col("__lines"), most_lines, overlap, F.col("start_line"))
    large = F.size("__lines") > most_lines
    own = F.array(F.struct("start_line", "end_line", "content"))
    rest = [c for c in chunks.columns if c not in ("start_line", "end_line", "content", "kind")]
    return chunks.withColumn("__lines", lines("content")).select(*rest, F.when(large, F.concat("kind", F.lit("_part"))).otherwise(F.col("kind")).alias("kind"), F.explode(F.when(large, parts).otherwise(own)).alias("p")).select(*rest, "kind", "p.start_line", "p.end_line", "p.content")


# fixed values: words of a declaration that are not its name
_NOT_NAMES = ("const", "extern", "static", "struct", "union", "enum", "unsigned", "signed", "long", "short", "int", "char", "void")


def symbol(kind: Column | str, content: Column | str) -> Column:
    """A chunk's name by its kind; null if it has none. It is found among the content's words and signs."""
    k = col(kind)
    parts = F.regexp_extract_all(col(content), F.lit(r"\w+|[^\w\s]"), F.lit(0))
    is_name = lambda w: F.regexp_like(w, F.lit("^[A-Za-z_]"))
    before = lambda all_, sign: F.filter(F.transform(all_, lambda w, i: F.when(is_name(w) & (F.get(all_, i + 1) == sign), w)), lambda w: w.isNotNull())
    first = lambda words: F.get(words, 0)
    last = lambda words: F.try_element_at(words, F.lit(-1))
    called = before(parts, "(")
    head = F.slice(parts, 1, F.when(F.array_position(parts, "{") > 0, F.array_position(parts, "{").cast("int")).otherwise(F.size(parts)))
    defined = F.filter(F.transform(parts, lambda w, i: F.when((w == "define") & (i > 0) & (F.get(parts, i - 1) == "#"), F.get(parts, i + 1))), is_name)
    plain = F.filter(parts, lambda w: is_name(w) & ~w.isin(*_NOT_NAMES))
    return (
        F.when(k == "macro", first(defined))
        .when(k.isin("macro_invocation", "top_level_expression"), first(called))
        .when(k == "type", F.when(last(parts) == ";", F.when(is_name(F.try_element_at(parts, F.lit(-2))), F.try_element_at(parts, F.lit(-2)))))
        .when(k == "function", last(before(head, "(")))
        .when(k == "declaration", F.coalesce(first(F.filter(called, lambda w: w == F.upper(w))), last(called), last(plain)))
    )


def chunk_rows(chunks: DataFrame, file_id: str = "file_id") -> DataFrame:
    """Chunks with ``content_hash`` and ``id`` (file, ordinal, lines, hash)."""
    hashed = chunks.withColumn("content_hash", F.sha2("content", 256))
    return hashed.withColumn("id", stable_id("chunk", file_id, "ordinal", "start_line", "end_line", "content_hash"))
