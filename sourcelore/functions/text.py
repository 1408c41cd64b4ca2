"""Texts, lines, terms and paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelore.functions.ids import col

# fixed values: the line ends of str.splitlines(), the characters of a search term, and what may start a term of code
# (in Java, \v is one test for seven of them; a class of single characters is a chain of tests, which took most of the time of ingest)
_ENDS = r"\v\x1c-\x1e"
LINE = rf"[^{_ENDS}]*(?:\r\n|[{_ENDS}])|[^{_ENDS}]+$"
TERM = r"[\p{L}\p{N}_]+"
IDENTIFIER = "^[A-Za-z_][A-Za-z0-9_]*$"
MOST_IDENTIFIERS = 16
MOST_CHARACTERS = 1_600


def decoded(content: Column | str) -> Column:
    """Bytes as text, with U+FFFD for what isn't UTF-8."""
    return F.make_valid_utf8(col(content).cast("string"))


def decode_status(content: Column | str) -> Column:
    return F.when(F.is_valid_utf8(col(content).cast("string")), F.lit("utf8")).otherwise(F.lit("replacement"))


def lines(text: Column | str) -> Column:
    """The lines with their ends; none for an empty text."""
    return F.regexp_extract_all(col(text), F.lit(LINE), F.lit(0))


def line_range(text: Column | str, start: Column | str, end: Column | str) -> Column:
    """Lines start to end (from 1, both included) as one text."""
    return F.array_join(F.slice(lines(text), col(start), F.greatest(col(end) - col(start) + 1, F.lit(0))), "")


def terms(text: Column | str) -> Column:
    """Search terms, lower-cased, with repeats."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(TERM), F.lit(0))


def identifiers(text: Column | str, most: int = MOST_IDENTIFIERS) -> Column:
    """The first distinct identifiers of a query."""
    found = F.filter(F.regexp_extract_all(col(text), F.lit(TERM), F.lit(0)), lambda t: F.regexp_like(t, F.lit(IDENTIFIER)))
    return F.slice(F.array_distinct(found), 1, most)


def normalized_query(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(text), r"(?U)\s+", " "))


def checked_queries(queries: DataFrame, top_k: int) -> tuple[DataFrame, DataFrame]:
    """``queries(query_id, query)`` with white space made plain, and those of which nothing is left. ``top_k`` is 1 to 100."""
    if not 1 <= top_k <= 100:
        raise ValueError("top_k must be between 1 and 100")
    plain = queries.withColumn("query", normalized_query(F.coalesce("query", F.lit(""))))
    return plain.where("query <> ''"), plain.where("query = ''").select("query_id", F.lit("empty_query").alias("reason"))


def cut_content(text: Column | str, most: int = MOST_CHARACTERS) -> Column:
    """At most ``most`` characters; a cut one loses white space at its end and gets a line with an ellipsis."""
    c = col(text)
    return F.when(F.char_length(c) > most, F.concat(F.regexp_replace(F.substring(c, 1, most), r"(?U)\s+$", ""), F.lit("\n…"))).otherwise(c)


def is_cut(text: Column | str, most: int = MOST_CHARACTERS) -> Column:
    return F.char_length(col(text)) > most


def semantic_document(path: Column | str, start: Column | str, end: Column | str, kind: Column | str, symbol: Column | str, content: Column | str) -> Column:
    """The text that stands for a chunk when it is embedded."""
    return F.format_string("File: %s\nLines: %s-%s\nKind: %s\nSymbol: %s\nContent:\n%s", col(path), col(start).cast("string"), col(end).cast("string"), col(kind), F.coalesce(col(symbol), F.lit("(none)")), col(content))


def basename(path: Column | str) -> Column:
    return F.substring_index(col(path), "/", -1)


def dirname(path: Column | str) -> Column:
    """All before the last slash; empty without one."""
    return F.regexp_extract(col(path), "^(.*)/[^/]*$", 1)


def normalized_path(path: Column | str) -> Column:
    """The path without empty parts, ``.`` and ``..`` (as far as there is something to go up from)."""
    c = col(path)
    rooted = F.startswith(c, F.lit("/"))
    folded = F.aggregate(
        F.filter(F.split(c, "/"), lambda p: (p != "") & (p != ".")),
        F.array().cast("array<string>"),
        lambda done, p: F.when((p == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != ".."), F.slice(done, F.lit(1), F.size(done) - 1)).when((p == "..") & rooted, done).otherwise(F.array_append(done, p)),
    )
    out = F.concat(F.when(rooted, F.lit("/")).otherwise(F.lit("")), F.array_join(folded, "/"))
    return F.when(out == "", F.lit(".")).otherwise(out)


def joined_path(directory: Column, name: Column) -> Column:
    return F.when(F.startswith(name, F.lit("/")) | (directory == ""), name).otherwise(F.concat(directory, F.lit("/"), name))


def path_suffixes(path: Column | str) -> Column:
    """All that follows a slash in the path: what a shorter name may stand for."""
    parts = F.split(col(path), "/")
    return F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
