"""Facts of source files that a line shows by itself: includes, configuration options, build lists, references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcelore.functions.text import lines

EXACT, INFERRED, AMBIGUOUS = "source_exact", "source_inferred", "ambiguous_candidate"
C_LANGUAGES = ("c", "c-header", "assembly-preprocessed")

_ENDS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
#: An option's name: capitals, digits and underscores.
_OPTION = r"\b[A-Z][A-Z0-9_]+\b"


def _included(line: Column) -> Column:
    """What stands behind ``#include`` on a line, with its quotes or brackets; null if it is no such line."""
    said = F.ltrim(F.substring_index(F.ltrim(line), "#", -1))
    found = F.regexp_extract(F.ltrim(F.substring(said, F.lit(8), F.char_length(said))), """^("[^">]+|<[^">]+)[">]""", 0)
    return F.when(F.startswith(F.ltrim(line), F.lit("#")) & F.startswith(said, F.lit("include")) & (found != ""), found)


def _unquoted(text: Column) -> Column:
    return F.substring(text, F.lit(2), F.char_length(text) - 2)


def _sourced(line: Column) -> Column:
    """The file that a configuration line takes in; null if none."""
    words, quoted = _words(line), F.split(line, '"')
    return F.when(F.get(words, 0).isin("source", "rsource") & F.startswith(F.get(words, 1), F.lit('"')) & (F.size(quoted) >= 3), F.nullif(F.get(quoted, 1), F.lit("")))


def _assigned(line: Column, *signs: str) -> tuple[Column, Column]:
    """What stands to the left and the right of a build line's assignment, if it is made by one of the signs."""
    sign = F.regexp_extract(line, r"^[^=]*?([:+?]?=)", 1)
    at = F.instr(line, "=")
    ok = sign.isin(*signs)
    return F.when(ok, F.trim(F.substring(line, F.lit(1), at - F.char_length(sign)))), F.when(ok, F.trim(F.substring(line, at + 1, F.char_length(line))))


RELATION = "file_id, kind, source_name, source_kind, target_text, target_kind, target_path, start_line, end_line, condition, confidence".split(", ")


def numbered(files: DataFrame, text_col: str = "text") -> DataFrame:
    """``(file_id, language, line_number, line)`` without line ends."""
    own = files.select("file_id", "language", F.posexplode(lines(text_col)).alias("at", "raw"))
    return own.select("file_id", "language", (F.col("at") + 1).alias("line_number"), F.rtrim(F.col("raw"), F.lit(_ENDS)).alias("line"))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def _relation(rows: DataFrame, kind: Column | str, target: Column, confidence: Column | str, source: Column | None = None, source_kind: str | None = None, target_kind: str | None = None, is_path: bool = False, condition: Column | None = None) -> DataFrame:
    null = F.lit(None).cast("string")
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    line = F.col("line_number").cast("int")
    return rows.select(
        "file_id", as_col(kind).alias("kind"), (null if source is None else source).alias("source_name"), F.lit(source_kind).cast("string").alias("source_kind"), target.alias("target_text"), F.lit(target_kind).cast("string").alias("target_kind"),
        (target if is_path else null).alias("target_path"), line.alias("start_line"), line.alias("end_line"), (null if condition is None else condition).alias("condition"), as_col(confidence).alias("confidence"),
    )


def includes(files: DataFrame) -> DataFrame:
    """``#include`` lines of C: quoted ones are exact, others inferred."""
    own = numbered(files.where(F.col("language").isin(*C_LANGUAGES))).withColumn("said", _included(F.col("line"))).where("said is not null")
    return _relation(own, "includes", _unquoted(F.col("said")), F.when(F.startswith("said", F.lit('"')), EXACT).otherwise(INFERRED), is_path=True)


def kconfig(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Option definitions, and what each depends on, selects, implies and sources."""
    own = numbered(files.where("language = 'kconfig'")).withColumn("words", _words(F.col("line")))
    word = lambda i: F.get("words", i)
    own = own.withColumn("defined", F.when(word(0).isin("config", "menuconfig"), F.nullif(F.regexp_extract(word(1), r"^\w+", 0), F.lit(""))))
    above = Window.partitionBy("file_id").orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("option", F.last("defined", ignorenulls=True).over(above))
    definitions = own.where("defined is not null").select("file_id", F.col("defined").alias("name"), F.lit("config").alias("kind"), F.lit("definition").alias("role"), F.col("line_number").cast("int").alias("start_line"), F.col("line_number").cast("int").alias("end_line"), F.lit("repository").alias("scope"), F.trim("line").alias("signature"))
    rest = own.where("defined is null")
    bound = rest.where("option is not null")
    after = lambda n: F.array_join(F.slice("words", n + 1, F.size("words")), " ")
    names = F.array_sort(F.array_distinct(F.regexp_extract_all(after(2), F.lit(_OPTION), F.lit(0))))
    depends = bound.where((word(0) == "depends") & (word(1) == "on")).withColumn("target", F.explode(names))
    selects = bound.where(word(0).isin("select", "imply") & F.regexp_like(word(1), F.lit(r"^[A-Z][A-Z0-9_]+$")) & ((F.size("words") == 2) | ((word(2) == "if") & (F.size("words") > 3))))
    sources = rest.withColumn("file", _sourced(F.col("line"))).where("file is not null")
    option = F.col("option")
    return definitions, reduce(DataFrame.unionByName, [
        _relation(depends, "depends_on_config", F.col("target"), EXACT, option, "config", "config"),
        _relation(selects, F.concat(word(0), F.lit("s_config")), word(1), EXACT, option, "config", "config", condition=F.nullif(after(3), F.lit(""))),
        _relation(sources, "includes_config", F.col("file"), EXACT, is_path=True),
    ])


def kbuild(files: DataFrame) -> DataFrame:
    """``owner-$(CONFIG_X) += targets`` and ``owner-y`` or ``-m``: one relation for each target."""
    left, right = _assigned(F.col("line"), "=", "+=")
    own = numbered(files.where("language = 'kbuild'")).select("file_id", "line_number", left.alias("left"), right.alias("right")).where("left is not null")
    # the last part of the name says when its targets are built
    when = F.substring_index("left", "-", -1)
    owner = F.substring(F.col("left"), F.lit(1), F.char_length("left") - F.char_length(when) - 1)
    config = F.nullif(F.regexp_extract(when, r"^\$\((CONFIG_\w+)\)$", 1), F.lit(""))
    rows = own.where(F.contains("left", F.lit("-")) & (when.isin("y", "m") | config.isNotNull()) & F.regexp_like(owner, F.lit("^[A-Za-z0-9_./-]+$")))
    rows = rows.select("file_id", "line_number", owner.alias("owner"), config.alias("config"), F.explode(_words(F.col("right"))).alias("target")).where(~F.startswith("target", F.lit("$(")))
    return _relation(rows, "kbuild_contains", F.col("target"), EXACT, F.col("owner"), "kbuild_target", is_path=True, condition=F.col("config"))


def line_relations(files: DataFrame) -> DataFrame:
    """All relations that lines show, by the files' languages."""
    return includes(files).unionByName(kconfig(files)[1]).unionByName(kbuild(files))


def references(files: DataFrame) -> DataFrame:
    """``(file_id, kind, target, line_number, place)``: what a file needs, in the order it names it."""
    own = numbered(files)
    c = own.where(F.col("language").isin(*C_LANGUAGES) & _included(F.col("line")).isNotNull()).select("file_id", F.lit("include").alias("kind"), _unquoted(_included(F.col("line"))).alias("target"), "line_number", F.lit(0).alias("place"))
    k = own.where((F.col("language") == "kconfig") & _sourced(F.col("line")).isNotNull()).select("file_id", F.lit("kconfig_source").alias("kind"), _sourced(F.col("line")).alias("target"), "line_number", F.lit(0).alias("place"))
    left, right = _assigned(F.col("line"), "=", "+=", ":=")
    named = own.where(F.col("language") == "kbuild").select("file_id", "line_number", left.alias("left"), right.alias("right")).where((F.col("left") != "") & ~F.contains("left", F.lit("#")) & ~F.contains("left", F.lit(":")))
    b = named.select("file_id", F.lit("kbuild_target").alias("kind"), F.posexplode(_words(F.col("right"))).alias("place", "target"), "line_number")
    b = b.where(F.regexp_like("target", F.lit(r"(\.o|\.a|/)$")) | F.col("target").isin("Makefile", "Kbuild", "Kconfig")).select("file_id", "kind", "target", "line_number", "place")
    return c.unionByName(k).unionByName(b)


def condition_at(rows: DataFrame, conditions: DataFrame, bucket: int = 64) -> DataFrame:
    """``rows(file_id, start_line, ...)`` with ``condition_id`` of the deepest range around their line, if any.

    Ranges are laid out to the buckets of lines they touch: a line meets those of its bucket only. The deepest of each
    place is found once, then it meets the rows.
    """
    c = conditions.select("file_id", F.explode(F.sequence(F.floor(F.col("start_line") / bucket), F.floor(F.col("end_line") / bucket))).alias("__bucket"), F.col("start_line").alias("__from"), F.col("end_line").alias("__to"), "depth", "condition_id")
    places = rows.select("file_id", "start_line").distinct().withColumn("__bucket", F.floor(F.col("start_line") / bucket))
    near = places.join(c, ["file_id", "__bucket"]).where("start_line between __from and __to")
    deepest = near.groupBy("file_id", "start_line").agg(F.max_by("condition_id", F.struct("depth", "condition_id")).alias("condition_id"))
    return rows.join(deepest, ["file_id", "start_line"], "left")
