"""Symbols, occurrences, conditions, and relations resolved to their targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcelore.functions.ids import stable_id
from sourcelore.functions.text import dirname, joined_path, normalized_path, path_suffixes
from sourcelore.operators.facts import AMBIGUOUS

SYMBOL_KEY = ["repository_id", "language", "kind", "namespace", "name"]


def with_namespace(occurrences: DataFrame) -> DataFrame:
    """A scope (``repository``, ``file``, ``function:f``) with the path where it isn't the whole repository."""
    scope = F.col("scope")
    return occurrences.withColumn("namespace", F.when(scope == "repository", scope).when(scope == "file", F.concat(F.lit("file:"), "path")).otherwise(F.concat(F.lit("file:"), "path", F.lit(":"), scope)))


def logical_symbols(occurrences: DataFrame) -> DataFrame:
    """One symbol for each key; its signature is the first that is given, by path and line."""
    first = F.min_by("signature", F.when(F.col("signature").isNotNull(), F.struct("path", "start_line", "signature")))
    return occurrences.groupBy(*SYMBOL_KEY).agg(first.alias("signature")).withColumn("id", stable_id("symbol", *SYMBOL_KEY))


def occurrence_rows(occurrences: DataFrame) -> DataFrame:
    """Distinct by file, symbol, role and lines; the first condition by its id stays."""
    keyed = occurrences.withColumn("logical_symbol_id", stable_id("symbol", *SYMBOL_KEY))
    key = ["snapshot_id", "file_id", "logical_symbol_id", "role", "start_line", "end_line"]
    rest = [F.min(c).alias(c) for c in ("condition_id",) if c in keyed.columns]
    out = keyed.groupBy(*key).agg(F.count("*").alias("times"), *rest)
    return out.withColumn("id", stable_id("occurrence", "file_id", "logical_symbol_id", "role", "start_line", "end_line"))


def condition_rows(*ranges: DataFrame) -> DataFrame:
    """``(file_id, expression, start_line, end_line, depth)`` of all origins, each once, with ids."""
    cols = ["file_id", "expression", "start_line", "end_line", "depth"]
    out = ranges[0].select(*cols)
    for more in ranges[1:]:
        out = out.unionByName(more.select(*cols))
    return out.where("expression is not null").dropDuplicates(cols).withColumn("id", stable_id("condition", *cols))


def symbol_maps(occurrences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """By file, name and kind: the last definition. By snapshot, name and kind: the only symbol, and how many there are.

    One row for each key, so what joins them never multiplies.
    """
    defined = occurrences.where("role = 'definition'")
    here = defined.groupBy("file_id", "name", "kind").agg(F.max_by("logical_symbol_id", F.struct("start_line", "logical_symbol_id")).alias("here"))
    there = defined.groupBy("snapshot_id", "name", "kind").agg(F.countDistinct("logical_symbol_id").alias("n"), F.min("logical_symbol_id").alias("there"))
    return here, there


def _resolve(rows: DataFrame, maps: tuple[DataFrame, DataFrame], name: str, kind: str, out: str) -> DataFrame:
    here, there = maps
    rows = rows.join(here.withColumnsRenamed({"name": name, "kind": kind}), ["file_id", name, kind], "left")
    rows = rows.join(there.withColumnsRenamed({"name": name, "kind": kind}), ["snapshot_id", name, kind], "left")
    return rows.withColumn(out, F.coalesce("here", F.when(F.col("n") == 1, F.col("there")))).withColumn(f"{out}_count", F.coalesce("n", F.lit(0))).drop("here", "there", "n")


def resolve_source(relations: DataFrame, maps: tuple[DataFrame, DataFrame]) -> DataFrame:
    """``source_symbol_id``: the symbol of the file, else the only one of that name and kind in the snapshot."""
    return _resolve(relations, maps, "source_name", "source_kind", "source_symbol_id")


def resolve_target(relations: DataFrame, maps: tuple[DataFrame, DataFrame]) -> DataFrame:
    """``target_symbol_id`` likewise; a call without one, and anything that could be several, is an ambiguous candidate."""
    found = _resolve(relations.withColumn("target_name", F.col("target_text")), maps, "target_name", "target_kind", "target_symbol_id")
    vague = F.col("target_symbol_id").isNull() & F.col("target_kind").isNotNull() & ((F.col("kind") == "calls") | (F.col("target_symbol_id_count") > 1))
    return found.withColumn("confidence", F.when(vague, AMBIGUOUS).otherwise(F.col("confidence"))).drop("target_name")


def include_paths(relations: DataFrame, paths: DataFrame) -> DataFrame:
    """``(relation_id, candidate)`` for ``relations(relation_id, snapshot_id, path, target)`` over ``paths(snapshot_id, path)``:
    the normalised relative path, the target as it is, under ``include/``, and every path that ends with it."""
    found = _candidates_of(relations, paths)
    return _asked(relations).join(found, ["snapshot_id", "directory", "target"]).select("relation_id", "candidate")


def _asked(relations: DataFrame) -> DataFrame:
    return relations.where(~F.contains("target", F.lit("$"))).withColumns({"target": F.replace("target", F.lit("\\"), F.lit("/")), "directory": dirname("path")})


def _candidates_of(relations: DataFrame, paths: DataFrame) -> DataFrame:
    """``(snapshot_id, directory, target, candidate)``: each directory and target is looked up once, however many lines ask."""
    asked, direct, ends = _looked_up(relations, paths)
    return direct.union(asked.join(ends, ["snapshot_id", "target"]).select(*direct.columns)).distinct()


def _looked_up(relations: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is asked, its exact candidates ``(snapshot_id, directory, target, candidate)``, and the paths that end with a target
    ``(snapshot_id, target, candidate)``, all distinct.

    Suffixes are laid out only where some target asks for them: all joins are by equality.
    """
    key = ["snapshot_id", "directory", "target"]
    asked = _asked(relations).select(*key).distinct()
    exact = asked.select(*key, F.explode(F.array_distinct(F.array(normalized_path(joined_path(F.col("directory"), F.col("target"))), "target", F.concat(F.lit("include/"), "target")))).alias("candidate"))
    known = paths.select("snapshot_id", F.col("path").alias("candidate")).distinct()
    direct = exact.join(known, ["snapshot_id", "candidate"]).select(*key, "candidate")
    ends = known.select("snapshot_id", "candidate", F.explode(F.array_distinct(path_suffixes("candidate"))).alias("target"))
    return asked, direct, ends.join(asked.select("snapshot_id", "target").distinct(), ["snapshot_id", "target"], "left_semi")


def resolve_include(relations: DataFrame, paths: DataFrame) -> DataFrame:
    """``relations`` with ``target_path_found`` where there is one candidate, ``candidates``, and vague confidence for several.

    Relations meet one row for their directory and target, and these one row for each end of a path, so nothing multiplies by
    candidates."""
    key = ["snapshot_id", "directory", "target"]
    asked, direct, ends = _looked_up(relations, paths)
    beside = direct.where(~F.array_contains(path_suffixes("candidate"), F.col("target"))).groupBy(*key).agg(F.count("*").alias("n"), F.min("candidate").alias("one"))
    by_end = ends.groupBy("snapshot_id", "target").agg(F.count("*").alias("m"), F.min("candidate").alias("other"))
    found = asked.join(by_end, ["snapshot_id", "target"], "left").join(beside, key, "left").withColumns({"candidates": F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0)), "only": F.coalesce("one", "other")}).where("candidates > 0")
    found = found.select(F.col("snapshot_id"), F.col("directory").alias("__directory"), F.col("target").alias("__target"), "candidates", "only")
    open_target = F.when(~F.contains("target", F.lit("$")), F.replace("target", F.lit("\\"), F.lit("/")))
    keyed = relations.withColumns({"__target": open_target, "__directory": dirname("path")})
    out = keyed.join(found, ["snapshot_id", "__directory", "__target"], "left").drop("__directory", "__target").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    return out.withColumn("target_path_found", F.when(F.col("candidates") == 1, F.col("only"))).withColumn("confidence", F.when(F.col("candidates") > 1, AMBIGUOUS).otherwise(F.col("confidence"))).drop("only")


def relation_ids(relations: DataFrame) -> DataFrame:
    """Relations with ids over their resolved identity."""
    identity = ["source_file_id", "source_symbol_id", "target_file_id", "target_symbol_id", "condition_id", "kind", "target_text", "start_line", "end_line"]
    return relations.withColumn("id", stable_id("relation", *identity))


def relation_rows(relations: DataFrame) -> DataFrame:
    """Relations with ids over their resolved identity, each once."""
    return relation_ids(relations).dropDuplicates(["id"])
