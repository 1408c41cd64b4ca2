"""What files need: candidate paths of a reference, and expansion level by level under a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sourcelore.functions.text import dirname, joined_path, normalized_path, path_suffixes
from sourcelore.storage import durable


KEY = ["directory", "kind", "target"]


def candidates(references: DataFrame, paths: DataFrame, most: int | None = None) -> DataFrame:
    """``(reference_id, candidate)`` for ``references(reference_id, path, kind, target)`` over ``paths(path)``; with ``most`` only of
    references that have no more than that many."""
    return references.withColumn("directory", dirname("path")).join(candidates_of(references, paths, most), KEY).select("reference_id", "candidate")


def candidate_counts(references: DataFrame, paths: DataFrame) -> DataFrame:
    """``(reference_id, candidates, first)`` of references that have candidates: how many, and the first by path. Candidates are counted
    once for each end of a path, not for each directory or reference that asks for it."""
    return references.withColumn("directory", dirname("path")).join(_sized(*_looked_up(references, paths)), KEY).select("reference_id", "candidates", "first")


def candidates_of(references: DataFrame, paths: DataFrame, most: int | None = None) -> DataFrame:
    """``(directory, kind, target, candidate)``: each directory and target is looked up once, however many lines ask; with ``most``
    only those that have no more than that many candidates.

    Exact candidates (relative, as it is, under ``include/``) come first; paths that end with the target count only where
    there is none. Build targets stand for their sources or a directory's build files. Targets with $ or % find nothing.
    """
    direct, rest, ends = _looked_up(references, paths)
    if most is not None:
        few = _sized(direct, rest, ends).where(F.col("candidates") <= most).select(*KEY)
        direct, rest = direct.join(few, KEY, "left_semi"), rest.join(few, KEY, "left_semi")
        ends = ends.join(ends.groupBy("end").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("end"), "end", "left_semi")
    return direct.union(rest.join(ends, "end").select(*KEY, "candidate").distinct())


def _sized(direct: DataFrame, rest: DataFrame, ends: DataFrame) -> DataFrame:
    """``(directory, kind, target, candidates, first)``. The ends that one target stands for differ in their last part, so that no path
    has two of them."""
    by_end = ends.groupBy("end").agg(F.count("*").alias("n"), F.min("candidate").alias("least"))
    indirect = rest.distinct().join(by_end, "end").groupBy(*KEY).agg(F.sum("n").alias("candidates"), F.min("least").alias("first"))
    return direct.groupBy(*KEY).agg(F.count("*").alias("candidates"), F.min("candidate").alias("first")).union(indirect)


def _looked_up(references: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Exact candidates by key, ends asked for by the other keys, and the paths of each of these ends, all distinct."""
    asked = references.select(dirname("path").alias("directory"), "kind", "target").distinct()
    clean = F.trim(F.replace("target", F.lit("\\"), F.lit("/")))
    stem = F.regexp_replace(clean, r"\.o$", "")
    built = F.when(F.endswith(clean, F.lit(".o")), F.array(*[F.concat(stem, F.lit(s)) for s in (".c", ".S", ".s", ".rs")])).when(F.endswith(clean, F.lit("/")), F.array(*[F.concat(clean, F.lit(s)) for s in ("Makefile", "Kbuild", "Kconfig")])).otherwise(F.array(clean))
    good = asked.where((clean != "") & ~F.contains(clean, F.lit("$")) & ~F.contains(clean, F.lit("%")))
    forms = good.select(*KEY, F.explode(F.when(F.col("kind") == "kbuild_target", built).otherwise(F.array(clean))).alias("variant"))
    exact = F.array(normalized_path(joined_path(F.col("directory"), F.col("variant"))), normalized_path("variant"), normalized_path(F.concat(F.lit("include/"), "variant")))
    known = paths.select(F.col("path").alias("candidate")).distinct()
    direct = forms.select(*KEY, F.explode(F.array_distinct(exact)).alias("candidate")).join(known, "candidate").select(*KEY, "candidate").distinct()
    rest = forms.join(direct.select(*KEY).distinct(), KEY, "left_anti").select(*KEY, normalized_path("variant").alias("end"))
    ends = known.select("candidate", F.explode(F.array_distinct(path_suffixes("candidate"))).alias("end")).join(rest.select("end").distinct(), "end", "left_semi")
    return direct, rest, ends


def _firsts(rows: DataFrame, most: int) -> tuple[DataFrame, str | None]:
    """The first ``most`` of ``rows(reference_id, candidate)`` in that order, and the reference of the next row, if there is one.

    Rows are dealt to ranges; the ranges' counts, added up in order, say which one holds the last row, and only within that one
    are rows numbered. So no task sees more than a range, whatever ``most`` is.
    """
    dealt = durable(rows.select("reference_id", "candidate").repartitionByRange("reference_id", "candidate").withColumn("part", F.spark_partition_id()))
    before = 0
    for part, n in sorted(map(tuple, dealt.groupBy("part").count().collect())):  # a row a partition
        if before + n > most:
            within = dealt.where(F.col("part") == part).withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy("reference_id", "candidate")))
            stop = within.where(F.col("at") == most - before + 1).first()["reference_id"]
            return dealt.where(F.col("part") < part).select("candidate").union(within.where(F.col("at") <= most - before).select("candidate")), stop
        before += n
    return dealt.select("candidate"), None


def expand(seeds: DataFrame, references: DataFrame, paths: DataFrame, depth: int, most_files: int, most_candidates: int = 8) -> tuple[DataFrame, dict]:
    """Files that ``seeds(path)`` need, level by level, with counters.

    ``references(path, kind, target, line_number, place)`` are those of all files. At each level candidates stand in the
    order of source path, reference and candidate path; the first new file over the budget stops all, and counters
    stop there too. A reference with over ``most_candidates`` is unresolved and truncates. Returns ``(path, level)``
    (level 0: seeds) and the counts. The loop runs at most ``depth`` times; only counts come to the driver.
    """
    if depth < 0 or most_files < 1 or most_candidates < 1:
        raise ValueError("depth must not be negative, and limits must be positive")
    ordered = references.withColumn("reference_id", F.concat_ws("\0", "path", F.lpad(F.col("line_number").cast("string"), 9, "0"), F.lpad(F.col("place").cast("string"), 6, "0")))
    ordered = durable(ordered)
    sizes = durable(candidate_counts(ordered, paths).select("reference_id", F.col("candidates").alias("n")))
    found = durable(candidates(ordered, paths, most_candidates))
    chosen = seeds.select("path").distinct().withColumn("level", F.lit(0))
    counts = {"seed_files": chosen.count(), "dependency_files": 0, "unresolved": 0, "ambiguous": 0, "truncated": False}
    for level in range(1, depth + 1):
        own = ordered.join(chosen.where(F.col("level") == level - 1).select("path"), "path", "left_semi").select("reference_id")
        sized = own.join(sizes, "reference_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        fresh = found.join(sized.where(F.col("n").between(1, most_candidates)).select("reference_id"), "reference_id", "left_semi").join(chosen.select(F.col("path").alias("candidate")), "candidate", "left_anti")
        first = fresh.groupBy("candidate").agg(F.min("reference_id").alias("reference_id"))
        picked, stop = _firsts(first, most_files - counts["dependency_files"])
        seen = sized if stop is None else sized.where(F.col("reference_id") <= stop)
        over = F.col("n") > most_candidates
        row = seen.agg(F.count_if((F.col("n") == 0) | over).alias("u"), F.count_if(F.col("n") > 1).alias("a"), F.count_if(over).alias("o")).first()
        counts["unresolved"] += row["u"]
        counts["ambiguous"] += row["a"]
        counts["truncated"] |= bool(row["o"]) or stop is not None
        new = durable(picked.select(F.col("candidate").alias("path"), F.lit(level).alias("level")))
        n = new.count()
        counts["dependency_files"] += n
        if n:
            chosen = chosen.union(new)
        if stop is not None or not n:
            break
    return chosen, counts
