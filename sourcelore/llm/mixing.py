"""Mixing sources to target weights by Poisson replication, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelore.llm.common import stored, whole_text

#: A Poisson count of mean m is the sum of ceil(m / PART) counts of mean m / ceil(m / PART), so that exp(-mean) stays exact.
PART = 8.0
#: Beyond so many terms the distribution function of a mean up to PART is 1 in double precision.
TERMS = 60


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of MD5 over the parts joined by ':'."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, total: float = 1.0, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``(__source, __rate)``: how often a document of each source is to be repeated on average.

    Size is counted in characters. A source's target share is its weight over the sum of the weights of the sources
    present (sources without a weight get 0); with no weights given, size to the power ``alpha``. The rate is target
    share * total size * ``total`` / own size, and 0 for a source of empty texts only. A null source is a source.
    """
    size = docs.groupBy(F.col(source_col).cast("string").alias("__source")).agg(F.sum(F.char_length(whole_text(text_col))).cast("double").alias("size"))
    if weights is None:
        size = size.withColumn("weight", F.pow("size", F.lit(float(alpha))))
    else:
        if any(w < 0 for w in weights.values()):
            raise ValueError("weights must not be negative")
        table = F.create_map(*[F.lit(x) for k, w in sorted(weights.items()) for x in (k, float(w))]) if weights else F.lit(None).cast("map<string,double>")
        size = size.withColumn("weight", F.coalesce(F.try_element_at(table, F.col("__source")), F.lit(0.0)))
    whole = size.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    rate = F.when((F.col("size") > 0) & (F.col("all_weight") > 0), F.col("weight") / F.col("all_weight") * F.col("all_size") * F.lit(float(total)) / F.col("size")).otherwise(F.lit(0.0))
    return size.join(F.broadcast(whole)).select("__source", rate.alias("__rate"))  # one row is broadcast


def poisson_count(rate: Column, distribution: Column, parts: Column, seed: int, row: list[Column]) -> Column:
    """The count whose cumulative probability first exceeds the row's own uniform number, summed over the parts."""
    draws = F.transform(F.sequence(F.lit(1), parts), lambda part: uniform(F.lit(str(seed)), *row, part.cast("string")))
    return F.when(rate > 0, F.aggregate(draws, F.lit(0), lambda total, u: total + F.size(F.filter(distribution, lambda p: p <= u)))).otherwise(F.lit(0))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, total: float = 1.0, seed: int = 42, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs`` with each row repeated by a Poisson count with its source's rate as mean, in a global random order.

    Adds ``mix_rate``, ``mix_copies`` (the count), ``mix_copy`` (1 to the count) and ``mix_key``, a uniform number: rows are
    dealt out by the key and sorted by it within a partition, so that any run of rows is a random draw from all sources.
    The uniform number of a row depends on seed and id alone: the result is the same however the table is split, and
    lost tasks repeat their draw. Rows that repeat an id draw alike. Null ids draw as ''. An empty table gives an empty
    result; columns of the four added names are replaced. Sources meet their rate by an equi-join that Spark may
    broadcast by size or split by skew.
    """
    terms = F.sequence(F.lit(1), F.lit(TERMS))
    rate = rates(docs, weights, alpha, total, source_col, text_col).withColumn("__parts", F.greatest(F.lit(1), F.ceil(F.col("__rate") / F.lit(PART))).cast("int"))
    mean = F.col("__rate") / F.col("__parts")
    first = F.exp(-mean)
    # p(k) = p(k-1) * mean / k; the running sum is the distribution function
    folded = F.aggregate(
        terms, F.struct(first.alias("p"), first.alias("sum"), F.array(first).alias("all")),
        lambda s, k: F.struct((s["p"] * mean / k).alias("p"), (s["sum"] + s["p"] * mean / k).alias("sum"), F.array_append(s["all"], s["sum"] + s["p"] * mean / k).alias("all")),
        lambda s: s["all"],
    )
    rate = stored(rate.withColumn("__cdf", folded), "rates")  # of known size: Spark broadcasts it, or not, by its threshold
    row = [F.coalesce(F.col(id_col).cast("string"), F.lit(""))]
    own = docs.join(rate, docs[source_col].cast("string").eqNullSafe(rate["__source"]))
    own = own.withColumn("mix_copies", poisson_count(F.col("__rate"), F.col("__cdf"), F.col("__parts"), seed, row)).where("mix_copies > 0")
    own = own.withColumn("mix_rate", F.col("__rate")).drop("__source", "__rate", "__parts", "__cdf")
    copies = own.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
    copies = copies.withColumn("mix_key", uniform(F.lit(f"{seed}:order"), *row, F.col("mix_copy").cast("string")))
    return copies.repartition("mix_key").sortWithinPartitions("mix_key", id_col)
