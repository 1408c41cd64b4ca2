"""What several operators share: shared storage, text columns, connected components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelore.storage import dropped
from sourcelore.storage import durable as stored

__all__ = ["ascii_lower", "components", "dropped", "id_crc_mod", "local_components", "stored", "tiles", "whole_text"]

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Space and the bytes 0x09 to 0x0D: what bytes.split() and bytes.strip() take as white space too.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def tiles(rows: DataFrame, keys: list[str], most_build: int = 2048, most_probe: int = 8192, sizes: DataFrame | None = None) -> DataFrame:
    """Deal the rows of every key group out to tiles of bounded size, as columns ``i, j``.

    ``rows`` has ``role`` (0: build, 1: probe) and ``c`` (an id) besides the keys. Every pair of a build and a probe of a
    group meets in exactly one tile. Groups within the bounds are one tile; in others each build goes to one row of
    tiles and each probe to one column, by a hash of its id. ``sizes(*keys, role, n)`` spares reading the rows twice.
    """
    sizes = rows.groupBy(*keys, "role").agg(F.count("*").alias("n")) if sizes is None else sizes
    parts = lambda role, most: F.ceil(F.max(F.when(F.col("role") == role, F.col("n"))) / most).cast("int")
    large = sizes.groupBy(*keys).agg(parts(0, most_build).alias("ni"), parts(1, most_probe).alias("nj")).where("ni > 1 or nj > 1")
    large = large.select(*keys, F.coalesce("ni", F.lit(1)).alias("ni"), F.coalesce("nj", F.lit(1)).alias("nj"))
    own = lambda n: F.array(F.pmod(F.xxhash64("c"), F.coalesce(F.col(n), F.lit(1))).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1)
    dealt = rows.join(large, keys, "left").withColumn("i", F.explode(F.when(F.col("role") == 0, own("ni")).otherwise(every("ni"))))
    return dealt.withColumn("j", F.explode(F.when(F.col("role") == 1, own("nj")).otherwise(every("nj")))).drop("ni", "nj")


def whole_text(column: str = "text") -> Column:
    """The text, null taken as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all else kept. Pure ASCII takes the fast path of ``lower``."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, ASCII_UPPER, ASCII_LOWER))


def id_crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and edges (a, b): each node's smallest reachable node. Vectorised label spreading with pointer jumps."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return label


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a long, b long)`` as ``(node, root)`` with the smallest node as root.

    Alternates large-star and small-star steps (Kiveris et al., "Connected components in MapReduce and beyond", 2014):
    every step is one minimum per node (combined before the shuffle) and one equi-join, so a node with very many
    neighbours is never gathered in one place. Each round is written to the shared folder. Nodes without an edge
    don't appear. Null ends and loops are ignored.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        now = stored(small.distinct(), "stars")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
