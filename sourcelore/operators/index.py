"""A stored word index: inverted blocks of postings, written by ingest and searched without the chunks' texts.

A table of three folders under one path: ``chunks`` (a number, the place and the terms of each chunk), ``postings`` (a row for each term and range
of ``RANGE`` chunk numbers: arrays of chunks, frequencies and sizes, their number, sum of frequencies and bounds), ``totals`` (chunks and terms of
each snapshot). A batch adds whole snapshots; a snapshot that the index has isn't added again. ``totals`` is written last and
says which batches count, so a batch that failed is as if it never was.

Postings are made where their chunks lie, and aren't shuffled: a task builds the rows of its own ranges from its chunks' terms. They lie
in folders by the hash of their term, each task's file sorted by term, so that a search for few terms opens few folders and few row
groups. Searches that join few postings read bounds first and postings only where these can matter; others read the chunks' terms
in a pass (see ``bm25``).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sourcelore.functions.text import terms
from sourcelore.operators.scoring import B, K1, best_sums
from sourcelore.operators.search import cut_hits, inverse_frequency, query_terms
from sourcelore.storage import durable, exists

RANGE = 16
BUCKETS = 16
#: Up to so many distinct asked terms are written into the filter of the scan.
MOST_PUSHED = 1_000
MOST_BROADCAST = 200_000
#: A search that joins more pairs of query and posting than this is a pass over the chunks' terms.
MOST_JOINED = 2_000_000
#: Scores are rounded to nine digits, and sums differ in the last ones by their order.
SLACK = 1e-6

_CHUNK = "no long, chunk_id string, snapshot_id string, repository string, path string, start_line int, end_line int, size int, tokens array<string>, batch int"
_POSTING = "term string, range long, n int, times int, most_tf int, least_size int, nos array<long>, tfs array<int>, sizes array<int>, batch int, bucket int"
_TOTAL = "snapshot_id string, chunks long, terms long, batch int"
_BLOCK = _POSTING.replace("batch int, ", "")
_BLOCK_FIELDS = [field.split()[0] for field in _BLOCK.split(", ")]


class WordIndex:
    """The tables of an index, as far as its batches are complete."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        known = exists(spark, f"{path}/totals")
        self.totals = spark.read.schema(_TOTAL).parquet(f"{path}/totals") if known else spark.createDataFrame([], _TOTAL)
        self.batches = sorted(r["batch"] for r in self.totals.select("batch").distinct().collect())  # one a write
        read = lambda name, shape: spark.read.schema(shape).parquet(f"{path}/{name}").where(F.col("batch").isin(self.batches)) if known else spark.createDataFrame([], shape)
        self.chunks, self.postings = read("chunks", _CHUNK), read("postings", _POSTING)

    def asked(self, wanted: DataFrame) -> DataFrame:
        """The postings of the terms of ``wanted(term)``. Few terms go into the scan's filter: their folders and row groups
        alone are read. More terms are joined; they would touch every folder anyway."""
        wanted = wanted.select("term").distinct()
        few = wanted.withColumn("bucket", _bucket()).limit(MOST_PUSHED + 1).collect()
        if len(few) <= MOST_PUSHED:
            return self.postings.where(F.col("bucket").isin(sorted({r["bucket"] for r in few})) & F.col("term").isin(sorted(r["term"] for r in few)))
        small = wanted.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
        return self.postings.join(F.broadcast(wanted) if small else wanted, "term", "left_semi")


def _bucket() -> Column:
    return F.pmod(F.crc32("term"), F.lit(BUCKETS)).cast("int")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of ``(no, size, tokens)``: a row for each term and range. Chunks of the last range wait for the next batch; a range
    whose chunks two tasks read has a row from each."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        ranges = rows["no"].to_numpy() // RANGE
        upto = int(np.flatnonzero(ranges != ranges[-1])[-1]) + 1 if (ranges != ranges[-1]).any() else 0
        held = rows.slice(upto)
        if upto:
            yield from _posted(rows.slice(0, upto))
    if held is not None:
        yield from _posted(held)


def _posted(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """By bucket, term and range, so that the sort of a task's rows finds them in long runs."""
    rows = rows.sort_by("no")
    no, size, tokens = rows["no"].to_numpy(), rows["size"].to_numpy(), rows["tokens"].combine_chunks()
    found = tokens.flatten().dictionary_encode()
    if not len(found):
        return
    bucket = np.array([zlib.crc32(term.encode()) % BUCKETS for term in found.dictionary.to_pylist()], np.int32)
    order = pc.sort_indices(pa.table({"bucket": bucket, "term": found.dictionary}), [("bucket", "ascending"), ("term", "ascending")]).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    key, tf = np.unique(place[found.indices.to_numpy()] * len(no) + np.repeat(np.arange(len(no)), tokens.value_lengths().to_numpy()), return_counts=True)
    place, row = np.divmod(key, len(no))
    at, size, tf = no[row] // RANGE, size[row], tf.astype(np.int32)
    first = np.flatnonzero(np.diff(place, prepend=-1) | np.diff(at, prepend=-1))
    bounds = np.append(first, len(key)).astype(np.int32)
    term = order[place[first]]
    lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(v)) for v in (no[row], tf, size)]
    sums = [np.add.reduceat(tf, first, dtype=np.int32), np.maximum.reduceat(tf, first), np.minimum.reduceat(size, first)]
    yield pa.RecordBatch.from_arrays([found.dictionary.take(pa.array(term)), *map(pa.array, (at[first], np.diff(bounds), *sums)), *lists, pa.array(bucket[term])], _BLOCK_FIELDS)


def add_snapshots(chunks: DataFrame, path: str) -> WordIndex:
    """Add the snapshots of ``chunks(chunk_id, snapshot_id, repository, path, start_line, end_line, content)`` that the index at
    ``path`` lacks. One writer at a time. Chunks without a term are numbered and counted, and have no postings."""
    spark = chunks.sparkSession
    known = WordIndex(spark, path)
    batch = max(known.batches, default=-1) + 1
    held = known.totals.select("snapshot_id").distinct()
    held = F.broadcast(held) if held.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else held
    new = chunks.join(held, "snapshot_id", "left_anti")
    found = new.select("chunk_id", "snapshot_id", "repository", "path", "start_line", "end_line", terms("content").alias("tokens"))
    numbered = found.withColumns({"no": F.monotonically_increasing_id(), "size": F.size("tokens")})
    stored = f"{path}/chunks/batch={batch}"
    numbered.select("no", "chunk_id", "snapshot_id", "repository", "path", "start_line", "end_line", "size", "tokens").write.mode("overwrite").parquet(stored)
    numbered = spark.read.schema(_CHUNK).parquet(stored).drop("batch")  # numbers must outlive their tasks
    blocks = numbered.select("no", "size", "tokens").mapInArrow(_blocks, _BLOCK)
    blocks.sortWithinPartitions("bucket", "term", "range").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/batch={batch}")
    numbered.groupBy("snapshot_id").agg(F.count("*").alias("chunks"), F.sum("size").alias("terms")).write.mode("overwrite").parquet(f"{path}/totals/batch={batch}")
    return WordIndex(spark, path)


def part(tf: str, size: str) -> Column:
    """A term's part of a BM25 score before its weight: grows with tf, falls with size."""
    return F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * F.col(size) / F.col("average")))


def _average(index: WordIndex) -> DataFrame:
    return index.totals.agg(F.sum("chunks").alias("chunks"), (F.sum("terms") / F.sum("chunks")).alias("average"))


def _entries(blocks: DataFrame) -> DataFrame:
    """One row for each posting of the blocks."""
    at = F.inline(F.arrays_zip("nos", "tfs", "sizes"))
    return blocks.select(*[c for c in blocks.columns if c not in ("nos", "tfs", "sizes")], at).withColumnsRenamed({"nos": "no", "tfs": "tf", "sizes": "size"})


class Bounded:
    """A search of the ``first`` best chunks of each query, as steps that read as little as the bounds allow.

    ``heads``: the asked terms' blocks without postings. ``plan``: for each query and term its weight, the most that it
    can add to a score, and whether it is ``rare`` (the query's rarest terms, of some ``first`` * 10 postings) or
    ``needed`` (a chunk without any such term can't be among the best).
    """

    def __init__(self, index: WordIndex, queries: DataFrame, first: int, scope: DataFrame | None = None) -> None:
        self.index, self.first = index, first
        wanted = durable(query_terms(queries), "asked")
        self.blocks = index.asked(wanted)
        average = F.broadcast(_average(index))  # one row
        self.heads = durable(self.blocks.select("batch", "term", "range", "n", "most_tf", "least_size").join(average).withColumn("most", part("most_tf", "least_size")), "heads")
        weights = self.heads.groupBy("term", "chunks", "average").agg(F.sum("n").alias("n"), F.max("most").alias("most"))
        own = wanted.join(weights, "term").withColumn("weight", F.col("times") * inverse_frequency()).withColumn("bound", F.col("weight") * F.col("most"))
        rarest = Window.partitionBy("query_id").orderBy("n", "term").rowsBetween(Window.unboundedPreceding, -1)
        own = durable(own.withColumn("rare", F.coalesce(F.sum("n").over(rarest), F.lit(0)) < 10 * first), "weights")
        self.inside = None if scope is None else index.chunks.join(scope.select("snapshot_id").distinct(), "snapshot_id", "left_semi").select("batch", "no")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "batch", "no")
        top = lambda partial: partial.withColumn("at", F.row_number().over(best)).where(F.col("at") <= first)
        last = lambda partial: top(partial).where(F.col("at") == first).select("query_id", F.col("score").alias("floor"))
        # the terms of least bound, as long as all of them together stay below the floor, can't bring a chunk in
        least = Window.partitionBy("query_id").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        planned = own.join(last(self.sums(own.where("rare"))), "query_id", "left")
        self.plan = durable(planned.withColumn("needed", F.sum("bound").over(least) >= F.coalesce("floor", F.lit(0.0)) - SLACK).drop("floor"), "plan")
        partial = durable(self.sums(self.plan.where("needed")).withColumn("range", F.floor(F.col("no") / RANGE)), "partial")
        # as many chunks as are asked for reach the least whole score of the best so far
        self.tried = durable(top(partial).drop("at"), "tried")
        whole = self.completed(self.tried, self.plan.where("not needed")).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("floor"))
        floor = whole.select("query_id", F.when(F.col("n") == first, F.col("floor")).otherwise(0.0).alias("floor"))
        beyond = self.plan.groupBy("query_id").agg(F.coalesce(F.sum(F.when(~F.col("needed"), F.col("bound"))), F.lit(0.0)).alias("beyond")).join(floor, "query_id")
        open_ = partial.join(beyond, "query_id").where(F.col("score") + F.col("beyond") >= F.col("floor") - SLACK)
        self.candidates = durable(open_.select("query_id", "batch", "no", "score", "range"), "candidates")

    def sums(self, own: DataFrame) -> DataFrame:
        """``(query_id, batch, no, score)`` over the postings of the given terms of each query."""
        entries = _entries(self.blocks.select("batch", "term", "nos", "tfs", "sizes").join(own.select("query_id", "term", "weight", "average"), "term"))
        if self.inside is not None:
            entries = entries.join(self.inside, ["batch", "no"], "left_semi")
        return entries.groupBy("query_id", "batch", "no").agg(F.sum(F.col("weight") * part("tf", "size")).alias("score"))

    @staticmethod
    def places(chunks: DataFrame, own: DataFrame) -> DataFrame:
        """The blocks of the given terms of each query where its ``chunks`` lie."""
        return chunks.select("query_id", "batch", "range").distinct().join(own.select("query_id", "term", "weight", "average"), "query_id")

    def completed(self, chunks: DataFrame, own: DataFrame) -> DataFrame:
        """``chunks(query_id, batch, no, range, score)`` with the given terms of each query added to their scores."""
        blocks = self.blocks.select("batch", "term", "range", "nos", "tfs", "sizes").join(self.places(chunks, own), ["batch", "term", "range"])
        more = _entries(blocks).select("query_id", "batch", "no", (F.col("weight") * part("tf", "size")).alias("more"))
        more = more.join(chunks.select("query_id", "batch", "no"), ["query_id", "batch", "no"], "left_semi").groupBy("query_id", "batch", "no").agg(F.sum("more").alias("more"))
        return chunks.join(more, ["query_id", "batch", "no"], "left").select("query_id", "batch", "no", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))

    def scores(self) -> DataFrame:
        """``(query_id, batch, no, score)`` of all chunks that may be among the best, whole scores."""
        return self.completed(self.candidates, self.plan.where("not needed")).withColumn("score", F.round("score", 9))

    def work(self) -> DataFrame:
        """``(step, postings)``: the postings that each step joins with queries, and those of a search without bounds."""
        count = lambda step, rows: rows.agg(F.lit(step).alias("step"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("postings"))
        near = lambda chunks, own: self.places(chunks, own).join(self.heads.select("batch", "term", "range", "n"), ["batch", "term", "range"])
        steps = [count("rare", self.plan.where("rare")), count("needed", self.plan.where("needed")), count("tried", near(self.tried, self.plan.where("not needed")))]
        return reduce(DataFrame.union, [*steps, count("rest", near(self.candidates, self.plan.where("not needed"))), count("all", self.plan)])


_PLACE = ["chunk_id", "repository", "snapshot_id", "path", "start_line", "end_line"]


def _scored(index: WordIndex, asked: DataFrame, first: int, average: float | None = None, scope: DataFrame | None = None) -> DataFrame:
    """What may be among the ``first`` best of each query, by a pass over the chunks' terms."""
    rows = index.chunks.select(*_PLACE, "size", "tokens")
    rows = rows if scope is None else rows.join(scope.select("snapshot_id").distinct(), "snapshot_id", "left_semi")
    return best_sums(rows, asked, first, average)


def bm25(index: WordIndex, queries: DataFrame, top_k: int = 10, scope: DataFrame | None = None) -> DataFrame:
    """The hits of ``search.bm25`` over the index's chunks, same rows. Where many postings would meet many queries, each chunk is
    scored in a pass over the chunks' terms, and pairs don't leave their task. Where few would, by bounds:

    1. the asked terms' blocks are read without their postings, for weights and for the most that a term can add;
    2. the postings of each query's rarest terms give a floor: a score that 5k chunks reach by these terms alone;
    3. terms that can't lift a chunk to the floor, even all together, aren't needed; the postings of the others are summed, and the 5k
       best of these sums get their whole scores from the blocks where they lie: a higher floor;
    4. chunks that the bounds of the rest can't lift to it are dropped; the blocks around the others complete their scores.
    """
    wanted = durable(query_terms(queries), "asked")
    frequency = index.asked(wanted).groupBy("term").agg(F.sum("n").alias("n"))
    weights = durable(wanted.join(frequency, "term"), "frequency")
    if (weights.agg(F.sum("n")).first()[0] or 0) <= MOST_JOINED:
        scored = Bounded(index, queries, 5 * top_k, scope).scores()
        return cut_hits(scored.join(index.chunks.select("batch", "no", *_PLACE), ["batch", "no"]).drop("batch", "no"), top_k)
    whole = _average(index).first()  # one row
    weights = weights.withColumn("chunks", F.lit(whole["chunks"])).select("query_id", "term", (F.col("times") * inverse_frequency()).alias("weight"))
    return cut_hits(_scored(index, weights, 5 * top_k, whole["average"], scope).withColumn("score", F.round("score", 9)), top_k)


def term_frequency(index: WordIndex, queries: DataFrame, top_k: int = 10, most_terms: int = 32) -> DataFrame:
    """The hits of ``search.term_frequency`` over the index's chunks."""
    wanted = query_terms(queries, distinct=True, most=most_terms).select("query_id", "term", F.lit(1.0).alias("weight"))
    return cut_hits(_scored(index, wanted, 5 * top_k).withColumn("score", F.round(F.col("score") * 0.1, 6)), top_k)
