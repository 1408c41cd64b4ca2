"""Embeddings: near-duplicates by a subspace pigeonhole join, nearest neighbours by balanced posting lists."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from sourcelore.llm.common import components, local_components, stored, tiles


def vector_type(table: DataFrame, vec_col: str) -> str:
    """Single precision for vectors that have it, else double: it halves what is shuffled."""
    return "array<float>" if isinstance(table.schema[vec_col].dataType.elementType, FloatType) else "array<double>"


def usable(v: Column) -> Column:
    """Not null, not empty, all components finite and not null, not all zero."""
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: F.coalesce(x != 0, F.lit(False))), F.lit(False))


def matrix(column: pd.Series) -> np.ndarray:
    """Rows of equally long lists as doubles."""
    return np.stack([np.asarray(x, dtype=np.float64) for x in column.to_numpy()])


@cache
def rotation(d: int, seed: int = 11) -> np.ndarray:
    """A random rotation of d dimensions: it spreads what sets vectors apart over all blocks."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def spans(d: int, blocks: int) -> list[tuple[int, int]]:
    """The blocks' first and last dimensions, as even as can be."""
    n = min(blocks, d)
    cuts = [d * i // n for i in range(n + 1)]
    return list(zip(cuts, cuts[1:]))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * (a @ b.T)


#: Cells are fitted on at most so many vectors, those with the smallest hash; every vector is joined.
MOST_FITTED = 16_000
#: A cell for so many vectors, and at most so many cells a block: this bounds what is broadcast.
PER_CELL, MOST_CELLS = 1_024, 1_024
#: So many neighbouring cells are joined by one task.
CELLS_A_SHARD = 8


def cells(x: np.ndarray, centroids: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's cell (that of its nearest centroid), and a mask of the cells that may hold vectors within ``reach``.

    What is nearer to centroid j than to i lies beyond their bisector; a vector that lies further than ``reach`` on i's side
    has no such neighbour. The bisectors with the six nearest centroids are tried.
    """
    far = _squares(x, centroids)
    near = np.argsort(far, axis=1, kind="stable")[:, :6]
    apart = 2 * np.sqrt(np.maximum(_squares(centroids, centroids), 1e-24))
    open_ = np.ones(far.shape, bool)
    for i in near.T:
        open_ &= (far - np.take_along_axis(far, i[:, None], 1)) / apart[i] <= reach + 1e-9
    return near[:, 0], open_


def by_shard(row: np.ndarray, to: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Rows and the shards (``size`` numbers each) of what they go to, each pair once, with the numbers there."""
    order = np.lexsort((to, row))
    row, to = row[order], to[order].astype(np.int32)
    shard = to // size
    cut = np.flatnonzero((np.diff(row) != 0) | (np.diff(shard) != 0)) + 1
    first = np.concatenate(([0], cut)) if len(row) else np.zeros(0, np.int64)
    return row[first], shard[first], np.split(to, cut) if len(row) else []


class Verifier:
    """Pairs of builds and probes whose first block within its budget is this one, and whose cosine is at or over the bound."""

    def __init__(self, builds: np.ndarray, probes: np.ndarray, block: int, limit: float, min_cosine: float, blocks: int) -> None:
        self.d = builds.shape[1]
        self.raw, self.block, self.limit, self.min_cosine = (probes, builds), block, limit, min_cosine
        self.norm = [np.sqrt((x**2).sum(1)) for x in self.raw]
        self.unit = [x / n[:, None] for x, n in zip(self.raw, self.norm)]
        self.turned = [x @ rotation(self.d) for x in self.unit]
        self.parts = spans(self.d, blocks)

    def near(self, p: np.ndarray, b: np.ndarray, block: int) -> np.ndarray:
        s, e = self.parts[block]
        return _squares(self.turned[0][p, s:e], self.turned[1][b, s:e]) <= self.limit * (e - s) / self.d

    def links(self, p: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The linked ones among the given probes and builds, as indexes."""
        i, j = np.nonzero(self.near(p, b, self.block))
        i, j = p[i], b[j]
        for s, e in self.parts[: self.block]:
            first = ((self.turned[0][i, s:e] - self.turned[1][j, s:e]) ** 2).sum(1) > self.limit * (e - s) / self.d
            i, j = i[first], j[first]
        product = (self.raw[0][i] * self.raw[1][j]).sum(1)
        linked = product / (self.norm[0][i] * self.norm[1][j]) >= self.min_cosine
        return i[linked], j[linked]


def near_duplicates(table: DataFrame, min_cosine: float = 0.98, blocks: int = 4, per_cell: int = PER_CELL, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(id_col, n_links, component_id, kept)`` for every row: links are pairs of one label with cosine >= ``min_cosine``.

    For unit vectors that is a squared distance of at most 2 - 2 * min_cosine. Rotated vectors are split into blocks of
    dimensions; by the pigeonhole principle some block holds at most its share of that distance. So each block is
    range-joined on its own: every vector is at home in the cell of its nearest centroid there, and probes the cells that its
    range may touch, a shard of neighbouring cells at a time. The number of cells grows with the table. Pairs within a
    block's budget are verified by the exact cosine, and count in their first such block only, so no pair is counted twice.

    Equal vectors of a label are one class with a count; they are never paired up. Crowded shards are dealt out to tiles of
    bounded size. Pairs don't leave their task: it sends the links of each class as a number, and a forest that
    connects what is linked. Vectors that are null, empty, zero or hold null or non-finite components, and those
    with a null label, link with nothing: n_links 0, their own id as component. Vectors of different lengths never link;
    lengths other than the commonest have one cell a block. Components are compared as doubles. Rows that repeat an id are
    vectors of their own. Other columns are ignored. An empty table gives an empty result.
    """
    if not -1 < min_cosine <= 1:
        raise ValueError("min_cosine must be in (-1, 1]")
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(vector_type(table, vec_col)).alias("v"), F.col(label_col).cast("string").alias("label"))
    rows = rows.withColumn("ok", usable(F.col("v")) & F.col("label").isNotNull())
    classes = stored(rows.where("ok").groupBy("label", "v").agg(F.count("*").alias("n"), F.min("id").alias("least")).withColumn("c", F.monotonically_increasing_id()), "vectors")
    limit = 2 - 2 * min_cosine + 1e-9
    length = classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    common, k = (length["d"], max(1, min(MOST_CELLS, length["n"] // per_cell))) if length else (0, 1)

    def turned(x: np.ndarray) -> np.ndarray:
        return (x / np.sqrt((x**2).sum(1))[:, None]) @ rotation(x.shape[1])

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        x = turned(matrix(group.sort_values("c", kind="stable")["v"]))
        made = [(block, c.tolist()) for block, (s, e) in enumerate(spans(common, blocks)) for c in balanced_centroids(x[:, s:e], k, 2)]
        return pd.DataFrame(made, columns=["block", "x"])

    sample = classes.where(F.size("v") == common).orderBy(F.xxhash64("v"), "c").limit(MOST_FITTED).select("c", "v").withColumn("all", F.lit(0))
    fitted = sample.groupBy("all").applyInPandas(fit, "block int, x array<double>").toPandas() if k > 1 else None
    centroids = {b: np.array(own["x"].tolist()) for b, own in fitted.groupby("block", sort=True)} if k > 1 else {}

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, int, int, int, np.ndarray, np.ndarray]]:
        """Of each batch: rows, length, block, role, and which row goes to which cell."""
        for batch in batches:
            for d, own in batch.groupby(batch["v"].map(len).to_numpy()):
                y = turned(matrix(own["v"]))
                for block, (s, e) in enumerate(spans(int(d), blocks)):
                    centre = centroids.get(block) if d == common else None
                    if centre is None:
                        zero = np.zeros(len(own), np.int64)
                        yield from ((own, int(d), block, role, np.arange(len(own)), zero) for role in (0, 1))
                        continue
                    home, open_ = cells(y[:, s:e], centre, np.sqrt(limit * (e - s) / d))
                    yield own, int(d), block, 0, np.arange(len(own)), home
                    yield own, int(d), block, 1, *np.nonzero(open_)

    keys = ["label", "d", "block", "shard"]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own, d, block, role, row, cell in dealt(batches):
            at, shard, _ = by_shard(row, cell, CELLS_A_SHARD)
            size = pd.DataFrame({"label": own["label"].to_numpy()[at], "shard": shard}).value_counts().reset_index(name="n")
            yield pd.DataFrame({"label": size["label"], "d": np.int32(d), "block": np.int32(block), "shard": size["shard"], "role": np.int32(role), "n": size["n"]})

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own, d, block, role, row, cell in dealt(batches):
            at, shard, held = by_shard(row, cell, CELLS_A_SHARD)
            pick = own.iloc[at].reset_index(drop=True)
            yield pd.DataFrame({"label": pick["label"], "d": np.int32(d), "block": np.int32(block), "shard": shard, "role": np.int32(role), "cells": held, "c": pick["c"], "n": pick["n"], "v": pick["v"]})

    sizes = classes.select("label", "v").mapInPandas(count, "label string, d int, block int, shard int, role int, n long").groupBy(*keys, "role").agg(F.sum("n").alias("n"))
    sent = classes.select("label", "c", "n", "v").mapInPandas(send, "label string, d int, block int, shard int, role int, cells array<int>, c long, n long, v " + vector_type(table, vec_col))

    def join(group: pd.DataFrame) -> pd.DataFrame:
        builds, probes = group[group["role"] == 0], group[group["role"] == 1]
        if builds.empty or probes.empty:
            return pd.DataFrame({"c": [], "links": [], "other": []})
        nodes = np.unique(group["c"].to_numpy())
        bc, pc, weight = builds["c"].to_numpy(), probes["c"].to_numpy(), builds["n"].to_numpy(np.int64)
        at_b, at_p = np.searchsorted(nodes, bc), np.searchsorted(nodes, pc)
        verify = Verifier(matrix(builds["v"]), matrix(probes["v"]), int(group["block"].iloc[0]), limit, min_cosine, blocks)
        home = np.array([x[0] for x in builds["cells"]])
        asks = np.repeat(np.arange(len(probes)), [len(x) for x in probes["cells"]]), np.concatenate(probes["cells"].to_numpy())
        label, links = np.arange(len(nodes)), np.zeros(len(probes), np.int64)
        for cell in np.unique(home):
            b, asking = np.flatnonzero(home == cell), asks[0][asks[1] == cell]
            for at in range(0, len(asking), 512):
                p, q = verify.links(asking[at : at + 512], b)
                other = pc[p] != bc[q]
                p, q = p[other], q[other]
                if len(p):
                    np.add.at(links, p, weight[q])
                    label = local_components(len(nodes), np.concatenate((at_p[p], np.arange(len(nodes)))), np.concatenate((at_b[q], label)))
        some, moved = links > 0, np.flatnonzero(label != np.arange(len(nodes)))
        return pd.DataFrame({"c": np.concatenate((pc[some], nodes[moved])), "links": np.concatenate((links[some], np.zeros(len(moved), np.int64))), "other": pd.array([None] * int(some.sum()) + nodes[label[moved]].tolist(), dtype="Int64")})

    found = stored(tiles(sent, keys, sizes=sizes).groupBy(*keys, "i", "j").applyInPandas(join, "c long, links long, other long"), "links")
    roots = components(found.where("other is not null").select(F.col("c").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("c").agg(F.sum("links").alias("links"))
    placed = classes.join(counts, "c", "left").join(roots, F.col("c") == roots.node, "left").select("label", "v", "n", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "c").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component"))
    placed = placed.join(least, "root").select("label", "v", (F.col("links") + F.col("n") - 1).alias("links"), "component")
    done = rows.where("ok").join(placed, ["label", "v"]).select("id", "links", "component")
    alone = rows.where("not ok").select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component"))
    return done.union(alone).select(F.col("id").alias(id_col), F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


#: The index is fitted on at most so many vectors, those with the smallest hash of their id; every vector is indexed.
MOST_SAMPLED = 16_000
#: At most so many lists, whatever the table's size: this bounds what is broadcast. Long lists are cut into parts.
MOST_LISTS = 4_096
#: The number of lists to read is set on at most so many queries, against all rows.
MOST_TRIED = 256
#: So many neighbouring lists are read by one task.
SHARD = 32


class Lists:
    """Centroids of the posting lists and a graph of neighbours among them, searched in memory."""

    def __init__(self, centroids: np.ndarray, degree: int = 16, seed: int = 5) -> None:
        self.centroids = centroids
        k = len(centroids)
        rng = np.random.default_rng(seed)
        near = np.argsort(_squares(centroids, centroids) + np.diag(np.full(k, np.inf)), axis=1, kind="stable")[:, : min(degree, k - 1)]
        there = np.concatenate([near, rng.integers(0, k, (k, min(4, k)))], axis=1)
        here = np.repeat(np.arange(k), there.shape[1])
        both = np.unique(np.concatenate((here * k + there.ravel(), there.ravel() * k + here)))  # both ways, so that all are reached
        self.next = np.split(both % k, np.searchsorted(both // k, np.arange(1, k)))

    def search(self, x: np.ndarray, wanted: int, width: int) -> list[tuple[float, int]]:
        """Up to ``wanted`` lists nearest to x, nearest first: best-first over the graph with a beam of ``width``."""
        k = len(self.centroids)
        start = list(range(0, k, max(1, k // 8)))
        seen = np.zeros(k, dtype=bool)
        seen[start] = True
        far = ((self.centroids[start] - x) ** 2).sum(1)
        open_ = [(float(f), s) for f, s in zip(far, start)]
        heapq.heapify(open_)
        best = [(-f, s) for f, s in open_]
        heapq.heapify(best)
        while open_:
            f, at = heapq.heappop(open_)
            if len(best) >= width and f > -best[0][0]:
                break
            more = self.next[at][~seen[self.next[at]]]
            seen[more] = True
            for g, s in zip(((self.centroids[more] - x) ** 2).sum(1).tolist(), more.tolist()):
                if len(best) < width or g < -best[0][0]:
                    heapq.heappush(open_, (g, s))
                    heapq.heappush(best, (-g, s))
                    if len(best) > width:
                        heapq.heappop(best)
        return sorted((-f, s) for f, s in best)[:wanted]

    def near(self, x: np.ndarray, least: int, ratio: float) -> list[int]:
        """The ``least`` lists nearest to x, and all others within ``1 + ratio`` of the nearest, by the graph: the beam is
        twice as wide as ``least`` at first, as the graph may miss near ones at its rim, and twice as wide again each time until
        it holds them."""
        width = 2 * least
        while True:
            found = self.search(x, width, width)
            bound = (1 + ratio) * np.sqrt(found[0][0])
            if width >= len(self.centroids) or np.sqrt(found[-1][0]) > bound:
                return [s for i, (f, s) in enumerate(found) if i < least or np.sqrt(f) <= bound]
            width *= 2


def balanced_centroids(x: np.ndarray, k: int, rounds: int = 4) -> np.ndarray:
    """k centroids: the sample is halved again and again at the median along a two-means axis, then a few Lloyd rounds."""
    rng = np.random.default_rng(3)
    groups = [(-len(x), "", np.arange(len(x)))]
    while len(groups) < min(k, len(x)):
        _, path, own = heapq.heappop(groups)
        a, b = x[own[rng.integers(len(own))]], x[own[rng.integers(len(own))]]
        for _ in range(3):
            near = ((x[own] - a) ** 2).sum(1) <= ((x[own] - b) ** 2).sum(1)
            if near.all() or not near.any():
                break
            a, b = x[own][near].mean(0), x[own][~near].mean(0)
        order = own[np.argsort(x[own] @ (b - a), kind="stable")]
        heapq.heappush(groups, (-(len(order) // 2), path + "0", order[: len(order) // 2]))
        heapq.heappush(groups, (len(order) // 2 - len(order), path + "1", order[len(order) // 2 :]))
    centroids = np.stack([x[g[2]].mean(0) for g in sorted(groups, key=lambda g: g[1])])  # neighbours in the tree side by side
    for _ in range(rounds):
        near = _squares(x, centroids).argmin(1)
        size = np.bincount(near, minlength=len(centroids))
        total = np.zeros_like(centroids)
        np.add.at(total, near, x)
        centroids = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centroids)
    return centroids


def lift(x: np.ndarray, reach: float) -> np.ndarray:
    """One more dimension that makes all norms ``reach``: then the largest inner product is the smallest distance."""
    return np.column_stack((x, np.sqrt(np.maximum(reach**2 - (x**2).sum(1), 0))))


def own_lists(x: np.ndarray, centroids: np.ndarray, replicas: int, spread: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest lists of each (lifted) vector, and which of them hold it."""
    far = np.sqrt(np.maximum(_squares(x, centroids), 0))
    near = np.argsort(far, axis=1, kind="stable")[:, :replicas]
    own = np.take_along_axis(far, near, 1)
    return near, own <= (1 + spread) * own[:, :1] + 1e-12


def lists_needed(rows: DataFrame, centroids: np.ndarray, reach: float, k: int, recall: float, ratio: float, replicas: int, spread: float) -> int:
    """How many of its nearest lists a query must read, besides those within ``1 + ratio``, for ``recall`` of the true neighbours.

    At most MOST_TRIED queries, drawn apart from the sample that the lists were fitted on, are compared with all rows.
    """
    tried = rows.where("query").orderBy(F.xxhash64("c", F.lit(1)), "c").limit(MOST_TRIED).select("c", "v").toPandas()
    if not len(tried):
        return 1
    ids, asked = tried["c"].to_numpy(), matrix(tried["v"])
    far = np.sqrt(np.maximum(_squares(np.column_stack((asked, np.zeros(len(asked)))), centroids), 0))
    place = np.argsort(np.argsort(far, axis=1, kind="stable"), axis=1)
    place[far <= (1 + ratio) * far.min(1, keepdims=True)] = 0

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held_c, held_s, held_x = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0)), np.zeros((len(ids), 0, asked.shape[1]))
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.iloc[at : at + 4096]
                c, x = part["c"].to_numpy(), matrix(part["v"])
                score = asked @ x.T
                score[ids[:, None] == c[None, :]] = -np.inf
                top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                held_c, held_x = np.concatenate((held_c, c[top]), 1), np.concatenate((held_x, x[top]), 1)
                held_s = np.concatenate((held_s, np.take_along_axis(score, top, 1)), 1)
                top = np.argsort(-held_s, axis=1, kind="stable")[:, :k]
                held_c, held_s, held_x = np.take_along_axis(held_c, top, 1), np.take_along_axis(held_s, top, 1), np.take_along_axis(held_x, top[:, :, None], 1)
        for q in range(len(ids)):
            some = np.isfinite(held_s[q])
            if some.any():
                near, keep = own_lists(lift(held_x[q][some], reach), centroids, replicas, spread)
                need = np.where(keep, place[q][near], len(centroids)).min(1)
                yield pd.DataFrame({"q": q, "c": held_c[q][some], "score": held_s[q][some], "need": need})

    found = rows.select("c", "v").mapInPandas(best, "q int, c long, score double, need int").groupBy("q", "c").agg(F.max("score").alias("score"), F.min("need").alias("need"))
    found = found.withColumn("rank", F.expr("row_number() over (partition by q order by score desc, c)")).where(F.col("rank") <= k)
    need = np.sort(found.select("need").toPandas()["need"].to_numpy())
    return int(need[min(len(need) - 1, int(np.ceil(recall * len(need))))]) + 1 if len(need) else 1


def nearest(table: DataFrame, is_query: Column, k: int = 20, list_size: int = 256, replicas: int = 3, spread: float = 0.03, ratio: float = 0.15, least_lists: int = 16, recall: float = 0.97, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` rows of the largest inner product, its own id left out.

    Vectors go to the posting list of their nearest centroid, and those near a border to up to ``replicas`` lists whose
    distance is within ``1 + spread`` of the nearest. A query searches the graph of centroids and reads the lists within
    ``1 + ratio`` of its nearest, and ``least_lists`` at least, or as many as find
    ``recall`` of the true neighbours of a bounded sample of the queries, which is compared with all rows of this table:
    with little structure in the vectors that is a large part of the lists, at any size. Neighbouring lists travel
    together, SHARD at a time; long and popular ones are cut into tiles, so a task never holds an unbounded list. Scores are exact, in double precision on the original vectors; ties go to the smaller id.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do vectors of another
    length than most, and null ids. Rows that repeat an id count once per different vector (the best of them). Fewer
    candidates than ``k``: all that are found. An empty table gives an empty result.
    """
    spark = table.sparkSession
    rows = table.select(F.col(id_col).cast("long").alias("c"), F.col(vec_col).cast(vector_type(table, vec_col)).alias("v"), is_query.alias("query")).where(F.col("c").isNotNull() & usable(F.col("v")))
    length = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).alias("reach")).orderBy(F.desc("n"), "d").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if length is None:
        return spark.createDataFrame([], empty)
    d, n, reach = length
    rows = rows.where(F.size("v") == d)
    sample = rows.orderBy(F.xxhash64("c"), "c").limit(MOST_SAMPLED).select("c", "v").withColumn("all", F.lit(0))
    lists = max(1, min(MOST_LISTS, n // list_size))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        made = balanced_centroids(lift(matrix(group.sort_values("c", kind="stable")["v"]), reach), lists)
        return pd.DataFrame({"list": range(len(made)), "x": made.tolist()})

    made = sample.groupBy("all").applyInPandas(fit, "list int, x array<double>").orderBy("list").toPandas()
    index = Lists(np.array(made["x"].tolist()))
    least = max(least_lists, lists_needed(rows, index.centroids, reach, k, recall, ratio, replicas, spread))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = matrix(batch["v"])
            near, keep = own_lists(lift(x, reach), index.centroids, replicas, spread)
            row, col = np.nonzero(keep)
            yield _sent(batch, 0, row, near[row, col])
            asked = batch[batch["query"].fillna(False).astype(bool)]
            if len(asked):
                out = []
                for at, q in enumerate(np.column_stack((matrix(asked["v"]), np.zeros(len(asked))))):
                    out += [(at, s) for s in index.near(q, least, ratio)]
                at, to = map(np.array, zip(*out))
                yield _sent(asked, 1, at, to)

    def _sent(own: pd.DataFrame, role: int, row: np.ndarray, to: np.ndarray) -> pd.DataFrame:
        """One row for each vector and shard, with its lists there."""
        at, shard, lists = by_shard(row, to, SHARD)
        return pd.DataFrame({"shard": shard, "role": np.int32(role), "lists": lists, "c": own["c"].to_numpy()[at], "v": own["v"].to_numpy()[at]})

    sent = stored(rows.mapInPandas(send, "shard int, role int, lists array<int>, c long, v " + vector_type(table, vec_col)), "sent")

    def scan(group: pd.DataFrame) -> pd.DataFrame:
        builds, probes = group[group["role"] == 0], group[group["role"] == 1]
        out = []
        if len(builds) and len(probes):
            c, x = builds["c"].to_numpy(), matrix(builds["v"])
            held: dict[int, list[int]] = {}
            for at, lists in enumerate(builds["lists"]):
                for s in lists:
                    held.setdefault(int(s), []).append(at)
            members = {s: np.array(own) for s, own in held.items()}
            for q, lists, y in zip(probes["c"].to_numpy().tolist(), probes["lists"], matrix(probes["v"])):
                read = np.zeros(len(c), dtype=bool)
                for s in lists:
                    if int(s) in members:
                        read[members[int(s)]] = True
                some = np.flatnonzero(read & (c != q))
                rough = x[some] @ y
                if len(some) > k:
                    some = some[rough >= np.partition(rough, -k)[-k] - 1e-9 * (1 + reach**2)]
                exact = (x[some] * y).sum(1)
                best = np.lexsort((c[some], -exact))[:k]
                out.append(pd.DataFrame({"query_id": q, "vec_id": c[some][best], "score": exact[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    found = tiles(sent, ["shard"], 32_768, 4_096).groupBy("shard", "i", "j").applyInPandas(scan, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, vec_id)"))
    return best.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
