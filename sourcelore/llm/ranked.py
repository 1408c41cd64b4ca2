"""Ranked word search by a document FP-tree with branch and bound.

One pass over the texts keeps of each document the terms that the items ask for, with their occurrences, and the number of
all its terms. Every task then builds trees over its documents, some thousand at a time: terms are ordered by the
number of documents that hold them, most frequent first, so documents share the paths of their frequent terms. A node
knows, of the documents below, the most occurrences of each of their terms, the least length measure m and the least id. As a
term's score grows with its occurrences and falls with m, this bounds the score of each of them.

A tree is walked depth first. An item goes down into a node only where the bound can bring a document among its best so
far, and a document is scored only by items that reach it. The best so far are kept from tree to tree of a task.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sourcelore.llm.common import dropped, stored, whole_text

#: What stands for a missing id: after all others.
NO_ID = (1 << 63) - 1

#: Bytes of terms: letters and digits, and all beyond ASCII. A-Z become a-z; what stands between terms becomes a space.
_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms(text: bytes, piece: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time."""
    at = 0
    while at < len(text):
        end = at + piece
        if end < len(text):  # not within a term
            text_end = len(text)
            while end < text_end and _TERM_BYTES[text[end]] != 0x20:
                end += 1
        yield text[at:end].translate(_TERM_BYTES).split()
        at = end


class Items:
    """A block of items as arrays: for each term, the items that ask for it and how often."""

    def __init__(self, rows: list[tuple[int | None, dict[bytes, int]]], k: int) -> None:
        self.ids, self.k = [i for i, _ in rows], k
        self.codes = {t: c for c, t in enumerate(sorted({t for _, own in rows for t in own}))}
        asked = sorted((self.codes[t], i, n) for i, (_, own) in enumerate(rows) for t, n in own.items())
        self.item = np.array([a[1] for a in asked], np.int64)
        self.times = np.array([a[2] for a in asked], np.int64)
        self.starts = np.searchsorted(np.array([a[0] for a in asked], np.int64), np.arange(len(self.codes) + 1))

    def askers(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of ``codes``, all places in ``item`` and ``times``; and the place in ``codes`` that each belongs to."""
        n = self.starts[codes + 1] - self.starts[codes]
        own = np.repeat(np.arange(len(codes)), n)
        return np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.starts[codes], n), own


class Best:
    """Each item's ``k`` best documents so far, higher scores first, then smaller ids."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.heaps = k, [[] for _ in range(items)]
        #: The worst of each item's best; a document enters if it is better. No document with a score of 0 does.
        self.score, self.id = np.zeros(items, np.int64), np.full(items, -(1 << 63), np.int64)

    def open(self, score: np.ndarray, least_id: np.ndarray | int, items: np.ndarray) -> np.ndarray:
        """Whether documents of at most that score, and at least that id, can enter."""
        return (score > self.score[items]) | ((score == self.score[items]) & (least_id < self.id[items]))

    def add(self, item: int, score: int, doc: int) -> None:
        heap = self.heaps[item]
        if len(heap) < self.k:
            heapq.heappush(heap, (score, -doc))
        elif (score, -doc) > heap[0]:
            heapq.heapreplace(heap, (score, -doc))
        if len(heap) == self.k:
            self.score[item], self.id[item] = heap[0][0], -heap[0][1]


class Node:
    """A node of the tree: the documents ``lo`` to ``hi`` in the order of their paths, and what bounds their scores."""

    __slots__ = ("children", "codes", "hi", "least_id", "least_m", "lo", "most")


class Tree:
    """Documents as paths of their terms, frequent ones first. Chains without a branch are one edge, and ``leaf`` documents
    or fewer aren't branched further. ``order``: each term's place by frequency."""

    def __init__(self, docs: list[tuple[int, int, np.ndarray, np.ndarray]], order: np.ndarray, leaf: int = 16) -> None:
        paths = []
        for d, (_, _, codes, _) in enumerate(docs):
            place = np.argsort(order[codes])
            paths.append((order[codes][place].astype(">u4").tobytes(), d, place))
        paths.sort(key=lambda p: p[0])
        self.paths = [np.frombuffer(p[0], ">u4") for p in paths]
        self.ids = np.array([docs[d][0] for _, d, _ in paths], np.int64)
        self.m = np.array([docs[d][1] for _, d, _ in paths], np.int64)
        self.codes = [docs[d][2][place] for _, d, place in paths]
        self.tf = [docs[d][3][place] for _, d, place in paths]
        self.leaf = leaf
        self.root = self.build()

    def build(self) -> Node:
        """Top down by branches (a stack, as paths may be long), then bounds from below."""
        top = Node()
        top.lo, top.hi, top.children = 0, len(self.paths), []
        made, todo = [top], [top]
        while todo:
            node = todo.pop()
            if node.hi - node.lo <= self.leaf:
                continue
            first, last = self.paths[node.lo], self.paths[node.hi - 1]  # in order, so what these share all share
            n = min(len(first), len(last))
            differ = np.flatnonzero(first[:n] != last[:n])
            depth = int(differ[0]) if len(differ) else n
            at = node.lo
            while at < node.hi:
                end = self._branch(at, node.hi, depth)
                child = Node()
                child.lo, child.hi, child.children = at, end, []
                node.children.append(child)
                made.append(child)
                at = end
            if len(node.children) == 1:  # copies of one path
                made.pop()
                node.children = []
            else:
                todo += node.children
        for node in reversed(made):
            if node.children:
                codes, most = [c.codes for c in node.children], [c.most for c in node.children]
            else:
                codes, most = self.codes[node.lo : node.hi], self.tf[node.lo : node.hi]
            codes, most = np.concatenate(codes), np.concatenate(most)
            by = np.argsort(codes, kind="stable")
            codes, most = codes[by], most[by]
            first = np.flatnonzero(np.diff(codes, prepend=-1))
            node.codes, node.most = codes[first], np.maximum.reduceat(most, first) if len(first) else most
            node.least_m, node.least_id = int(self.m[node.lo : node.hi].min()), int(self.ids[node.lo : node.hi].min())
        return top

    def _branch(self, lo: int, hi: int, depth: int) -> int:
        """Where the paths end that have the same term as ``lo`` at ``depth``."""
        own = self.paths[lo][depth] if depth < len(self.paths[lo]) else -1
        step, end = 1, lo + 1
        same = lambda i: (self.paths[i][depth] if depth < len(self.paths[i]) else -1) == own
        while end < hi and same(end):  # in growing steps, then back by halves
            lo, end, step = end, min(hi, end + step), step * 2
        if end == lo + 1 or lo == end:
            return end
        while end - lo > 1:
            middle = (lo + end) // 2
            lo, end = (middle, end) if same(middle) else (lo, middle)
        return end


def part(tf: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    """A term's part of a score, before its weight. Grows with tf, falls with m."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Search:
    """Branch and bound over the trees of a task."""

    def __init__(self, items: Items, weight: np.ndarray) -> None:
        self.items, self.weight = items, weight
        self.best = Best(len(items.ids), items.k)
        self.documents = self.scored = 0  # pairs of documents and items, in all and scored

    def bounds(self, node: Node) -> np.ndarray:
        """For every item, what no document below can exceed."""
        at, own = self.items.askers(node.codes)
        most = self.weight[node.codes] * part(node.most, node.least_m)
        return np.bincount(self.items.item[at], weights=most[own] * self.items.times[at], minlength=len(self.items.ids)).astype(np.int64)

    def walk(self, tree: Tree) -> None:
        self.documents += len(tree.ids) * len(self.items.ids)
        todo = [(tree.root, np.arange(len(self.items.ids)), None)]
        while todo:
            node, items, bound = todo.pop()
            bound = self.bounds(node) if bound is None else bound
            items = items[self.best.open(bound[items], node.least_id, items)]  # anew: the best may have risen since
            if not len(items):
                continue
            if not node.children:
                self.score(tree, node, items)
                continue
            # all that may still enter, the most promising branch on top of the stack
            known = [(c, self.bounds(c)) for c in node.children]
            known.sort(key=lambda c: int(c[1][items].max()))
            todo += [(c, items, b) for c, b in known]

    def score(self, tree: Tree, node: Node, items: np.ndarray) -> None:
        """The documents of a leaf, for the items that reach it."""
        sizes = [len(c) for c in tree.codes[node.lo : node.hi]]
        codes, tf = np.concatenate(tree.codes[node.lo : node.hi]), np.concatenate(tree.tf[node.lo : node.hi])
        doc = np.repeat(np.arange(node.hi - node.lo), sizes)
        value = self.weight[codes] * part(tf, tree.m[node.lo : node.hi][doc])
        at, own = self.items.askers(codes)
        place = np.full(len(self.items.ids), -1)
        place[items] = np.arange(len(items))
        reach = place[self.items.item[at]]
        at, own, reach = at[reach >= 0], own[reach >= 0], reach[reach >= 0]
        n = node.hi - node.lo
        score = np.bincount(doc[own] * len(items) + reach, weights=value[own] * self.items.times[at], minlength=n * len(items)).astype(np.int64).reshape(n, len(items))
        self.scored += n * len(items)
        ids = tree.ids[node.lo : node.hi]
        docs, those = np.nonzero(self.best.open(score, ids[:, None], items[None, :]))
        for d, i in zip(docs.tolist(), those.tolist()):
            self.best.add(int(items[i]), int(score[d, i]), int(ids[d]))


def _items(items: DataFrame, k: int, most_terms: int, id_col: str, text_col: str) -> Iterator[Items]:
    """Items in blocks of about ``most_terms`` terms; rows of one id are one item. A block is what a task holds of the items."""
    texts = items.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("body"))
    size = texts.agg(F.sum(F.octet_length("body").cast("long"))).first()[0] or 0
    blocks = max(1, -(-size // (4 * most_terms)))
    texts = stored(texts.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))), "items") if blocks > 1 else texts.withColumn("block", F.lit(0))
    for block in range(blocks):
        own: dict[int | None, Counter] = {}
        for row in texts.where(F.col("block") == block).select("id", "body").toLocalIterator():
            own.setdefault(row["id"], Counter()).update(t for some in terms(row["body"].encode()) for t in some)
        rows = sorted(((i, dict(c)) for i, c in own.items() if c), key=lambda r: (r[0] is None, r[0] or 0))
        if rows:
            yield Items(rows, k)


def search(docs: DataFrame, items: DataFrame, k: int = 20, shard: int = 4096, shard_bytes: int = 16 << 20, most_terms: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(item_col, rank, id_col, score)``: the ``k`` documents of highest score for each item, all if fewer score above 0.

    Terms are the longest runs of letters, digits and characters beyond ASCII, with A-Z lower-cased. N counts the documents
    with a term, L all terms, n a document's terms, df the documents that hold a term. A term's weight is
    floor(1000 ln((2N + 2) / (2 df + 1))); m is 75 + 25 n N div L; the score sums weight * (10^9 tf div (1000 tf + 12 m)) over the
    item's terms with repeats. Equal scores are ordered by id, null last; the result is exact.

    Null and empty texts have no terms, on both sides; items without terms get no rows. Rows that repeat an item's id are one
    item of all their terms; documents that repeat an id are ranked each for itself. An empty table on either side gives an
    empty result; other columns are ignored. Very long texts are cut into terms a piece at a time; a task holds the
    vectors of at most ``shard`` documents or ``shard_bytes``. Items go in blocks of about ``most_terms`` terms, each a
    pass over the documents: that is the size of what is broadcast, and what a task keeps is k documents an item of it.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("body")).where("body is not null")
    found = None
    for block in _items(items, k, most_terms, item_col, item_text_col):
        own = _block(texts, block, shard, shard_bytes)
        found = own if found is None else found.union(own)
    if found is None:
        found = spark.createDataFrame([], "item long, doc long, score long")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")


def _block(texts: DataFrame, items: Items, shard: int, shard_bytes: int) -> DataFrame:
    """Each task's best documents for a block of items."""
    context = texts.sparkSession.sparkContext
    sent = context.broadcast(items)

    def restrict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = sent.value.codes
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("body")):
                n, counts = 0, Counter()
                for some in terms(text.as_buffer().to_pybytes()):
                    n += len(some)
                    counts.update(some)
                if n:
                    own = sorted((codes[t], counts[t]) for t in counts.keys() & codes.keys())
                    rows.append((doc, n, [c for c, _ in own], [f for _, f in own]))
            columns = zip(*rows) if rows else [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc", "n", "codes", "tf"])

    vectors = stored(texts.mapInArrow(restrict, "doc long, n long, codes array<int>, tf array<long>"), "vectors")
    total = vectors.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = np.zeros(len(items.codes), np.int64)
    for row in vectors.select(F.explode("codes").alias("code")).groupBy("code").count().toLocalIterator():  # a row a term of the block
        df[row["code"]] = row["count"]
    n_docs, n_terms = total["docs"], total["terms"]
    weight = np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * df + 1))).astype(np.int64)
    order = np.empty(len(df), np.int64)
    order[np.lexsort((np.arange(len(df)), -df))] = np.arange(len(df))
    known = context.broadcast((weight, order))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, order = known.value
        searching = Search(sent.value, weight)
        waiting, held = [], 0
        for batch in batches:
            lists = [batch.column(name) for name in ("codes", "tf")]
            flat = [x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists]
            ends = np.cumsum(np.diff(lists[0].offsets.to_numpy()))
            ids = batch.column("doc").fill_null(NO_ID).to_numpy()
            m = 75 + (25 * batch.column("n").to_numpy() * n_docs) // n_terms
            for i, (s, e) in enumerate(zip(np.concatenate(([0], ends[:-1])).tolist(), ends.tolist())):
                if e > s:
                    waiting.append((int(ids[i]), int(m[i]), flat[0][s:e], flat[1][s:e]))
                    held += 16 * (e - s)
                if len(waiting) >= shard or held >= shard_bytes:
                    searching.walk(Tree(waiting, order))
                    waiting, held = [], 0
        if waiting:
            searching.walk(Tree(waiting, order))
        rows = [(sent.value.ids[i], None if doc == -NO_ID else -doc, score) for i, heap in enumerate(searching.best.heaps) for score, doc in heap]
        columns = zip(*rows) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "doc", "score"])

    return vectors.select("doc", "n", "codes", "tf").mapInArrow(best, "item long, doc long, score long")
