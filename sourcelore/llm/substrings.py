"""Removal of long repeated byte strings, by suffix arrays over shards.

Every string of ``length`` bytes is filed under the smallest hash of the short grams in it, so that equal strings meet
under one key. Neighbouring strings with the same key make a context: a stretch of text that travels as one. Equal
contexts are one class with a count; their strings are all repeated. Contexts that differ are compared where they share
a key: a shard joins the contexts of some keys, sorts their suffixes by induced sorting, and reads from the permuted
common prefixes which strings start elsewhere too. Only keys under which
contexts differ, or whose gram comes again within a text, come this far. A key with more contexts than a shard holds is
split by longer grams: by all but a few bytes that the strings of a run of starts share, and where even that isn't
enough by whole strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sourcelore.llm.common import dropped, stored, whole_text
from sourcelore.llm.suffixes import permuted_prefixes, suffix_array

#: UTF-8 never holds this byte: it ends a context.
STOP = 0xFF
#: A context is cut after so many starts, so that no row grows with a monotonous text.
MOST_STARTS = 4_096


@cache
def _mixers() -> tuple[np.ndarray, int, int]:
    rng = np.random.default_rng(17)
    base = int(rng.integers(1 << 40, 1 << 62)) | 1
    return rng.integers(0, 1 << 63, 256, dtype=np.uint64), base, pow(base, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def gram_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each gram of k bytes; equal grams have equal hashes wherever they stand."""
    table, base, inverse = _mixers()
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(table[b] * _powers(base, len(b)), out=sums[1:])
    h = (sums[k:] - sums[:-k]) * _powers(inverse, len(b) - k + 1)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def window_minimum(h: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w neighbours."""
    n = len(h)
    pad = np.full(-n % w, np.iinfo(np.uint64).max, np.uint64)
    rows = np.concatenate((h, pad)).reshape(-1, w)
    forward = np.minimum.accumulate(rows, axis=1).ravel()
    backward = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - w + 1], forward[w - 1 : n])


def contexts(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, first start and number of starts of each context of a text, and whether its key's gram comes more than once
    in the text: else no string of the context can start in it again."""
    if len(text) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = max(1, length // 4)
    w = length - k + 1
    h = gram_hashes(np.frombuffer(text, np.uint8), k)
    keys = window_minimum(h, w)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    size = np.diff(np.append(first, len(keys)))
    # a gram is the smallest of some window if its hash is the largest key of the windows that hold it
    edge = np.zeros(w - 1, np.uint64)
    chosen = np.sort(h[~window_minimum(~np.concatenate((edge, keys, edge)), w) == h])
    again = np.unique(chosen[1:][chosen[1:] == chosen[:-1]])
    if size.max() > MOST_STARTS:
        parts = -(-size // MOST_STARTS)
        at = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, size = np.repeat(first, parts) + at * MOST_STARTS, np.minimum(np.repeat(size, parts) - at * MOST_STARTS, MOST_STARTS)
    return keys[first], first, size, np.isin(keys[first], again).astype(np.int64)


def repeated_starts(texts: list[bytes], sizes: np.ndarray, length: int) -> list[np.ndarray]:
    """For each context, which of its starts begin a string that starts at another place of these contexts too."""
    stop = bytes([STOP])
    t = np.frombuffer(stop.join(texts) + stop, np.uint8)
    at = np.cumsum([0] + [len(x) + 1 for x in texts[:-1]])
    own = np.zeros(len(t) + 1, np.int32)
    np.add.at(own, at, 1)
    np.add.at(own, at + sizes, -1)
    own = np.cumsum(own[:-1]) > 0
    prefix, before = permuted_prefixes(t, suffix_array(t))
    found = own & (prefix >= length) & (before >= 0)
    found[found] = own[before[found]]
    hit = np.zeros(len(t), bool)
    hit[found] = True
    hit[before[found]] = True
    return [hit[a : a + s] for a, s in zip(at.tolist(), sizes.tolist())]


def runs(hit: np.ndarray) -> tuple[list[int], list[int]]:
    """First and last of each run of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return edge[::2].tolist(), (edge[1::2] - 1).tolist()


def spans(first: np.ndarray, last: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The maximal stretches covered by strings of ``length`` that start from first to last."""
    order = np.argsort(first, kind="stable")
    out: list[list[int]] = []
    for a, b in zip(first[order].tolist(), (last[order] + length).tolist()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def pieces(text: bytes, key: int, size: int, length: int, width: int) -> Iterator[tuple[bytes, int, int]]:
    """``(core, a, b)``: the starts of a context in runs, each with the bytes that all strings of its run share.

    A string's place is how far its first gram of hash ``key`` lies behind its start: equal strings have equal places.
    A run's places have the same quotient by ``width``, so its strings share ``length - width + 1`` bytes at least, which
    are the same bytes of any equal string's run. With width 1 they are the string.
    """
    k = max(1, length // 4)
    grams = np.flatnonzero(gram_hashes(np.frombuffer(text, np.uint8), k).view(np.int64) == key)
    start = np.arange(size)
    gram = grams[np.searchsorted(grams, start)]
    part = (gram - start) // width
    first = np.flatnonzero(np.concatenate(([True], (gram[1:] != gram[:-1]) | (part[1:] != part[:-1]))))
    last = np.append(first[1:], size) - 1
    for a, b, g, part_ in zip(first.tolist(), last.tolist(), gram[first].tolist(), part[first].tolist()):
        at = g - width * part_
        yield text[at : at + length - width + 1] + part_.to_bytes(4, "little"), a, b


def _digests(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, values)), "<i8").reshape(-1, 2)


def _split(length: int, width: int):
    """Contexts to their pieces, each with 128 bits of its core and of all its bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, w1, w2, at, size, text in zip(batch["key"], batch["w1"], batch["w2"], batch["at"], batch["size"], batch["context"]):
                cores, a, b = map(list, zip(*pieces(text, key, size, length, width)))
                core, own = _digests(cores), _digests([text[x : y + length] for x, y in zip(a, b)])
                yield pd.DataFrame({"s1": core[:, 0], "s2": core[:, 1], "d1": own[:, 0], "d2": own[:, 1], "key": key, "w1": w1, "w2": w2, "a": np.array(a) + at, "b": np.array(b) + at})

    return run


_PIECES = "s1 long, s2 long, d1 long, d2 long, key long, w1 long, w2 long, a long, b long"


def merged(found: DataFrame) -> DataFrame:
    """``found(w1, w2, a, b)`` with the runs of a context joined where they overlap or touch."""
    own = Window.partitionBy("w1", "w2")
    before = F.max("b").over(own.orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("new", F.when(F.col("a") <= before + 1, 0).otherwise(1)).withColumn("run", F.sum("new").over(own.orderBy("a", "b").rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("w1", "w2", "run").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("run")


def find_repeats(docs: DataFrame, length: int = 400, shard_bytes: int = 1 << 19, text_col: str = "text") -> DataFrame:
    """``(t1, t2, first, last)``: for each distinct text (128 bits of XXH64) the starts of strings that start elsewhere too."""
    bodies = docs.select(whole_text(text_col).alias("body")).where(F.octet_length("body") >= length).select(F.xxhash64("body").alias("t1"), F.xxhash64(F.lit(1), "body").alias("t2"), F.col("body").cast("binary").alias("body"))
    # copies of a text are one row with a count; they are summed up before they meet
    texts = stored(bodies.groupBy("t1", "t2").agg(F.first("body").alias("body"), F.count("*").alias("n")), "texts")

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2, copies = (batch.column(i).to_pylist() for i in (0, 1, 3))
            out: list[list] = [[] for _ in names]
            for i, value in enumerate(batch.column(2)):
                text = value.as_py()
                keys, first, size, again = contexts(text, length)
                n = len(keys)
                digest = _digests([text[a : a + s + length - 1] for a, s in zip(first.tolist(), size.tolist())])
                for column, values in zip(out, (keys.view(np.int64), digest[:, 0], digest[:, 1], np.full(n, t1[i]), np.full(n, t2[i]), first, size, again, np.full(n, copies[i]))):
                    column.append(values)
                if sum(map(len, out[0])) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names)
                    out = [[] for _ in names]
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names)

    names = ["key", "w1", "w2", "t1", "t2", "first", "size", "again", "n"]
    filed = stored(texts.mapInArrow(file, ", ".join(f"{c} long" for c in names)), "contexts")
    classes = stored(filed.groupBy("key", "w1", "w2", "size").agg(F.sum("n").alias("n"), F.max("again").alias("again"), F.min(F.struct("t1", "t2", "first")).alias("at")), "classes")
    copies = classes.where("n > 1").select("w1", "w2", F.lit(0).cast("long").alias("a"), (F.col("size") - 1).alias("b"))
    # what is counted by key is written before it is joined by key: so both sides are plain shuffles, which Spark can split
    keys = stored(classes.groupBy("key").agg(F.count("*").alias("k"), F.max("again").alias("any")).where("k > 1 or any > 0").select("key", "k"), "keys")
    wanted = classes.join(keys, "key").groupBy("at.t1", "at.t2").agg(F.collect_list(F.struct("key", "w1", "w2", "size", F.col("at.first").alias("first"), "k")).alias("wanted"))
    cut = texts.join(wanted, ["t1", "t2"]).select("body", F.inline("wanted")).select("key", "w1", "w2", "size", "k", F.substring("body", F.col("first").cast("int") + 1, F.col("size").cast("int") + length - 1).alias("context"))
    cut = stored(cut.withColumn("at", F.lit(0).cast("long")), "mixed")
    dropped(keys, texts)

    # a shard takes so many contexts of one key; keys with more are split by what longer stretches their strings share
    most = max(2, shard_bytes // (2 * length))
    found, sorted_, width = [copies], [], max(2, length // 12)
    while True:
        sorted_.append(cut.where(F.col("k") <= most).select("key", "w1", "w2", "at", "size", "context"))
        many = cut.where(F.col("k") > most)
        if many.isEmpty():
            break
        split = stored(many.mapInPandas(_split(length, width), _PIECES), "pieces")
        again = stored(split.groupBy("s1", "s2", "d1", "d2").agg(F.count("*").alias("n"), F.min(F.struct("key", "w1", "w2", "a", "b")).alias("at")), "piece-classes")
        twice = stored(again.where("n > 1").select("s1", "s2", "d1", "d2"), "twice")
        found.append(split.join(twice, ["s1", "s2", "d1", "d2"]).select("w1", "w2", "a", "b"))
        if width == 1:
            break
        keys = stored(again.groupBy("s1", "s2").agg(F.count("*").alias("k")).where("k > 1"), "cores")
        part = again.join(keys, ["s1", "s2"]).select("s1", "s2", "k", "at.*")
        texts_ = many.select("w1", "w2", F.col("at").alias("from"), F.col("context").alias("whole"))
        cut = part.join(texts_, ["w1", "w2"]).select(
            "key", F.xxhash64("s1", "s2").alias("core"), "w1", "w2", (F.col("b") - F.col("a") + 1).alias("size"), "k", F.col("a").alias("at"),
            F.substring("whole", (F.col("a") - F.col("from")).cast("int") + 1, (F.col("b") - F.col("a")).cast("int") + length).alias("context"),
        )
        cut, width = stored(cut, "mixed-pieces"), 1
    group = lambda df: df.select("w1", "w2", "at", "size", "context", (F.col("core") if "core" in df.columns else F.xxhash64("key")).alias("group"))
    cut = reduce(DataFrame.union, map(group, sorted_))
    whole = cut.agg(F.sum(F.octet_length("context").cast("long"))).first()[0] or 0
    shards = max(1, -(-whole // shard_bytes))

    def sort(group: pd.DataFrame) -> pd.DataFrame:
        hits = repeated_starts(group["context"].tolist(), group["size"].to_numpy(np.int64), length)
        out = [(w1, w2, at + a, at + b) for w1, w2, at, hit in zip(group["w1"], group["w2"], group["at"], hits) for a, b in zip(*runs(hit))]
        return pd.DataFrame(out, columns=["w1", "w2", "a", "b"])

    found.append(cut.withColumn("shard", F.pmod("group", F.lit(shards))).groupBy("shard").applyInPandas(sort, "w1 long, w2 long, a long, b long"))
    parts = stored(merged(reduce(DataFrame.union, found)), "parts")
    return filed.select("w1", "w2", "t1", "t2", "first").join(parts, ["w1", "w2"]).select("t1", "t2", (F.col("first") + F.col("a")).alias("first"), (F.col("first") + F.col("b")).alias("last"))


def drop_repeats(docs: DataFrame, length: int = 400, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with ``kept`` (binary: the text's remaining bytes), ``byte_count``, ``bytes_removed`` and ``spans_removed``.

    Of each whole text, as UTF-8 (null: empty), every byte goes that a string of ``length`` bytes covers which also starts
    at any other place, in the same text or another; strings never cross texts and are judged on the input. Equal
    texts remove each other whole if they are long enough. Rows that repeat an id, or lack one, are texts like others.
    An empty table gives an empty result. Other columns pass through; columns of the four added names are replaced.

    Repeated texts are treated once, with their count. A very long text is filed a context at a time, a context is at
    most MOST_STARTS starts; ties between equal strings don't matter, as all of them go. Keys, contexts and strings meet
    by counts that are combined before the shuffle; a shard holds about ``shard_bytes`` of contexts.
    """
    if length < 4:
        raise ValueError("length must be at least 4")
    found = find_repeats(docs, length, text_col=text_col, **options)
    found = found.groupBy("t1", "t2").agg(F.collect_set(F.struct("first", "last")).alias("__found")).withColumnsRenamed({"t1": "__t1", "t2": "__t2"})
    found = stored(found, "spans")  # then the join below has plain shuffles, which Spark can split where many copies meet
    body = whole_text(text_col)

    @F.pandas_udf("kept binary, removed long, spans long")
    def remove(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, found in batches:
            rows = []
            for text, own in zip(texts, found):
                text = bytes(text)
                cut = spans(np.array([x["first"] for x in own]), np.array([x["last"] for x in own]), length) if own is not None and len(own) else []
                ends = [0, *(b for _, b in cut)]
                rows.append((b"".join(text[b:a] for b, a in zip(ends, [*(a for a, _ in cut), len(text)])), sum(b - a for a, b in cut), len(cut)))
            yield pd.DataFrame(rows, columns=["kept", "removed", "spans"])

    joined = docs.join(found, (F.xxhash64(body) == found["__t1"]) & (F.xxhash64(F.lit(1), body) == found["__t2"]), "left")
    out = joined.withColumn("__cut", remove(body.cast("binary"), F.col("__found")))
    return out.withColumns({"kept": F.col("__cut.kept"), "byte_count": F.octet_length(body).cast("long"), "bytes_removed": F.col("__cut.removed"), "spans_removed": F.col("__cut.spans")}).drop("__t1", "__t2", "__found", "__cut")
