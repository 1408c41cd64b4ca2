"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most ``2 * half`` bits exactly if some word lies within ``half`` bits of both. So every
distinct fingerprint emits all words ("variants") within ``half`` bits, and fingerprints that meet at a variant are
linked. With 64 bits and half = 2 that is 2,081 variants each. To keep the shuffle small, variants are dealt out by a
prefix of well-balanced bit positions, and a fingerprint travels once to each prefix that its ball touches (1 + b +
b(b-1)/2 of 2^b prefixes); the part of its ball under that prefix is laid out on the other side of the shuffle, in
bounded slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelore.llm.common import components, local_components, stored, whole_text

SEED = 42
BITS = 64


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """Bit i is 1 if it is set in over half of the XXH64 values of the word shingles; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    width = min(shingle, len(words))
    hash64 = xxhash.xxh64_intdigest
    hashes = np.array([hash64(flat[s:e], SEED) for s, e in zip(starts.tolist(), ends[width - 1 :].tolist())], dtype=np.uint64)
    tally = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 16384):
        bits = np.unpackbits(hashes[at : at + 16384].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        tally += bits.sum(axis=0, dtype=np.int32)
    return sum(1 << int(i) for i in np.flatnonzero(2 * tally > len(hashes)))


def fingerprint_column(text: Column, shingle: int = 4) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = np.array([fingerprint((t or "").encode(), shingle) for t in texts], dtype=np.uint64)
            yield pd.Series(found.view(np.int64))

    return run(text)


def _slices(word: np.ndarray, left: np.ndarray, source: np.ndarray, free: list[int], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The variants and their sources, in slices of about ``most``: where there are more, by the value of one more bit."""
    k = len(free)
    counts = np.array([1, 1 + k, 1 + k + k * (k - 1) // 2])
    if len(word) > 1 and counts[left].sum() > most and k > 2:
        bit, rest = free[0], free[1:]
        for value in (0, 1):
            flip = ((word >> np.uint64(bit)) & np.uint64(1)) != value
            keep = ~flip | (left > 0)
            yield from _slices(np.where(flip, word ^ np.uint64(1 << bit), word)[keep], (left - flip)[keep], source[keep], rest, most)
        return
    ones = [1 << i for i in free]
    masks = [np.array([0], np.uint64), np.array(ones, np.uint64), np.array([x | y for x, y in combinations(ones, 2)], np.uint64)]
    words, sources = [], []
    for r in range(3):
        own = left == r
        if own.any():
            mask = np.concatenate(masks[: r + 1])
            words.append((word[own][:, None] ^ mask[None, :]).ravel())
            sources.append(np.repeat(source[own], len(mask)))
    if words:
        yield np.concatenate(words), np.concatenate(sources)


def meet(word: np.ndarray, left: np.ndarray, free: list[int], fingerprints: np.ndarray, radius: int, most: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Links (as indexes) that span all groups of fingerprints meeting at a variant: a forest, not all pairs."""
    label = np.arange(len(word))
    for variant, source in _slices(word, left, np.arange(len(word)), free, most):
        order = np.argsort(variant, kind="stable")
        variant, source = variant[order], source[order]
        same = variant[1:] == variant[:-1]
        if same.any():
            a, b = source[:-1][same], source[1:][same]
            near = np.bitwise_count(fingerprints[a] ^ fingerprints[b]) <= radius
            pair = np.unique(np.minimum(a, b)[near] * len(word) + np.maximum(a, b)[near])
            a, b = np.concatenate([pair // len(word), np.arange(len(word))]), np.concatenate([pair % len(word), label])
            label = local_components(len(word), a, b)
    other = np.flatnonzero(label != np.arange(len(word)))
    return other, label[other]


def links(prints: DataFrame, radius: int = 4, per_bucket: int = 1000) -> DataFrame:
    """Links ``(a, b)`` between the distinct fingerprints of ``prints(fp long)``: every pair within ``radius`` bits is
    connected through them. ``radius`` is even and at most 4."""
    if radius not in (2, 4):
        raise ValueError("radius must be 2 or 4")
    half = radius // 2
    seen = prints.agg(F.count("*").alias("n"), *[F.sum(F.shiftrightunsigned("fp", i).bitwiseAND(F.lit(1))).alias(f"b{i}") for i in range(BITS)]).first()
    n = seen["n"]
    width = min(30, max(3, int(np.ceil(np.log2(max(1, n / per_bucket))))))
    chosen = sorted(range(BITS), key=lambda i: (abs(2 * (seen[f"b{i}"] or 0) - n), i))[:width]
    masks = [sum(1 << i for i in c) for r in range(half + 1) for c in combinations(range(width), r)]
    own = F.lit(0).cast("long")
    for at, bit in enumerate(chosen):
        own = own.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", bit).bitwiseAND(F.lit(1).cast("long")), at))
    sent = prints.select("fp", own.alias("own"), F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask")).select("fp", F.col("own").bitwiseXOR(F.col("mask")).alias("bucket"), "mask")
    free = [i for i in range(BITS) if i not in chosen]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        fp = rows["fp"].to_numpy().view(np.uint64)
        mask = rows["mask"].to_numpy().astype(np.uint64)
        word = fp.copy()
        for at, bit in enumerate(chosen):
            word ^= ((mask >> np.uint64(at)) & np.uint64(1)) << np.uint64(bit)
        a, b = meet(word, half - np.bitwise_count(mask).astype(np.int64), free, fp, radius)
        return pd.DataFrame({"a": fp[a].view(np.int64), "b": fp[b].view(np.int64)})

    return sent.groupBy("bucket").applyInPandas(run, "a long, b long")


def _grouped(docs: DataFrame, radius: int, shingle: int, id_col: str, text_col: str, **keys: Column) -> DataFrame:
    """``(id, fp, *keys, component_id, root)`` for every row of ``docs``; ``root`` is a fingerprint, one for each component."""
    id_type = docs.schema[id_col].dataType
    own = stored(docs.select(F.col(id_col).cast(id_type).alias("id"), fingerprint_column(whole_text(text_col), shingle).alias("fp"), *[c.alias(name) for name, c in keys.items()]), "fingerprints")
    classes = stored(own.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    roots = components(links(classes.select("fp"), radius))
    placed = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return own.join(placed.join(least, "root").select("fp", "component_id", "root"), "fp")


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, fp long, component_id)`` for every row of ``docs``.

    Null texts count as empty; texts without words get fingerprint 0 and link like any other. Texts of fewer words than
    a shingle are one shingle. Rows with equal fingerprints are one class, so copies cost no pairs. ``component_id`` is
    the smallest id reachable by links (null only if all ids there are null). Repeated rows each come out. An empty
    table gives an empty result; columns other than the two named are ignored.
    """
    return _grouped(docs, radius, shingle, id_col, text_col).select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates: of the rows with the smallest id the one with the least
    fingerprint, then text hash; in a group without ids by these alone. Rows are found again by 128 bits of XXH64 over
    text and id, so rows that share an id, or have none, each stay or go by their own text."""
    body, id_ = whole_text(text_col), F.col(id_col)
    keys = {"__h1": F.xxhash64(body, id_.isNull(), id_), "__h2": F.xxhash64(F.lit(1), body, id_.isNull(), id_)}
    found = _grouped(docs, radius, shingle, id_col, text_col, **keys)
    kept = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp", *keys)).alias("one")).select(*[F.col(f"one.{k}").alias(k) for k in keys])
    return docs.withColumns(keys).join(kept, list(keys), "left_semi").dropDuplicates(list(keys)).drop(*keys)
