"""Ranked search against plain scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from sourcelore.llm import ranked

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SHAPE = "doc_id long, text string, score string, item_id int, rank int"


def direct(docs, items, k):
    held = [(i, Counter(TERM.findall((t or "").translate(UPPER)))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(TERM.findall((t or "").translate(UPPER)))
    out = []
    for item, own in asked.items():
        found = []
        for doc, c in held:
            m = 75 + 25 * sum(c.values()) * n_docs // n_terms
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in own.items() if c[t])
            if score > 0:
                found.append((score, doc))
        found.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(item, r + 1, doc, score) for r, (score, doc) in enumerate(found[:k])]
    return out


def key(row):
    return tuple(-1 if v is None else v for v in row)


def found(spark, docs, items, **how):
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], SHAPE)
    items = spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, ranked.search(docs, items, **how).collect()), key=key)


def corpus(seed, n):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Élan", "ñu", "中文", "ABC"]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [(i, draw.choice([" ", ", ", "\n"]).join(draw.choices(words, weights, k=draw.randrange(0, 40)))) for i in range(n)], [(i, " ".join(draw.choices(words, k=12))) for i in range(9)]


@pytest.mark.parametrize("shard", [1, 7, 64, 4096])
def test_equals_all_scores(spark, shard):
    docs, items = corpus(shard, 300)
    assert found(spark, docs, items, k=5, shard=shard) == sorted(direct(docs, items, 5), key=key)


def test_items_in_blocks(spark):
    docs, items = corpus(3, 120)
    assert found(spark, docs, items, k=4, most_terms=8) == sorted(direct(docs, items, 4), key=key)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "... !"), (None, "alpha beta"), (4, "alpha beta"), (4, "alpha beta"), (4, "Alpha " * 5000), (-7, "alpha beta"), (5, "gamma " + "x" * 100_000)]
    items = [(1, "ALPHA beta"), (1, "beta"), (2, None), (3, ""), (None, "gamma gamma"), (5, "nowhere"), (6, "x" * 100_000)]
    for k in (1, 3, 20):
        assert found(spark, docs, items, k=k) == sorted(direct(docs, items, k), key=key)
    assert found(spark, [], items) == [] and found(spark, docs, []) == [] and found(spark, docs[:3], items) == []


def test_terms_in_pieces():
    text = "One,two  THREE\x00four-Élan x".encode() * 50
    want = [t.encode() for t in TERM.findall(text.decode().translate(UPPER))]
    for size in (1, 7, 100, 10_000):
        assert [t for some in ranked.terms(text, size) for t in some] == want


def test_bounds_hold_and_save_work():
    draw = np.random.default_rng(4)
    items = ranked.Items([(i, {b"%d" % t: 1 + int(draw.integers(2)) for t in set(draw.zipf(1.4, 8) % 200)}) for i in range(20)], 3)
    order = np.argsort(np.argsort(draw.random(len(items.codes))))
    docs = []
    for d in range(2000):
        codes = np.unique(draw.zipf(1.3, 25) % len(items.codes))
        docs.append((d, int(draw.integers(76, 200)), codes, draw.integers(1, 6, len(codes))))
    weight = draw.integers(1, 9000, len(items.codes))
    search = ranked.Search(items, weight)
    tree = ranked.Tree(docs, order)
    todo = [tree.root]
    while todo:
        node = todo.pop()
        todo += node.children
        bound = search.bounds(node)
        for d in range(node.lo, node.hi, 7):
            at, own = items.askers(tree.codes[d])
            value = weight[tree.codes[d]] * ranked.part(tree.tf[d], tree.m[d])
            assert (np.bincount(items.item[at], weights=value[own] * items.times[at], minlength=20) <= bound).all()
    search.walk(tree)
    assert search.scored < 0.6 * search.documents
