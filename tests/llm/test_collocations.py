"""Collocations against plain counts of all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from sourcelore.llm import collocations as c

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SHAPE = "doc_id long, text string, lang string, n long, word string, phrase int"
NAMES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def direct(docs, least, longest, within, top):
    f, sizes = {}, Counter()
    for lang, text in docs:
        own = f.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            words = tuple(re.findall("[^\x20\x09]+", piece))
            sizes[lang or "und"] += len(words)
            own.update(words[i : i + k] for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    out = []
    for lang, own in f.items():
        kept = {p: a for p, a in own.items() if a >= least and len(p) > 1}
        found = []
        for p, a in kept.items():
            if any(len(q) > len(p) and 100 * b >= within * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in kept.items()):
                continue
            score, k = min((10**6 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, sizes[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def corpus(seed, n, words=18):
    draw = random.Random(seed)
    known = [f"w{i}" for i in range(words)] + ["Été", "ñ", "a\xa0b", "\x1c"]
    weights = [1 / (i + 1) for i in range(len(known))]
    joins = [" "] * 12 + [", ", ". ", "\n", "\t", "  ", "\x0b", "\r\n", ";"]
    text = lambda: "".join(w + draw.choice(joins) for w in draw.choices(known, weights, k=draw.randrange(40)))
    return [(draw.choice(["en", "de", None, "und", "a\tb"]), text()) for _ in range(n)]


def found(spark, docs, **how):
    rows = spark.createDataFrame([(i, t, lang, 7, "w", 1) for i, (lang, t) in enumerate(docs)], SHAPE).repartition(3)
    return sorted(tuple(r[x] for x in NAMES) for r in c.collocations(rows, **how).collect())


@pytest.mark.parametrize(("shards", "block"), [(1, 1 << 20), (2, 600), (4, 150)])
def test_equals_plain_counts(spark, shards, block):
    docs = corpus(shards, 160)
    want = direct(docs, 3, 3, 50, 40)
    assert found(spark, docs, min_count=3, top=40, shards=shards, block_bytes=block) == want and len(want) > 40


def test_longer_phrases_and_other_bounds(spark):
    docs = corpus(9, 150, 6)
    assert found(spark, docs, min_count=4, max_words=4, within_percent=30, top=1000, shards=2, block_bytes=500) == direct(docs, 4, 4, 30, 1000)
    assert found(spark, docs, min_count=4, max_words=2, top=1000, block_bytes=500) == direct(docs, 4, 2, 50, 1000)


def test_odd_rows(spark):
    docs = [(None, None), ("en", ""), ("en", "..."), ("en", "one two one two one two"), ("en", "one two one two one two"), ("en", "x" * 9000 + " y"), ("de", "a a a a a a. a"), (None, "only words here")]
    assert found(spark, docs, min_count=2, block_bytes=64) == direct(docs, 2, 3, 50, 2000)
    assert found(spark, docs, min_count=100) == [] and found(spark, [], min_count=1) == []


def test_products_beyond_64_bits(spark):
    shape = "n long, prefixes array<long>, suffixes array<long>, words array<string>"
    a, left, right = 3 * 10**12, 5 * 10**12, 7 * 10**12
    row = spark.createDataFrame([(a, [left, a], [right, a], ["x", "y"])], shape)
    cut = row.selectExpr(f"array_min({c._CUTS}) AS cut").first().cut
    assert (cut.score, cut.k) == (10**6 * a * a // (left * right), 1)


def test_segments_end_with_pieces():
    text = b"one two, three four. five\nsix " * 30 + b"y" * 500 + b"; end"
    for most in (1, 10, 64, 10_000):
        parts = list(c.segments(text, most))
        assert b"".join(parts) == text and all(p[:1] in b",.\n;" for p in parts[1:])


def test_each_phrase_is_counted_once_in_a_cycle():
    """A phrase that becomes active at any step is counted by the block at one visit of the next cycle, and no other."""
    codes = np.array([0, 1, 2, 1, 2, 0, 2, 1, 2, 0])
    for since in range(9):
        known = [tuple(np.array(x) for x in ([1, 2], [0, 0], [10, 20], [0, since])), tuple(np.zeros(0, np.int64) for _ in range(4))]
        for shards in (1, 2, 3, 5):
            for shard in range(shards):
                visits = [step for step in range(shard, 40, shards) if step > since]
                sent = [c.scan(codes, known, step, shards)[0] for step in visits]
                assert [list(zip(*map(list, s))) for s in sent] == [[(10, 20, 3), (20, 10, 2)]] + [[]] * (len(visits) - 1)
