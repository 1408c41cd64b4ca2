"""Repeated strings and suffix sorting against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from sourcelore.llm import substrings, suffixes

SCHEMA = "doc_id long, text string, kept int, key string, first long"


def brute(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((len(t), int(gone.sum()), len(substrings.runs(gone)[0]), bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


def check(spark, rows, length, **options):
    got = substrings.drop_repeats(spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA).repartition(3), length, **options).collect()
    want = brute([(t or "").encode() for _, t in rows], length)
    assert sorted((str(r.doc_id), r.byte_count, r.bytes_removed, r.spans_removed, bytes(r.kept)) for r in got) == sorted((str(i), *w) for (i, _), w in zip(rows, want))
    return sum(w[1] for w in want)


def made(seed, n, alphabet="abcdefgh é漢"):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 9)))
    shared = [" ".join(word() for _ in range(rng.randrange(5, 60))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rng.randrange(0, 40)))]
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            a, b = sorted(rng.sample(range(len(s) + 1), 2)) if rng.random() < 0.6 else (0, len(s))
            parts += [s[a:b], word()]
        rows.append((i, "".join(parts)))
    return rows


ODD = [(900, None), (901, ""), (902, "a" * 300), (902, "a" * 300), (903, "ab" * 5000), (904, "short"), (None, "no id " * 9)]


@pytest.mark.parametrize("length,options", [(24, {}), (40, {"shard_bytes": 3000}), (24, {"shard_bytes": 100}), (9, {"shard_bytes": 36})])
def test_removal_equals_brute_force(spark, length, options):
    assert check(spark, made(length, 120) + ODD, length, **options) > 1000


def test_documents_at_full_length(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert check(spark, rows, 400) > 0


def test_monotonous_texts_are_cut_into_contexts(spark, monkeypatch):
    check(spark, [(1, "x" * 9000), (2, "y" * 399), (3, "z" * 400), (4, "xy" * 4500 + "x" * 4500)], 400)


def test_empty_table(spark):
    assert substrings.drop_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_suffix_arrays_and_prefixes():
    rng = random.Random(4)
    for _ in range(600):
        t = [rng.randrange(rng.choice([1, 2, 4, 200])) for _ in range(rng.randrange(1, 70))] * rng.randrange(1, 3)
        x = np.array(t)
        order = suffixes.suffix_array(x)
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        prefix, before = suffixes.permuted_prefixes(x.astype(np.uint8), order)
        for p, q in enumerate(before.tolist()):
            if q >= 0:
                m = 0
                while max(p, q) + m < len(t) and t[p + m] == t[q + m]:
                    m += 1
                assert m == prefix[p]


def test_large_alphabets_take_the_scalar_scan():
    rng = np.random.default_rng(1)
    for x in (rng.integers(0, 3, 3000), rng.integers(0, 900, 3000), np.tile(rng.integers(0, 50, 400), 5), np.zeros(2000, int)):
        t = x.tolist()
        assert suffixes.suffix_array(x).tolist() == sorted(range(len(t)), key=lambda i: t[i:])
