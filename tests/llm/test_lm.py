"""Language-model scores against a direct model on small tables."""

import math
import re
import zlib
from collections import Counter

import pytest

from sourcelore.llm import lm
from sourcelore.llm.common import id_crc_mod

SCHEMA = "doc_id long, text string, n int, block int, word string"


def tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower) + ["\n"]


def direct(rows, min_word, min_pair, discount=0.75):
    learn = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2 for i, _ in rows]
    c, pairs = Counter(), Counter()
    for (_, text), train in zip(rows, learn):
        if train:
            c.update(tokens(text))
    starts = c["\n"]
    state = lambda w: w == "" or c[w] >= min_word
    for (_, text), train in zip(rows, learn):
        if train:
            own = tokens(text)
            pairs.update((h, w) for h, w in zip([""] + own, own) if state(h) and state(w))
    kept = {p: k for p, k in pairs.items() if k >= min_pair}
    n, v = sum(c.values()), len(c)
    n1, n2 = sum(k == 1 for k in c.values()), sum(k == 2 for k in c.values())
    taken = min(0.9, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5
    used = Counter()
    for (h, _), k in kept.items():
        used[h] += k - discount
    context = lambda h: starts if h == "" else c[h]

    def prob(h, w):
        p = (c[w] - taken) / n if c[w] else (taken * v / n if n else 1.0)
        if not state(h) or not context(h):
            return p
        p *= 1 - used[h] / context(h)
        return p + (kept[h, w] - discount) / context(h) if (h, w) in kept else p

    for h in ["", *list(c)[:20]]:
        if n and h != "\n":
            assert sum(prob(h, w) for w in [*c, "never seen"]) == pytest.approx(1)
    out = []
    for (i, text), train in zip(rows, learn):
        own = tokens(text)
        out.append((str(i), train, len(own), sum(c[w] > 0 for w in own), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own), sum(math.log10(prob(h, w)) for h, w in zip([""] + own, own))))
    return sorted(out)


def check(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], SCHEMA)
    got = sorted((str(r[0]), *r[1:]) for r in lm.score(docs, id_crc_mod("doc_id", 7) != 2, **options).collect())
    want = direct(rows, options.get("min_word", 10), options.get("min_pair", 3))
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)
    return got


def test_scores_equal_a_direct_model(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows += [(1000, None), (1001, ""), (1002, " \n "), (1003, "The the THE É é\x1cx\x85y\xa0z"), (1004, "the of " * 20_000), (1004, "the of"), (None, "the")]
    got = check(spark, rows, least_blocks=5)
    held = [g for g in got if not g[1]]
    assert sum(g[6] for g in held) > sum(g[5] for g in held)


@pytest.mark.parametrize("rows", [[(2, "a b a b")], [(i, "a b c") for i in range(1, 9)], [(3, None)]])
def test_small_tables(spark, rows):
    check(spark, rows, min_word=1, min_pair=1, least_blocks=2)


def test_empty_table(spark):
    assert lm.score(spark.createDataFrame([], SCHEMA), id_crc_mod("doc_id", 7) != 2).count() == 0


def test_states_need_no_share_of_all_tokens(spark):
    rows = [(i, "the of " * 120_000 + "rare pair " * 11 * (i == 0)) for i in [0, 2, 3, 4, 5, 7, 8, 9, 10, 12, 14]]
    got = check(spark, rows)
    assert all(g[1] for g in got) and 5e-6 * got[0][4] > 11
