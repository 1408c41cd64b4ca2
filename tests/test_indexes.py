"""The stored word index, the automaton of fixed strings, and products of vectors, against plain searches."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sourcelore import adapters as A
from sourcelore.operators import automaton
from sourcelore.operators import fusion as U
from sourcelore.operators import index as W
from sourcelore.operators import search as S
from sourcelore.queries import packs

CHUNK = "chunk_id string, snapshot_id string, repository string, path string, start_line int, end_line int, content string"


def corpus(spark, n, seed=1, snapshots=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = [(f"c{i}", f"s{i % snapshots}", f"r{i % snapshots}", f"p{i // 4}", i, i + 3, " ".join(rng.choices(words, weights, k=rng.randrange(0, 40)))) for i in range(n)]
    asked = [(q, " ".join(rng.choices(words, k=8) + rng.choices(words, weights, k=4))) for q in range(12)] + [(90, "nowhere"), (91, "W1 w1 w2")]
    return spark.createDataFrame(rows, CHUNK), spark.createDataFrame(asked, "query_id int, query string")


def hits(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in df.collect())


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    chunks, asked = corpus(spark, 900)
    path = str(tmp_path_factory.mktemp("index") / "words")
    W.add_snapshots(chunks.where("snapshot_id = 's1'"), path)
    return chunks, asked, W.add_snapshots(chunks, path)


@pytest.mark.parametrize("top_k", [1, 3, 10])
def test_index_gives_the_rows_of_a_search_without_it(spark, built, top_k):
    chunks, asked, index = built
    assert hits(W.bm25(index, asked, top_k)) == hits(S.bm25(chunks, asked, top_k))
    assert hits(W.term_frequency(index, asked, top_k)) == hits(S.term_frequency(chunks, asked, top_k))
    scope = spark.createDataFrame([("s1",), ("s2",)], "snapshot_id string")
    assert hits(W.bm25(index, asked, top_k, scope)) == hits(S.bm25(chunks, asked, top_k, scope))


def test_snapshots_are_added_once_and_failed_batches_do_not_count(spark, built, tmp_path):
    chunks, asked, index = built
    again = W.add_snapshots(chunks, index.path)
    assert again.postings.count() == index.postings.count() and again.totals.agg(F.sum("chunks")).first()[0] == 900
    path = str(tmp_path / "words")
    W.add_snapshots(chunks.where("snapshot_id = 's0'"), path)
    for part in ("chunks", "postings"):  # a batch whose totals were never written
        (tmp_path / "words" / part / "batch=0").rename(tmp_path / "words" / part / "batch=7")
    assert W.WordIndex(spark, path).postings.isEmpty()
    empty = W.WordIndex(spark, str(tmp_path / "none"))
    assert W.bm25(empty, asked).collect() == [] and W.term_frequency(empty, asked).collect() == []


def test_a_search_for_few_terms_opens_their_folders_and_row_groups(spark, built):
    index = built[2]
    blocks = index.asked(spark.createDataFrame([("w3",), ("w150",)], "term string"))
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [w150,w3])" in plan and "bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    every, some = len(index.postings.inputFiles()), {r.f for r in blocks.select(F.input_file_name().alias("f")).distinct().collect()}
    assert 0 < len(some) < every / 3
    assert {r.term for r in blocks.collect()} == {"w3", "w150"}


def test_no_text_is_cut_and_no_array_is_read_for_bounds(built):
    _, asked, index = built
    plan = W.bm25(index, asked)._jdf.queryExecution().toString()
    assert "content" not in plan and "regexp" not in plan
    heads = index.postings.select("term", "n", "most_tf", "least_size")._jdf.queryExecution().executedPlan().toString()
    assert "tfs" not in heads.split("ReadSchema")[1]


def test_bounds_save_postings(spark, tmp_path):
    """Where rare words tell chunks apart, as in names, most postings of the common ones are never joined."""
    rng = random.Random(2)
    common = [f"the{i}" for i in range(12)]
    rows = [(f"c{i}", "s", "r", f"p{i}", 1, 2, " ".join(rng.choices(common, k=30) + [f"name{i % 700}"] * 3)) for i in range(4000)]
    asked = spark.createDataFrame([(q, " ".join([*common, f"name{q}", f"name{q + 50}", f"name{q + 99}"])) for q in range(20)], "query_id int, query string")
    index = W.add_snapshots(spark.createDataFrame(rows, CHUNK), str(tmp_path / "words"))
    work = {r.step: r.postings for r in W.Bounded(index, asked, 5).work().collect()}
    assert work["rare"] + work["needed"] + work["tried"] + work["rest"] < 0.3 * work["all"]
    assert hits(W.bm25(index, asked, 1)) == hits(S.bm25(spark.createDataFrame(rows, CHUNK), asked, 1))


def test_ablation_of_a_hundred_candidates(spark, sf_dir):
    """EVL4 against plain Python: vectors, ranks, fusion and range metrics."""
    def vector(text):
        v = np.zeros(64, np.float32)
        for w in text.lower().split():
            v[zlib.crc32(w.encode()) % 64] += 1 if zlib.crc32(w.encode()) & 0x10000 else -1
        return v / (np.sqrt((v.astype(float) ** 2).sum()) or 1)

    found, asked = defaultdict(list), {r.query_id: r.query for r in A.queries(spark, sf_dir).collect()}
    for r in packs.hits(spark, sf_dir, 100).collect():
        found[r.query_id].append(r)
    marks = defaultdict(set)
    for r in packs.annotations(spark, sf_dir).collect():
        marks[r.question_id].add((r.path, r.start_line, r.end_line))
    assert max(map(len, found.values())) > 10 and marks
    first = defaultdict(dict)
    for q, rows in found.items():
        v = vector(U.QUERY_PREFIX + asked[q])
        score = {r.chunk_id: float(np.dot(v.astype(np.float32).astype(float), vector(r.content).astype(np.float32).astype(float))) for r in rows}
        by = sorted(rows, key=lambda r: (-round(score[r.chunk_id], 9), r.repository, r.path, r.start_line, r.chunk_id))
        place = {r.chunk_id: i + 1 for i, r in enumerate(by)}
        both = sorted(rows, key=lambda r: (-(1 / (60 + r["rank"]) + 0.5 / (60 + place[r.chunk_id])), r["rank"]))
        for name, order, k in (("candidates", sorted(rows, key=lambda r: r["rank"]), 10), ("vectors", by, 10), ("fused", both, 10), ("ceiling", sorted(rows, key=lambda r: r["rank"]), 100)):
            for m in marks[q]:
                ranks = [i + 1 for i, r in enumerate(order[:k]) if r.path == m[0] and r.start_line <= m[2] and m[1] <= r.end_line]
                first[name][q, m] = min(ranks, default=None)
    total = sum(map(len, marks.values()))
    for r in packs.evl4_ablation(spark, sf_dir).collect():
        got = first[r.retriever]
        rr = [1 / min((got[q, m] for m in ms if got.get((q, m))), default=np.inf) for q, ms in marks.items() if ms]
        assert (r.ranges_total, r.ranges_found) == (total, sum(v is not None for v in got.values()))
        assert r.range_mrr == pytest.approx(sum(rr) / len(rr), abs=1e-9)


def test_automaton_finds_what_a_plain_search_finds():
    rng = random.Random(5)
    for trial in range(60):
        letters = "ab" if trial % 2 else "abcdé "
        strings = sorted({"".join(rng.choices(letters, k=rng.randrange(1, 7))) for _ in range(rng.randrange(1, 30))})
        texts = ["".join(rng.choices(letters, k=rng.choice([0, 1, 5, 30, 2000 if trial < 6 else 60]))) for _ in range(20)]
        data = b"".join(t.encode() for t in texts)
        ends = np.cumsum([len(t.encode()) for t in texts])
        found = automaton.Automaton([s.encode() for s in strings]).find(np.frombuffer(data, np.uint8), ends - [len(t.encode()) for t in texts], ends)
        assert sorted(zip(*map(list, found))) == [(i, j) for i, t in enumerate(texts) for j, s in enumerate(strings) if s in t]


def plain_fixed(files, queries, top_k, per_file, most):
    distinct, at, over = {t for _, ts in queries for t in ts}, defaultdict(dict), set()
    for t in distinct:
        n = 0
        for path, text in sorted(files):
            own = [i + 1 for i, line in enumerate(text.split("\n")) if t in line][:per_file]
            over |= {t} if n + len(own) > most else set()
            if own[: most - n]:
                at[t][path] = own[: most - n]
            n += len(own[: most - n])
    out = []
    for q, ts in queries:
        paths = Counter(p for t in set(ts) for p in at[t])
        rows = sorted((-(100 * k + min(50, sum(len(at[t].get(p, [])) for t in set(ts)))), p) for p, k in paths.items())[:top_k]
        for r, (score, p) in enumerate(rows):
            places = sorted((line, t) for t in set(ts) for line in at[t].get(p, []))
            out.append((q, r + 1, p, -score, len(places), len(over & set(ts)), places[:8]))
    return sorted(out)


@pytest.mark.parametrize(("per_file", "most"), [(20, 2000), (2, 9), (1, 1)])
def test_fixed_strings_of_every_length(spark, monkeypatch, per_file, most):
    monkeypatch.setattr(automaton, "BLOCK_BYTES", 40)  # several automata
    rng = random.Random(most)
    files = [(f"p{rng.randrange(10**6)}", "\n".join("".join(rng.choices("abc é", k=rng.randrange(25))) for _ in range(rng.randrange(1, 9)))) for _ in range(40)]
    queries = [(q, ["".join(rng.choices("abc é", k=rng.randrange(1, 5))) for _ in range(4)]) for q in range(12)]
    frame = spark.createDataFrame(files, "path string, text string").repartition(3)
    got = S.fixed_strings(frame, spark.createDataFrame(queries, "query_id int, query_terms array<string>"), 5, per_file, most)
    assert sorted((r.query_id, r["rank"], r.path, r.score, r.hit_count, r.truncated_terms, [tuple(h) for h in r.hits]) for r in got.collect()) == plain_fixed(files, queries, 5, per_file, most)
    assert S.fixed_strings(frame, spark.createDataFrame([(1, [""])], "query_id int, query_terms array<string>")).collect() == []


def test_products_equal_plain_ones(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)) * rng.choice([1e-3, 1, 1e3], size=(300, 1))
    x[7], x[8], x[9] = x[3], x[3] * (1 + 1e-9), 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0, 2.0]), (902, [None] * 8)]
    vectors = spark.createDataFrame(rows, "chunk_id long, vector array<double>").repartition(3)
    asked = spark.createDataFrame([(f"q{i}", x[i].tolist()) for i in (3, 9, 50, 51)] + [("none", None), ("two", [3.0, 4.0])], "query_id string, vector array<double>")
    got = {(r.query_id, r.chunk_id): r for r in U.distances(asked, vectors, 2).collect() if r.chunk_id < 900}
    assert len(got) == 4 * 300
    for (q, c), r in got.items():
        a, b = x[int(q[1:])], x[c]
        assert r.inner_product == pytest.approx(-(a @ b), rel=1e-9, abs=1e-12) and r.l2 == pytest.approx(np.sqrt(((a - b) ** 2).sum()), rel=1e-6, abs=1e-15)
        assert r.cosine is None if not a.any() or not b.any() else r.cosine == pytest.approx(1 - a @ b / np.sqrt((a @ a) * (b @ b)), abs=1e-9)
    best = U.best_products(asked, vectors, 5, 2).collect()
    for i in (3, 9, 50, 51):
        want = sorted((-round(float(x[i] @ v), 12), c) for c, v in enumerate(x))[:5]
        assert [(r["rank"], r.chunk_id) for r in sorted((r for r in best if r.query_id == f"q{i}"), key=lambda r: r["rank"])] == [(n + 1, c) for n, (_, c) in enumerate(want)]
    assert [(r.query_id, r.chunk_id, r.score) for r in best if r.query_id in ("two", "none")] == [("two", 901, 11.0)]
