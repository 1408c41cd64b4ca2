"""Cases of the findings of round 4."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from sourcelore.operators import search as S
from sourcelore.plans import pack as G
from sourcelore.queries import base, code
from test_findings_r03 import joined_rows


def test_an_empty_text_has_no_first_line(spark, tmp_path):
    texts = ["", "\n", "one", "one\ntwo\n", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["line_count"], r["first_length"]) for r in base.prj3_lines(spark, str(tmp_path)).collect()}
    assert got == {0: (0, None), 1: (1, 1), 2: (1, 3), 3: (2, 4), 4: (None, None)}


def _searched(spark, names, symbols, relations, chunks, top_k):
    return S.relation_hits(
        spark.createDataFrame(names, "query_id long, name string, name_order long"), spark.createDataFrame(symbols, "id string, name string"),
        spark.createDataFrame(relations, "id string, source_file_id string, source_symbol_id string, target_symbol_id string, target_text string, start_line int, end_line int, confidence string"),
        spark.createDataFrame(chunks, "chunk_id string, file_id string, path string, repository string, snapshot_id string, start_line int, end_line int"), top_k,
    )


@pytest.mark.parametrize("rounds,most,top_k", [((1, 16), 64, 3), ((1, 2), 1, 12), ((2,), 2, 7)])
def test_relations_looked_up_by_rounds_are_those_of_all_names(spark, monkeypatch, rounds, most, top_k):
    monkeypatch.setattr(S, "FIRST_NAMES", rounds)
    monkeypatch.setattr(S, "MOST_RELATIONS", most)
    rng = random.Random(len(rounds) + most)
    chunks = [(f"c{f}-{n}", f"f{f}", f"p{f % 3}", "r", "s", 10 * n, 10 * n + 11) for f in range(5) for n in range(4)]
    symbols = [(f"y{n}", f"n{n % 7}") for n in range(9)]
    relations = [(f"i{n:03}", f"f{rng.randrange(6)}", *[rng.choice([None, *[y for y, _ in symbols]]) for _ in "st"], f"n{rng.randrange(12)}", at, at + rng.randrange(3), rng.choice(["source_exact", "x"])) for n in range(60) for at in [rng.randrange(45)]]
    names = [(q, f"n{rng.randrange(12)}", n // 2) for q in range(12) for n in range(rng.randrange(1, 7))]
    want = {}
    for q in {q for q, _, _ in names}:
        hits = {}
        for rid, file, source, target, text, start, end, confidence in relations:
            told = {n for y, n in symbols if y in (source, target)} | {text}
            order = [o for p, n, o in names if p == q and n in told]
            for chunk, of, path, _, _, first, last in chunks:
                if order and of == file and first <= end and start <= last:
                    hits.setdefault(chunk, []).append((min(order), confidence != "source_exact", path, start, rid, chunk))
        want |= {(q, n): first[-1] for n, first in enumerate(sorted(min(h) for h in hits.values())[:top_k], 1)}
    got = _searched(spark, names, symbols, relations, chunks, top_k).collect()
    assert len(got) == len(want)
    assert {(r["query_id"], r["rank"]): r["chunk_id"] for r in got} == want


def test_names_after_those_that_have_all_chunks_are_not_looked_up(spark):
    chunks = [(f"c{n}", "f", "p", "r", "s", 10 * n, 10 * n + 9) for n in range(300)]
    relations = [(f"i{n}", "f", None, None, "few" if n < 30 else "many", 10 * (n % 300), 10 * (n % 300), "x") for n in range(6_000)]
    names = [(1, "few", 0), (1, "many", 1)]
    assert joined_rows(spark, lambda: _searched(spark, names, [], relations, chunks, 3)) < 1_000


def test_a_name_of_many_relations_is_cut_before_it_meets_chunks(spark):
    chunks = [(f"c{f}-{n}", f"f{f}", f"p{f:03}", "r", "s", 10 * n, 10 * n + 9) for f in range(50) for n in range(20)]
    relations = [(f"i{f}-{n}", f"f{f}", None, None, "many", 2 * n, 2 * n, "x") for f in range(50) for n in range(100)]
    kept = spark.createDataFrame([("many",)], "name string")
    spoken = spark.createDataFrame(relations, "id string, source_file_id string, source_symbol_id string, target_symbol_id string, target_text string, start_line int, end_line int, confidence string")
    own = spark.createDataFrame(chunks, "chunk_id string, file_id string, path string, repository string, snapshot_id string, start_line int, end_line int")
    found = S._relations_of(kept, spark.createDataFrame([], "id string, name string"), spoken, own, 2)
    assert [r["chunk_id"] for r in found.orderBy("path", "start_line").collect()] == ["c0-0", "c0-1"]


@pytest.mark.parametrize("most_line", [7, 60])
def test_relations_of_calls_are_each_once(spark, sf_dir, tmp_path, most_line):
    """Also where two parts' lines may be the same line of a file, and where parts are repeated."""
    for t in ("part", "lineitem"):
        rows = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        if most_line > 7 and t == "lineitem":
            rows = rows.withColumn("l_linenumber", F.when(F.col("l_orderkey") % 3 == 0, F.lit(1) + F.pmod(F.hash("l_orderkey"), F.lit(most_line))).otherwise(F.col("l_linenumber")))
        if most_line > 7 and t == "part":
            rows = rows.union(rows.where("p_partkey % 5 = 0"))
        rows.write.parquet(f"{tmp_path}/{t}.parquet")
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = sorted(con.execute(code.ORACLES["jon7_relations"]).fetchall(), key=str)
    assert sorted((tuple(r) for r in code.jon7_relations(spark, str(tmp_path)).collect()), key=str) == want


def test_calls_are_not_shuffled_by_their_ids(spark, sf_dir):
    assert "hashpartitioning(id#" not in code.resolved(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_a_name_of_many_relations_sends_its_first_only(spark):
    kinds = "name string, snapshot_id string, citation string, {} string"
    names = spark.createDataFrame([(1, "many", 1)], "query_id long, name string, name_order int")
    told = spark.createDataFrame([("many", "s", f"c{n % 3000:04}", f"t{n % 3}") for n in range(6_000)] + [("many", "s", "c0000", None)], kinds.format("target_text"))
    spoken = spark.createDataFrame([("many", "s", "c", "definition")], kinds.format("role"))
    found = lambda: G.symbol_contexts(names, spoken, told, 5, 4, 3)
    assert [(r["n"], r["citation"], r["target_text"]) for r in found().first()["relations"]] == [(1, "c0000", None), (2, "c0000", "t0"), (3, "c0001", "t1")]
    assert found().first()["truncated"]
    assert joined_rows(spark, found, "Aggregate") < 1_000
