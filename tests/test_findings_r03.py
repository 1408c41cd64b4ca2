"""Cases of the findings of round 3."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sourcelore.functions import text as L
from sourcelore.operators import access as P
from sourcelore.operators import cscan as X
from sourcelore.operators import dependencies as E
from sourcelore.operators import facts as K
from sourcelore.operators import fusion as U
from sourcelore.operators import index as W
from sourcelore.operators import relations as R
from sourcelore.operators import scoring
from sourcelore.operators import search as S
from sourcelore.plans import ingest as I
from sourcelore.plans import pack as G
from sourcelore.plans import snapshots as N
from sourcelore.sources import tree as T


def joined_rows(spark, df, kind="Join"):
    """The most rows that a join (or a step of another kind) of the query puts out; of a function, those of the jobs that make the query too."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    df = df() if callable(df) else df
    df.write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    most, runs = 0, store.executionsList()
    for i in range(before, runs.size()):
        run = runs.apply(i).executionId()
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            if kind in node.name():
                for metric in (node.metrics().apply(j) for j in range(node.metrics().size())):
                    if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                        most = max(most, int(values.apply(metric.accumulatorId()).replace(",", "")))
    return most


def test_source_revoked_before_at_the_same_instant_is_not_revoked_now(spark):
    now = F.to_timestamp(F.lit("1998-08-01 00:00:00"))
    kinds = "repository_grant_id string, source_kind string, permission string, revoked string, expires_at timestamp"
    current = spark.createDataFrame([("a", "manifest", "read", "1998-08-01 00:00:00", None), ("b", "manifest", "read", None, None), ("c", "manual", "read", "1998-08-01 00:00:00", None)], kinds).withColumn("revoked_at", F.to_timestamp("revoked")).drop("revoked")
    desired = spark.createDataFrame([("a", "read", False), ("b", "read", False), ("d", "read", True)], "repository_grant_id string, permission string, active boolean")
    got = P.marked_sources(current, desired, now)
    assert {(r["repository_grant_id"], r["revoked_at"] is not None, r["revoked_now"]) for r in got.collect()} == {("a", True, False), ("b", True, True), ("c", True, False), ("d", False, False)}
    assert got.drop("revoked_now").exceptAll(P.applied_sources(current, desired, now)).isEmpty()


def test_grants_of_a_team_are_not_multiplied_by_its_members(spark):
    n = 1_000
    ids = spark.range(n)
    people = ids.selectExpr("concat('p', id) as id", "'d' as security_domain_id", "'active' as status")
    domains = spark.sql("select 'd' as id, 'active' as status")
    teams = spark.sql("select 't' as id, 'd' as security_domain_id, 'active' as status")
    members = ids.selectExpr("'t' as team_id", "concat('p', id) as principal_id")
    grants = ids.selectExpr("concat('g', id) as id", "'d' as security_domain_id", "concat('r', id % 2) as repository_id", "if(id % 10 = 0, concat('p', id), null) as principal_id", "if(id % 10 = 0, null, 't') as team_id")
    sources = ids.selectExpr("concat('g', id) as repository_grant_id", "cast(null as timestamp) as revoked_at", "cast(null as timestamp) as expires_at")
    got = P.readable(people, domains, grants, sources, teams, members, F.to_timestamp(F.lit("1998-08-01 00:00:00")))
    assert got.count() == 2 * n
    assert joined_rows(spark, got) <= 2 * n


def _common_name(spark):
    """Every directory has a header of the same name, and lines of other directories name it."""
    n = 300
    paths = spark.range(n).selectExpr("'s' as snapshot_id", "concat('d', id, '/h.h') as path")
    lines = spark.range(n).selectExpr("'s' as snapshot_id", "id as relation_id", "concat('e', id, '/x.c') as path", "if(id = 7, 'd7/h.h', 'h.h') as target", "'exact' as confidence")
    return n, paths, lines


def test_candidates_of_a_common_name_are_counted_once(spark):
    n, paths, lines = _common_name(spark)
    got = E.candidate_counts(lines.selectExpr("relation_id as reference_id", "path", "'include' as kind", "target"), paths)
    assert {tuple(r) for r in got.collect()} == {(i, 1, "d7/h.h") if i == 7 else (i, n, "d0/h.h") for i in range(n)}
    assert joined_rows(spark, got) <= 2 * n
    got = R.resolve_include(lines, paths)
    assert {(r["relation_id"], r["candidates"], r["target_path_found"]) for r in got.collect()} == {(i, 1, "d7/h.h") if i == 7 else (i, n, None) for i in range(n)}
    assert joined_rows(spark, got) <= 2 * n


def test_counts_equal_the_candidates(spark):
    paths = spark.createDataFrame([("s", p) for p in ("a/b/x.h", "b/x.h", "x.h", "include/x.h", "a/y.c", "c/y.S", "include/b/x.h", "z/Makefile", "q/z/Kbuild", "q/z/Kconfig")], "snapshot_id string, path string")
    rows = [(i, path, kind, target) for i, (path, kind, target) in enumerate((p, k, t) for p in ("a/f.c", "f.c", "b/g.c") for k in ("include", "kbuild_target") for t in ("x.h", "b/x.h", "./x.h", "../x.h", "b\\x.h", "y.o", "z/", "no.h", "", "$(x)"))]
    refs = spark.createDataFrame(rows, "reference_id int, path string, kind string, target string")
    want = {tuple(r) for r in E.candidates(refs, paths).groupBy("reference_id").agg(F.count("*"), F.min("candidate")).collect()}
    assert {tuple(r) for r in E.candidate_counts(refs, paths).collect()} == want
    assert sorted(E.candidates(refs, paths, 1).collect()) == sorted(E.candidates(refs, paths).join(E.candidate_counts(refs, paths).where("candidates = 1"), "reference_id", "left_semi").collect())
    rel = refs.selectExpr("reference_id as relation_id", "'s' as snapshot_id", "path", "target", "'e' as confidence")
    want = {tuple(r) for r in R.include_paths(rel, paths).groupBy("relation_id").agg(F.count("*"), F.min("candidate")).collect()}
    assert {(r["relation_id"], r["candidates"], r["target_path_found"]) for r in R.resolve_include(rel, paths).collect() if r["candidates"]} == {(i, c, p if c == 1 else None) for i, c, p in want}


def test_principals_meet_each_set_of_repositories_once(spark):
    n = 200
    members = spark.range(n).selectExpr("concat('sol', id) as solution_id", "explode(if(id % 2 = 0, array('a', 'b'), array('b', 'c'))) as repository", "'s' as snapshot_id", "0 as ordinal")
    readable = spark.range(n).selectExpr("concat('p', id) as principal_id", "explode(if(id % 2 = 0, array('a', 'b'), array('c'))) as repository")
    got = N.scope_counts(members, readable)
    one = N.solution_scope(members, readable).withColumn("shown", N.hidden_when_partial(F.col("solution_id"))).groupBy("principal_id", "partial_visibility").agg(F.count("*").alias("members"), F.countDistinct("shown").alias("solutions_shown"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, one.collect()))
    assert joined_rows(spark, got) <= 4 * n


def _words(spark, n=1_200):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    rows = [(f"c{i}", f"s{i % 3}", f"r{i % 3}", f"p{i // 4}", i, i + 3, " ".join(rng.choices(words, k=rng.randrange(0, 30)))) for i in range(n)]
    asked = [(f"q{q}", " ".join(rng.choices(words, k=rng.randrange(1, 40)))) for q in range(40)] + [("none", "nowhere"), ("empty", "")]
    kinds = "chunk_id string, snapshot_id string, repository string, path string, start_line int, end_line int, content string"
    return rows, asked, spark.createDataFrame(rows, kinds).repartition(5), spark.createDataFrame(asked, "query_id string, query string")


def _plain_bm25(rows, asked, top_k):
    own = {r: Counter(r[6].split()) for r in rows}
    size, df = {r: sum(c.values()) for r, c in own.items()}, Counter(w for c in own.values() for w in c)
    average, out = sum(size.values()) / len(rows), set()
    for q, text in asked:
        score = {r: round(sum(t * max(math.log((len(rows) - df[w] + 0.5) / (df[w] + 0.5)), 1e-6) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size[r] / average)) for w, t in Counter(text.split()).items() if w in c), 9) for r, c in own.items()}
        first = sorted((r for r in rows if score[r] > 0), key=lambda r: (-score[r], r[3], r[4], r[0]))[: 5 * top_k]
        seen, kept = Counter(), []
        for r in first:
            seen[r[1], r[3]] += 1
            kept += [r] if seen[r[1], r[3]] <= 2 else []
        out |= {(q, i + 1, r[0], round(score[r], 6)) for i, r in enumerate(kept[:top_k])}
    return out


def test_word_search_keeps_pairs_in_their_tasks(spark, monkeypatch, tmp_path):
    """Word search joins no more rows than there are postings of asked terms, and gives the plain rows, in blocks and slices too."""
    rows, asked, chunks, queries = _words(spark)
    want = _plain_bm25(rows, asked, 3)
    monkeypatch.setattr(W, "MOST_JOINED", 0)
    index = W.add_snapshots(chunks, str(tmp_path / "words"))
    for limits in ({}, {"MOST_ASKED": 100, "MOST_PAIRS": 50, "MOST_CELLS": 300, "MOST_HELD": 10}):
        for name, value in limits.items():
            monkeypatch.setattr(scoring, name, value)
        for got in (S.bm25(chunks, queries, 3), W.bm25(index, queries, 3)):
            assert {(r.query_id, r["rank"], r.chunk_id, round(r.score, 6)) for r in got.collect()} == want
    postings = sum(len(set(r[6].split())) for r in rows)
    assert joined_rows(spark, lambda: S.bm25(chunks, queries, 3)) <= postings
    assert joined_rows(spark, lambda: W.bm25(index, queries, 3)) <= postings


def test_a_name_meets_its_relations_once(spark):
    """However many queries ask for a name, its relations are found and ranked once."""
    n, asked = 400, 60
    rel = spark.range(n).selectExpr("concat('r', id) as id", "concat('f', id % 5) as source_file_id", "if(id % 2 = 0, 's1', 's2') as source_symbol_id", "if(id % 3 = 0, 's2', null) as target_symbol_id", "if(id % 7 = 0, 'other', 'two') as target_text", "cast(id as int) as start_line", "cast(id as int) as end_line", "if(id % 4 = 0, 'source_exact', 'source_inferred') as confidence")
    symbols = spark.createDataFrame([("s1", "one"), ("s2", "two"), ("s3", "one")], "id string, name string")
    chunks = spark.range(5).selectExpr("concat('f', id) as file_id", "explode(sequence(0, 39)) as i").selectExpr("file_id", "concat(file_id, ':', i) as chunk_id", "concat('p', file_id) as path", "'r' as repository", "'s' as snapshot_id", "i * 10 as start_line", "i * 10 + 11 as end_line")
    names = spark.range(asked).selectExpr("id as query_id", "explode(if(id % 2 = 0, array('two', 'none', 'one'), array('other', 'one'))) as name").selectExpr("query_id", "name", "if(name = 'one', 5, 1) as name_order")
    got = lambda: S.relation_hits(names, symbols, rel, chunks, 7)
    assert joined_rows(spark, got) <= 8 * n
    spans, held, by = rel.collect(), chunks.collect(), {"s1": "one", "s2": "two", "s3": "one", None: None}
    want = set()
    for q in range(asked):
        order = {"two": 1, "one": 5} if q % 2 == 0 else {"other": 1, "one": 5}
        best = {}
        for r in spans:
            for name in {by[r.source_symbol_id], by[r.target_symbol_id], r.target_text} & set(order):
                for c in held:
                    if c.file_id == r.source_file_id and c.start_line <= r.end_line and c.end_line >= r.start_line:
                        key = (order[name], r.confidence != "source_exact", c.path, r.start_line, r.id)
                        best[c.chunk_id] = min(best.get(c.chunk_id, key), key)
        want |= {(q, i + 1, c) for i, (_, c) in enumerate(sorted((k, c) for c, k in best.items())[:7])}
    assert {(r.query_id, r["rank"], r.chunk_id) for r in got().collect()} == want


def test_lines_of_the_best_files_alone_are_cut(spark, monkeypatch):
    """Two versions of a repository, equal scores, and small limits: the rows of a plain search, without a row for each query and line."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(12)]
    files = [("r", f"s{v}", f"p{i % 90}", "\n".join(" ".join(rng.choices(words, k=rng.randrange(0, 6))) for _ in range(rng.randrange(1, 30)))) for v in range(2) for i in range(90)]
    asked = [(q, " ".join(rng.choices(words, k=rng.randrange(1, 5)))) for q in range(30)]
    frame = spark.createDataFrame(files, "repository string, snapshot_id string, path string, text string").repartition(3)
    monkeypatch.setattr(scoring, "MOST_CELLS", 60)
    got = lambda: S.line_matches(frame, spark.createDataFrame(asked, "query_id int, query string"), 2)
    by = {}
    for q, text in asked:
        own = []
        for r, v, p, body in files:
            at = [(i + 1, len(set(line.split()) & set(text.split()))) for i, line in enumerate(body.split("\n"))]
            own += [(-sum(n for _, n in at), r, p, i) for i, n in at if n]
        by[q] = sorted(own)[:10]
    assert {(r.query_id, r.n, -r.score, r.repository, r.path, r.line) for r in got().collect()} == {(q, n + 1, *x) for q, rows in by.items() for n, x in enumerate(rows)}
    assert joined_rows(spark, got) < 30 * 180 / 2


def test_a_tree_is_written_as_its_own_files(spark, tmp_path):
    """No folder, checksum or rename by the driver for each file; bytes are kept, and a second write changes nothing."""
    rows = [(f"r{i % 2}", f"d{i % 3}/e/f{i}.c", bytes(range(i + 1)) + b"\n" * (i % 3)) for i in range(40)]
    files = spark.createDataFrame([*rows, ("r0", "large.c", None)], "repository string, path string, content binary")
    for _ in range(2):
        assert T.write_tree(files, str(tmp_path / "t")) == 40
        assert sorted(p.relative_to(tmp_path / "t").as_posix() for p in (tmp_path / "t").rglob("*") if p.is_file()) == sorted(f"{r}/{p}" for r, p, _ in rows)
    got = T.read_tree(spark, f"file://{tmp_path}/t", "all")
    assert {(r.path, bytes(r.content)) for r in got.collect()} == {(f"{r}/{p}", b) for r, p, b in rows}
    with pytest.raises(Exception, match="leads out of the tree"):
        T.write_tree(spark.createDataFrame([("r", "a/../../x.c", b"")], files.schema), str(tmp_path / "u"))
    assert not (tmp_path / "x.c").exists()


def test_scans_are_held_for_few_files_at_a_time(spark, monkeypatch):
    """A batch of very many files is sent in parts, all of its rows once."""
    monkeypatch.setattr(X, "MOST_HELD", 100)
    assert list(X._slices([30, 60, 20, 500, 0, 99])) == [(0, 2), (2, 3), (3, 4), (4, 6)] and list(X._slices([])) == []
    text = "static int f(int a)\n{\n\treturn g(a);\n}\n#if A\nint v;\n#endif\n"
    files = spark.range(50).selectExpr("concat('f', id) as file_id", "'c' as language", f"if(id = 7, null, repeat('{text}', cast(id % 3 as int))) as text").coalesce(1)
    got = X.scanned(files)
    plain = {r.file_id: X.scan(r.text or "") for r in files.collect()}
    assert {r.file_id: {k: [tuple(x) for x in r[k]] for k in plain[r.file_id]} for r in got.collect()} == plain
    assert X.scanned(files, ("calls",)).columns == ["file_id", "calls"]


def test_a_task_sends_its_best_products_alone(spark, monkeypatch):
    """Parts of fewer vectors than are asked for, equal products, vectors of another length and without numbers."""
    rng = random.Random(8)
    monkeypatch.setattr(U, "MOST_PRODUCTS", 16)
    rows = [(i, [float(rng.randrange(-3, 4)) for _ in range(3)]) for i in range(400)] + [(900, [1.0]), (901, None), (902, [float("nan"), 1.0, 1.0]), (903, [None, 1.0, 1.0])]
    for kind in ("long", "string"):
        name = str if kind == "string" else int
        frame = spark.createDataFrame([(name(i), v) for i, v in rows], f"chunk_id {kind}, vector array<double>").repartition(2)
        asked = [(f"q{i}", rows[i][1]) for i in range(8)] + [("one", [2.0])]
        got = lambda: U.best_products(spark.createDataFrame(asked, "query_id string, vector array<double>"), frame, 5)
        want = set()
        for q, v in asked:
            own = sorted((-sum(a * b for a, b in zip(v, x)), name(i)) for i, x in rows if x and len(x) == len(v) and None not in x and not any(map(math.isnan, x)))
            want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(own[:5])}
        assert {tuple(r) for r in got().collect()} == want
        assert joined_rows(spark, got, "MapInArrow") <= 2 * 9 * 5


def test_rows_of_chosen_names_alone_are_gathered(spark):
    """Names are chosen by their keys; relations given twice count once, and names without rows don't count."""
    rel = spark.range(4_000).selectExpr("concat('n', id % 500) as name", "'s' as snapshot_id", "concat('c', id % 1000) as citation", "'t' as target_text")
    places = spark.range(1_000).selectExpr("concat('n', id % 500) as name", "'s' as snapshot_id", "concat('p', id) as citation", "'definition' as role").where("name <> 'n4'")
    names = spark.sql("select * from values (1, 'none', 0), (1, 'n4', 1), (1, 'n3', 2), (1, 'n9', 3), (2, 'n3', 1), (2, 'n0', 9) as t(query_id, name, name_order)")
    got = lambda: G.symbol_contexts(names, places, rel, 2, 1, 2)
    shown = {(r.query_id, r["name"], len(r.occurrences or []), tuple(x.citation for x in r.relations if x), r.truncated) for r in got().collect()}
    assert {(q, n, tuple(c), t) for q, n, _, c, t in shown} == {(1, "n4", ("c4", "c504"), False), (1, "n3", ("c3", "c503"), True), (2, "n3", ("c3", "c503"), True), (2, "n0", ("c0", "c500"), True)}
    assert joined_rows(spark, got, "ObjectHashAggregate") <= 20


def shuffled_records(spark, run):
    """The records that all jobs of ``run`` wrote for shuffles."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    total, runs = 0, store.executionsList()
    for i in range(before, runs.size()):
        run = runs.apply(i).executionId()
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            for metric in (node.metrics().apply(j) for j in range(node.metrics().size())):
                if metric.name() == "shuffle records written" and values.contains(metric.accumulatorId()):
                    total += int(values.apply(metric.accumulatorId()).replace(",", ""))
    return total


def test_postings_are_made_where_their_chunks_lie(spark, tmp_path):
    """no posting is shuffled, ranges go on over batches, and the blocks are those of plain counting."""
    rng = random.Random(5)
    rows = [(f"c{i}", f"s{i % 2}", "r", f"p{i}", 1, 2, " ".join(rng.choices(["a", "B", "é", "w1", "w2", "w3"], k=rng.randrange(9)))) for i in range(500)]
    chunks = spark.createDataFrame(rows, "chunk_id string, snapshot_id string, repository string, path string, start_line int, end_line int, content string").coalesce(2)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "23")
    try:
        assert shuffled_records(spark, lambda: W.add_snapshots(chunks, str(tmp_path / "words"))) < 100
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    index = W.WordIndex(spark, str(tmp_path / "words"))
    text = {r[0]: r[6].lower().split() for r in rows}
    want = {}
    for r in index.chunks.collect():
        assert r.tokens == text[r.chunk_id]
        for term, tf in Counter(r.tokens).items():
            want.setdefault((term, r.no // W.RANGE), []).append((r.no, tf, r.size))
    got = {(r.term, r.range): r for r in index.postings.collect()}
    assert len(got) == index.postings.count() and got.keys() == want.keys()
    for key, own in want.items():
        r, (nos, tfs, sizes) = got[key], zip(*sorted(own))
        assert (tuple(r.nos), tuple(r.tfs), tuple(r.sizes)) == (nos, tfs, sizes)
        assert (r.n, r.times, r.most_tf, r.least_size) == (len(nos), sum(tfs), max(tfs), min(sizes))


def test_lines_are_those_of_python_and_their_ends_are_few_tests(spark):
    """ten line ends in a class were ten nested tests for each character."""
    rng = random.Random(1)
    ends = ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", " ", " "]
    texts = ["".join(rng.choices([*ends, *["a", "b ", "é", "\x1f", "\x1b", "\t", "‧", "‪", "\x84", "𝄞"] * 3], k=rng.randrange(60))) for _ in range(300)]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", L.lines("text").alias("lines")).collect()
    assert [r.lines for r in got] == [r.text.splitlines(keepends=True) for r in got]
    assert "x0b" not in L.LINE


def test_what_lines_say_is_found_once(spark):
    """conditions, symbols, targets and counters read the stored relations, and don't look for them in the texts again."""
    made = "int a(void);\x0b\r\n#include \"b.h\"\n#ifdef X\nint f(int a)\n{\n\treturn a(1);\n}\n#endif\x85"
    kconfig = "config A\n\tdepends on B1\n\tselect C1 if D\n"
    tree = spark.createDataFrame([("r", "a.c", made), ("r", "b.h", "int b;\n"), ("r", "Kconfig", kconfig), ("r", "Makefile", "obj-$(CONFIG_A) += a.o\n")], "repository string, path string, text string").selectExpr("repository", "path", "cast(text as binary) as content")
    rows = I.ingested(tree, "r1")
    for kind in ("relation", "source_condition", "symbol_occurrence"):
        assert "regexp_extract_all" not in rows[kind]._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.kind, r.target_text, r.start_line, r.condition_id is not None) for r in rows["relation"].collect()}
    assert got == {("includes", "b.h", 3, False), ("calls", "a", 7, True), ("depends_on_config", "B1", 2, False), ("selects_config", "C1", 3, True), ("kbuild_contains", "a.o", 1, True)}
    assert {(r.expression, r.start_line) for r in rows["source_condition"].collect()} == {("defined(X)", 5), ("D", 3), ("CONFIG_A", 1)}
    files = spark.createDataFrame([("f", "c", made)], "file_id string, language string, text string")
    assert [r.line for r in K.numbered(files).orderBy("line_number").collect()] == made.splitlines()
