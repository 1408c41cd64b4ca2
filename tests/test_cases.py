"""Small cases with exact expectations: chunks, facts, paths, retrieval, evaluation, access, snapshots."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sourcelore.functions import text as X
from sourcelore.operators import access as P
from sourcelore.operators import automaton
from sourcelore.operators import chunks as C
from sourcelore.operators import cscan
from sourcelore.operators import dependencies as E
from sourcelore.operators import facts as K
from sourcelore.operators import fusion as U
from sourcelore.operators import relations as R
from sourcelore.operators import search as S
from sourcelore.plans import evaluate as V
from sourcelore.plans import pack as G
from sourcelore.plans import snapshots as N
from sourcelore.sources import tree as T

SOURCE = '''/* Starts the pump. */
static int start_pump(void)
{
	return primed() + begin_idle();
}

#define PUMP_MAX 3
typedef struct pump { int a; } pump_t;
#ifdef CONFIG_PUMP
int stop_pump(void) { return ops->fallback(); }
#else
static int primed(void) { return 1; }
#endif
#include "../include/pump.h"
'''


def test_c_chunks_by_item():
    found = {c[3]: (c[0], c[1]) for c in cscan.scan(SOURCE)["chunks"]}
    assert found == {"start_pump": ("function", 1), "PUMP_MAX": ("macro", 7), "pump_t": ("type", 8), "stop_pump": ("function", 10), "primed": ("function", 12)}
    assert cscan.scan("int f( { ]")["errors"] == [(1,)] and cscan.scan("")["chunks"] == []


def test_c_facts():
    found = cscan.scan(SOURCE)
    scopes = {(o[0], o[2]): o[5] for o in found["occurrences"]}
    assert scopes["primed", "definition"] == "file" and scopes["stop_pump", "definition"] == "repository"
    calls = {c[1]: (c[0], c[3]) for c in found["calls"]}
    assert calls == {"primed": ("start_pump", "source_inferred"), "begin_idle": ("start_pump", "source_inferred"), "fallback": ("stop_pump", "ambiguous_candidate")}
    assert [c[:3] for c in found["conditions"]] == [("defined(CONFIG_PUMP)", 10, 10), ("!((defined(CONFIG_PUMP)))", 12, 12)]


def test_branches_take_what_others_leave():
    text = "#if A\nx\n#elif B\n#  ifndef C\ny\n#else\nz\n#endif\n#else\nw\n#endif\n#endif\n#ifx\n# define if\n#ifdef OPEN\nv"
    assert cscan.conditions(text) == [
        ("A", 2, 2, 1), ("!((A)) && (B)", 4, 8, 1), ("(!((A)) && (B)) && (!defined(C))", 5, 5, 2), ("(!((A)) && (B)) && (!((!defined(C))))", 7, 7, 2),
        ("!((A) || (B))", 10, 10, 1), ("defined(OPEN)", 16, 16, 1),
    ]
    assert cscan.conditions("#if\n1\n#elif\n2\n#else") == [("1", 2, 2, 1), ("!((1)) && (1)", 4, 4, 1)] and cscan.conditions("") == []


def test_declarations_within_functions():
    text = "int run(int a)\n{\n\tstruct item *it, *more;\n\ttypedef int number;\n\tint other(int x);\n\tif (a) { size_t inner = 1; use(inner); }\nout:\n\tcase 1: call(it); return a;\n\tstruct point p = { .x = 1 };\n}\nint top;\n"
    found = {(o[0], o[1], o[3], o[5]) for o in cscan.scan(text)["occurrences"]}
    assert found == {
        ("run", "function", 1, "repository"), ("it", "variable", 3, "function:run"), ("number", "type", 4, "function:run"), ("other", "function", 5, "repository"),
        ("inner", "variable", 6, "function:run"), ("p", "variable", 9, "function:run"), ("top", "variable", 11, "repository"),
    }


def test_lines_of_build_files(spark):
    files = spark.createDataFrame([("b", "kbuild", "obj-m = a.o\nlib-y := b.o\n# obj-y += c.o\nobj-$(CONFIG_X)+= d/ $(e)\nx-y-objs += f.o\nccflags += g.o\n"), ("k", "kconfig", "select A\nmenuconfig B # x\n imply C_1\n select d\n rsource \"x/Kconfig\"\n source y\n depends on D || !E=n\n"), ("c", "c", " # include <a/b.h> // x\n#include b.h\n#includes \"c.h\"\n")], "file_id string, language string, text string")
    got = {(r.kind, r.source_name, r.target_text, r.condition, r.start_line) for r in K.line_relations(files).collect()}
    assert got == {("kbuild_contains", "obj", "a.o", None, 1), ("kbuild_contains", "obj", "d/", "CONFIG_X", 4), ("implys_config", "B", "C_1", None, 3), ("includes_config", None, "x/Kconfig", None, 5), ("includes", None, "a/b.h", None, 1)}
    assert {(r.file_id, r.target) for r in K.references(files).collect()} == {("b", "a.o"), ("b", "b.o"), ("b", "d/"), ("b", "f.o"), ("b", "g.o"), ("k", "x/Kconfig"), ("c", "a/b.h")}


def test_deep_nesting():
    deep = "#if A\n" * 1100 + "int far_inside(void) { return 0; }\n" + "#endif\n" * 1100
    found = cscan.scan(deep)
    assert [c[3] for c in found["chunks"]] == ["far_inside"] and [o[0] for o in found["occurrences"]] == ["far_inside"] and len(found["conditions"]) == 1100


def test_build_chunks_by_language(spark):
    files = spark.createDataFrame([("a", "c", SOURCE), ("b", "text", "one\ntwo\nthree\nfour"), ("c", "c", "// nothing\n"), ("d", "text", "")], "file_id string, language string, text string")
    rows = cscan.build_chunks(files, 3, 1).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.file_id, r.ordinal)):
        by.setdefault(r.file_id, []).append((r.parse_status, r.kind, r.start_line, r.end_line))
    assert [x[1] for x in by["a"]] == ["function", "macro", "type", "function_part", "function"] or [x[1] for x in by["a"]].count("function") >= 2
    assert by["b"] == [("not_applicable", "line_window", 1, 3), ("not_applicable", "line_window", 3, 4)]
    assert by["c"] == [("fallback", "line_window", 1, 1)] and "d" not in by


def test_windows_reject_a_full_overlap(spark):
    with pytest.raises(ValueError):
        C.windows(F.array(), 3, 3)


def test_kconfig_and_kbuild(spark):
    files = spark.createDataFrame([("k", "kconfig", "config PUMP\n\tdepends on NET && X86\n\tselect PRIMED if EXPERT\n"), ("b", "kbuild", "obj-$(CONFIG_PUMP) += pump.o primed.o\n")], "file_id string, language string, text string")
    got = {(r.kind, r.source_name, r.target_text, r.condition) for r in K.line_relations(files).collect()}
    assert got == {("depends_on_config", "PUMP", "NET", None), ("depends_on_config", "PUMP", "X86", None), ("selects_config", "PUMP", "PRIMED", "EXPERT"), ("kbuild_contains", "obj", "pump.o", "CONFIG_PUMP"), ("kbuild_contains", "obj", "primed.o", "CONFIG_PUMP")}


@pytest.mark.parametrize("path,target,known,want", [
    ("kernel/pump.c", "../include/pump.h", ["include/pump.h", "arch/x86/include/pump.h"], ["include/pump.h"]),
    ("drivers/net/foo.c", "linux/foo.h", ["drivers/net/foo.c", "include/linux/foo.h", "arch/x86/include/linux/foo.h"], ["arch/x86/include/linux/foo.h", "include/linux/foo.h"]),
    ("a/b.c", "$(x).h", ["$(x).h"], []),
])
def test_include_candidates(spark, path, target, known, want):
    rel = spark.createDataFrame([(1, "s", path, target)], "relation_id long, snapshot_id string, path string, target string")
    paths = spark.createDataFrame([("s", p) for p in known], "snapshot_id string, path string")
    assert sorted(r.candidate for r in R.include_paths(rel, paths).collect()) == want


def test_dependency_candidates_and_expansion(spark):
    paths = spark.createDataFrame([(p,) for p in ("k/a.c", "k/a.h", "include/a.h", "x/Makefile", "k/z.h", "lib/z.h", "lib/w.h")], "path string")
    refs = [("k/a.c", "include", "a.h", 1, 0), ("k/a.c", "include", "w.h", 2, 0), ("k/a.c", "include", "gone.h", 3, 0), ("k/a.h", "include", "z.h", 1, 0), ("k/b", "kbuild_target", "a.o", 1, 0), ("k/b", "kbuild_target", "../x/", 1, 1)]
    table = spark.createDataFrame(refs, "path string, kind string, target string, line_number int, place int")
    named = table.withColumn("reference_id", F.concat_ws("|", "path", "target"))
    got = {}
    for r in E.candidates(named, paths).collect():
        got.setdefault(r.reference_id, set()).add(r.candidate)
    assert got == {"k/a.c|a.h": {"k/a.h", "include/a.h"}, "k/a.c|w.h": {"lib/w.h"}, "k/a.h|z.h": {"k/z.h"}, "k/b|a.o": {"k/a.c"}, "k/b|../x/": {"x/Makefile"}}
    seeds = spark.createDataFrame([("k/a.c",)], "path string")
    chosen, counts = E.expand(seeds, table, paths, 2, 10)
    assert {(r.path, r.level) for r in chosen.collect()} == {("k/a.c", 0), ("k/a.h", 1), ("include/a.h", 1), ("lib/w.h", 1), ("k/z.h", 2)}
    assert counts == {"seed_files": 1, "dependency_files": 4, "unresolved": 1, "ambiguous": 1, "truncated": False}
    chosen, counts = E.expand(seeds, table, paths, 2, 1)
    assert counts["dependency_files"] == 1 and counts["truncated"] and counts["unresolved"] == 0
    with pytest.raises(ValueError):
        E.expand(seeds, table, paths, -1, 1)


def test_texts(spark):
    rows = spark.createDataFrame([("a\r\nb\x0bc d\x85e",), ("",), ("same same " + " ".join(f"symbol_{i}" for i in range(30)) + " 9x é",)], "t string")
    got = rows.select(F.size(X.lines("t")).alias("n"), X.identifiers("t").alias("names"), X.normalized_path(F.lit("a/../../b/./c")).alias("p")).collect()
    assert [r.n for r in got] == [5, 0, 1] and len(got[2].names) == 16 and got[2].names[0] == "same" and got[0].p == "../b/c"


def test_scan_filters(spark):
    rows = [("r", "a/x.c", b"int x;\n"), ("r", "a/y.bin", b"z"), ("r", "a/n.c", b"a\0b"), ("r", "b/Makefile", b"x"), ("r", "b/big.md", b"x" * 100), ("r", "a/x.c", b"int x;\n"), ("r", "c/bad.txt", b"\xff\n")]
    files = spark.createDataFrame(rows, "repository string, path string, content binary")
    got = {r.path: (r.language, r.line_count, r.decode_status) for r in T.scan(files, most_bytes=50).collect()}
    assert got == {"a/x.c": ("c", 1, "utf8"), "b/Makefile": ("kbuild", 1, "utf8"), "c/bad.txt": ("text", 1, "replacement")}
    assert {r.path for r in T.scan(files, ["a"], ["*.bin"]).collect()} == {"a/x.c"}
    with pytest.raises(ValueError):
        T.under_roots("path", ["../x"])


def test_evaluation_of_ranges(spark):
    evidence = spark.createDataFrame([("q", "pump.c", 10, 12), ("q", "pump.h", 3, 3)], "question_id string, path string, start_line int, end_line int")
    results = spark.createDataFrame([("q", 1, "pump.c", 1, 4), ("q", 2, "pump.h", 1, 5)], "question_id string, rank int, path string, start_line int, end_line int")
    m, f = V.range_metrics(evidence, results, 10).first(), V.file_metrics(evidence, results, 10).first()
    assert (m.range_recall, m.range_mrr, m.questions_partial, f.file_recall, f.file_mrr) == (0.5, 0.5, 1, 1.0, 1.0)
    assert V.file_metrics(evidence.limit(0), results, 10).first().file_recall is None


def test_evidence_budget_and_determinism(spark):
    rows = [("q", i, f"c{i}", "word " * (20 + i), False) for i in range(1, 8)]
    hits = spark.createDataFrame(rows, "query_id string, rank int, chunk_id string, content string, content_truncated boolean")
    packed = G.evidence(hits, 64, 4)
    total = G.budgets(packed).first()
    assert total.chars_used <= 256 and total.tokens_used <= 64 and total.truncated
    states = [r.disposition for r in packed.orderBy("rank").collect()]
    assert states[0] == "selected" and states[-1] in ("token_budget", "item_budget")
    left, asked = 256, []
    for _, _, _, content, _ in rows:  # the same walk in plain Python
        if len(asked) >= 4 or left < 64:
            continue
        body = content if len(content) <= left else content[: max(1, left - 1)].rstrip() + "…"
        asked.append(body)
        left -= len(body)
    assert [r.content for r in packed.where("disposition = 'selected'").orderBy("rank").collect()] == asked
    none = G.coverage(spark.createDataFrame([("z",)], "query_id string"), G.budgets(packed), spark.createDataFrame([], "query_id string")).first()
    assert none.evidence_status == "none" and list(none.gaps) == ["no evidence in scope"]


def test_fusion_weights_and_order(spark):
    rows = [("q", "word", 1, "s", "a", "r", "p", 1), ("q", "symbol_exact", 1, "s", "b", "r", "p", 2), ("q", "relation_source", 2, "s", "a", "r", "p", 1)]
    got = U.fuse(spark.createDataFrame(rows, "query_id string, channel string, rank int, snapshot_id string, chunk_id string, repository string, path string, start_line int")).orderBy("rank").collect()
    assert [(r.chunk_id, round(r.fused_score, 12)) for r in got] == [("b", round(2 / 61, 12)), ("a", round(1 / 61 + 0.75 / 62, 12))]


def test_vector_cache_and_rerank(spark):
    texts = spark.createDataFrame([("RELEVANT text",), ("other",), ("other",)], "text string")
    empty = spark.createDataFrame([], "model_fingerprint string, input_kind string, input_hash string, dimension int, vector array<float>")
    provider = lambda ts: [[1.0, 0.0] if "RELEVANT" in t else [0.0, 1.0] for t in ts]
    got, rows = U.cached_embeddings(texts, empty, "m", "document", 2, provider)
    assert {r.hit for r in got.collect()} == {False} and rows.count() == 2
    again, _ = U.cached_embeddings(texts, rows, "m", "document", 2, provider)
    assert {r.hit for r in again.collect()} == {True}
    candidates = spark.createDataFrame([("q", "x", 1, "r", "p", 1), ("q", "y", 2, "r", "p", 2)], "query_id string, chunk_id string, rank int, repository string, path string, start_line int")
    vectors = spark.createDataFrame([("x", [0.0, 1.0]), ("y", [1.0, 0.0])], "chunk_id string, vector array<float>")
    order = U.rerank(candidates, spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, query_vector array<float>"), vectors).orderBy("semantic_rank").collect()
    assert [r.chunk_id for r in order] == ["y", "x"]


def test_access_plan(spark):
    now = dt.datetime(2026, 1, 1)
    grants = spark.createDataFrame([("g1", "read", None), ("g2", "stale", None)], "id string, principal_id string, team_id string")
    sources = spark.createDataFrame([("g1", "manual", "read", None, None), ("g2", "manual", "admin", None, None)], "repository_grant_id string, source_kind string, permission string, expires_at timestamp, revoked_at timestamp")
    people = spark.createDataFrame([(1, "read"), (2, "write"), (99, "read")], "user_id long, permission string")
    bindings = spark.createDataFrame([(1, "read"), (2, "write"), (3, "stale")], "user_id long, principal_id string")
    got = {(r.action, r.principal_id, r.user_id, r.reason) for r in P.access_plan(people, bindings, grants, sources, F.lit(now)).collect()}
    assert got == {("unchanged", "read", 1, None), ("activate", "write", 2, "missing_direct_grant"), ("revoke_candidate", "stale", None, "not_a_bound_collaborator"), ("unmatched", None, 99, None), ("stale_binding", "stale", 3, None)}


def test_grant_sources_live_and_die(spark):
    now, past = dt.datetime(2026, 1, 1), dt.datetime(2025, 1, 1)
    schema = "repository_grant_id string, source_kind string, permission string, expires_at timestamp, revoked_at timestamp"
    rows = [("g", "manifest", "write", None, past), ("g", "manual", "read", None, None), ("h", "manual", "admin", past, None)]
    got = {r.repository_grant_id: (r.active, r.permission, list(r.active_source_kinds)) for r in P.effective_grants(spark.createDataFrame(rows, schema), F.lit(now)).collect()}
    assert got == {"g": (True, "read", ["manual"]), "h": (False, "read", [])}


def test_snapshot_artifacts_of_another_version_fail(spark):
    chunks = spark.createDataFrame([("a", 0, "k", 1, 2, None, "x")], "artifact_id string, ordinal int, kind string, start_line int, end_line int, symbol string, content string")
    packed = N.artifacts({"chunks": chunks})
    assert N.artifact_rows(packed).count() == 1
    with pytest.raises(Exception, match="artifact version"):
        N.artifact_rows(packed.withColumn("version", F.lit(9))).collect()


def test_bm25_statistics_cover_all_chunks_but_hits_the_scope(spark):
    rows = [("a", "s1", "r", "p1", 1, 2, "alpha beta"), ("b", "s2", "r", "p2", 1, 2, "alpha"), ("c", "s2", "r", "p3", 1, 2, "gamma")]
    chunks = spark.createDataFrame(rows, "chunk_id string, snapshot_id string, repository string, path string, start_line int, end_line int, content string")
    asked = spark.createDataFrame([(1, "Alpha gamma"), (2, "nothing here")], "query_id int, query string")
    every, some = S.bm25(chunks, asked).collect(), S.bm25(chunks, asked, scope=spark.createDataFrame([("s2",)], "snapshot_id string")).collect()
    assert {r.chunk_id for r in every} == {"a", "b", "c"} and {r.chunk_id for r in some} == {"b", "c"}
    assert {r.chunk_id: r.score for r in every if r.chunk_id != "a"} == {r.chunk_id: r.score for r in some}


def test_export_is_verified_and_idempotent(spark, tmp_path):
    import hashlib

    rows = [("s", "a.c", hashlib.sha256(b"x").hexdigest(), 1, b"x"), ("s", "b.c", hashlib.sha256(b"yy").hexdigest(), 2, b"yy")]
    files = spark.createDataFrame(rows, "snapshot_id string, path string, blob_id string, size_bytes long, content binary")
    first = N.export(files, str(tmp_path / "out")).first()
    assert (first.file_count, first.byte_count) == (2, 3) and N.export(files, str(tmp_path / "out")).first() == first
    with pytest.raises(ValueError, match="another export"):
        N.export(files.where("path = 'a.c'"), str(tmp_path / "out"))
    with pytest.raises(ValueError, match="differ"):
        N.export(files.withColumn("size_bytes", F.lit(9).cast("long")), str(tmp_path / "other"))


def test_substrings_and_passages_meet_like_a_plain_search(spark):
    texts = [("a", "The quick brown fox jumps"), ("b", "over the lazy dog, the end"), ("c", ""), ("d", "é quick"), ("e", "x\ny quick brown fox jumps over all\nz"), ("f", None)]
    terms = ["quick", "ck brown f", "e", "é", "the", "The quick brown fox jumps", "zz", "", "og,"]
    rows = spark.createDataFrame(texts, "path string, body string")
    got = {(r.path, r.term) for r in automaton.strings_in(rows, spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
    assert got == {(p, t) for p, b in texts for t in terms if t and t in (b or "")}
    passages = [(1, "quick brown fox jumps over"), (2, "ick brown fox jumps ov"), (3, "fox"), (4, "x\ny quick brown fox jumps over all\nz"), (5, "brown fox jumps over the lazy"), (6, "lazy dog"), (7, "The quick brown fox jumps")]
    found = [(r.path, r.id) for r in S.passage_matches(rows, spark.createDataFrame(passages, "id int, passage string")).collect()]
    assert sorted(found) == sorted((p, i) for p, b in texts for i, s in passages if s in (b or ""))


def test_spans_meet_chunks_once(spark):
    import random

    rng = random.Random(1)
    ranges = lambda n: [(f"f{rng.randrange(3)}", s := rng.randrange(1, 400), s + rng.choice([0, 1, 5, 90, 300]), i) for i in range(n)]
    spans, chunks = ranges(60), ranges(80)
    got = S.overlapping(spark.createDataFrame(spans, "file_id string, start_line int, end_line int, n int"), spark.createDataFrame(chunks, "file_id string, start_line int, end_line int, chunk_id int").withColumn("kind", F.lit("k"))).select("n", "chunk_id").collect()
    assert sorted(map(tuple, got)) == sorted((n, c) for f, a, b, n in spans for g, x, y, c in chunks if f == g and x <= b and y >= a)
    lines = [(f, a, i) for f, a, _, i in ranges(50)]
    conditions = [(f, a, b, i % 5, f"c{i}") for f, a, b, i in ranges(40)]
    found = K.condition_at(spark.createDataFrame(lines, "file_id string, start_line int, i int"), spark.createDataFrame(conditions, "file_id string, start_line int, end_line int, depth int, condition_id string")).collect()
    assert {r.i: r.condition_id for r in found} == {i: max(((d, c) for g, x, y, d, c in conditions if g == f and x <= a <= y), default=(0, None))[1] for f, a, i in lines}


def test_hashed_vectors_equal_a_plain_count(spark, sf_dir):
    import math
    import zlib

    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).collect()] + ["", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for r in rows.select("i", U.embed_column(F.col("text")).alias("v")).collect():
        want = [0.0] * 64
        for w in (texts[r.i] or "").lower().split():
            want[zlib.crc32(w.encode()) % 64] += 1 if zlib.crc32(w.encode()) & 0x10000 else -1
        size = math.sqrt(sum(x * x for x in want)) or 1
        assert list(r.v) == pytest.approx([x / size for x in want], abs=1e-6)


def test_repeated_names_of_a_query_count_where_they_stand_first(spark):
    symbols = spark.createDataFrame([("s1", "alpha"), ("s2", "beta")], "id string, name string")
    places = [("s1", "declaration", 8), ("s1", "definition", 30), ("s1", "use", 2), ("s2", "definition", 41)]
    occurrences = spark.createDataFrame([(s, r, "f", n, n) for s, r, n in places], "logical_symbol_id string, role string, file_id string, start_line int, end_line int")
    chunks = spark.createDataFrame([(f"c{i}", "f", "p", "r", "s", 10 * i, 10 * i + 9) for i in range(5)], "chunk_id string, file_id string, path string, repository string, snapshot_id string, start_line int, end_line int").withColumn("kind", F.lit("k"))
    relations = spark.createDataFrame([(f"r{n}", "f", a, b, "x", n, n, "source_exact") for a, b, n in (("s1", None, 12), ("s2", "s1", 22), (None, "s2", 3))], "id string, source_file_id string, source_symbol_id string, target_symbol_id string, target_text string, start_line int, end_line int, confidence string")
    once = spark.createDataFrame([(1, "alpha", 0), (1, "beta", 1)], "query_id int, name string, name_order int")
    twice = once.union(spark.createDataFrame([(1, "alpha", 5), (1, "beta", 2), (1, "alpha", 9)], once.schema))
    for k in (1, 2, 20):
        by = lambda names: [[(r.rank, r.chunk_id, r.name_order) for r in f.orderBy("rank").collect()] for f in (S.symbol_hits(names, symbols, occurrences, chunks, k), S.relation_hits(names, symbols, relations, chunks, k))]  # noqa: B023, E731
        assert by(once) == by(twice)
    assert by(once)[0] == [(1, "c3", 0), (2, "c0", 0), (3, "c4", 1)]


def test_first_files_are_cut_before_their_contents_move(spark):
    rows = [("a", p, b"x") for p in ("z.c", "d/b.c", "d/a.c", "a.c", "d/e/c.c")] + [("b", "q.c", b"y")]
    files = spark.createDataFrame(rows, "repository string, path string, content binary")
    got = T.first_files(files, 3)
    assert {(r.repository, r.path) for r in got.collect()} == {("a", "a.c"), ("a", "z.c"), ("a", "d/a.c"), ("b", "q.c")}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "content" in plan  # a broadcast of paths; no content in an exchange


def test_files_too_large_are_listed_but_not_opened(spark, tmp_path):
    (tmp_path / "t" / "d").mkdir(parents=True)
    (tmp_path / "t" / "a.c").write_text("int a;")
    (tmp_path / "t" / "d" / "b.c").write_text("x" * 500)
    files = T.read_tree(spark, str(tmp_path / "t"), "r", most_bytes=100)
    assert {(r.path, r.content and len(r.content)) for r in files.collect()} == {("a.c", 6), ("d/b.c", None)}
    assert "LessThanOrEqual(length,100)" in files._jdf.queryExecution().executedPlan().toString()
    assert [r.path for r in T.scan(files).collect()] == ["a.c"]
    counted = T.scan_counts(files, ["."], []).first()
    assert (counted.file_count, counted.skipped_file_count, counted.byte_count) == (1, 1, 6)


@pytest.mark.parametrize("most", [0, 1, 7, 299, 300, 1000])
def test_first_rows_by_prefix_counts(spark, most):
    rows = sorted((f"r{i % 90:03d}", f"c{i:04d}") for i in range(300))
    frame = spark.createDataFrame(rows, "reference_id string, candidate string").repartition(5)
    picked, stop = E._firsts(frame, most)
    assert sorted(r.candidate for r in picked.collect()) == sorted(c for _, c in rows[:most]) and stop == (rows[most][0] if most < 300 else None)


def test_passages_meet_bodies_by_row_numbers(spark, monkeypatch):
    frames = []
    meet = S._meet
    monkeypatch.setattr(S, "_meet", lambda dealt, asked, key: frames.append(dealt) or meet(dealt, asked, key))
    texts = spark.createDataFrame([("a", "one two three four five six"), ("a", "one two three four five six"), ("b", None)], "path string, body string")
    found = S.passage_matches(texts, spark.createDataFrame([(1, "two three four five six")], "id int, passage string"))
    assert [(r.path, r.id) for r in found.collect()] == [("a", 1)] * 2
    assert [f.columns for f in frames] == [["__row", "__key"]]
