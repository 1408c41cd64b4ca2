"""Queries over questions, evidence packs, evaluation, publishing and streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcelore import adapters as A
from sourcelore.functions.ids import citation
from sourcelore.functions.text import lines
from sourcelore.operators import fusion as U
from sourcelore.operators import index as W
from sourcelore.operators import search as S
from sourcelore.plans import evaluate as V
from sourcelore.plans import pack as G
from sourcelore.plans import snapshots as N
from sourcelore.queries import code, searching
from sourcelore.queries.base import CHUNKS, FILES, stable
from sourcelore.queries.searching import BM25, CUT, WORDS, fixed_queries, files
from sourcelore.sources import manifests as M
from sourcelore.sources import tree as T
from sourcelore.storage import durable, scratch
from sourcelore.streaming import jobs as J


def _scratch(spark, name: str) -> str:
    return scratch(spark, name)


def src2_questions(spark, d):
    """Turns written as JSON lines, some without terms, some cut off; read back as questions and rejects."""
    talk = A.table(spark, d, "conversations")
    body = F.to_json(F.struct(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("question"), F.lit("talk").alias("category"), F.lit(True).alias("synthetic"), F.when(F.col("conv_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"))).alias("query_terms"), F.array().cast("array<struct<path: string>>").alias("required_evidence")))
    path = _scratch(spark, "questions")
    talk.select(F.when(F.col("conv_id") % 7 == 0, F.substring(body, 1, 9)).when(F.col("conv_id") % 11 == 0, F.lit('{"id": "x"}')).otherwise(body).alias("value")).write.text(path)
    good, bad = M.read_questions(spark, path)
    return good.select(F.lit("accepted").alias("outcome")).union(bad.select("reason")).groupBy("outcome").agg(F.count("*").alias("n"))


def src3_scope(spark, d):
    """A scope whose roots are the languages of the documents, applied to the tree."""
    path = _scratch(spark, "scope")
    roots = A.table(spark, d, "documents").where("lang <> 'de'").agg(F.array_sort(F.collect_set("lang")).alias("include_roots"))
    roots.select("include_roots", F.array(F.lit("*/1*")).alias("exclude_globs"), F.lit(3000).alias("max_file_bytes")).coalesce(1).write.json(path)
    scope = M.read_scope(spark, path).first()
    return T.scan(A.tree(spark, d), list(scope.include_roots), list(scope.exclude_globs), scope.max_file_bytes).select("repository", "path")


def src4_members(spark, d):
    """Solution manifests made from suppliers, one file each nation, read as member rows."""
    path = _scratch(spark, "solutions")
    rows = A.table(spark, d, "supplier").groupBy(F.concat(F.lit("sol"), F.col("s_nationkey").cast("string")).alias("solution")).agg(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("r"), F.col("s_suppkey").cast("string")).alias("repository"), F.concat(F.lit("role"), F.col("s_suppkey").cast("string")).alias("role"), F.lit("s1").alias("snapshot_id")))).alias("members"))
    rows.select(F.col("solution").alias("name"), F.to_json(F.struct("members", "solution")).alias("value")).write.partitionBy("name").text(path)
    return M.read_members(spark, f"{path}/*/*.txt").select("solution_id", "repository", "ordinal", "manifest_digest")


def hits(spark, d, top_k=10):
    chunks = A.chunk_table(spark, d)
    found = W.bm25(A.word_index(spark, d), A.queries(spark, d), top_k).select("query_id", "chunk_id", "rank")
    return found.join(chunks.select("chunk_id", "content", F.col("path").alias("symbol"), "snapshot_id", "start_line", "end_line", "path", "repository", "content_hash", "revision"), "chunk_id").withColumn("content_truncated", F.lit(False))


def pck1_evidence(spark, d):
    return G.evidence(hits(spark, d), 700, 6).select("query_id", "rank", "chunk_id", "disposition", F.char_length("content").alias("kept_chars"), "content_truncated")


def pck2_symbols(spark, d):
    """Names asked for, with places and relations of the parts read as code."""
    names = code.read(spark, d, code.NAMES)
    cite = citation("snapshot_id", F.lit("r1"), "path", "start_line", "end_line")
    places = code.definitions(spark, d).select("name", "snapshot_id", cite.alias("citation"), "role")
    rel = code.calls(spark, d).select(F.col("source_name").alias("name"), "snapshot_id", cite.alias("citation"), "target_text")
    got = G.symbol_contexts(names, places, rel, 6)
    return got.select("query_id", "name", "snapshot_id", F.coalesce(F.size("occurrences"), F.lit(0)).alias("occurrences"), F.coalesce(F.size("relations"), F.lit(0)).alias("relations"), "truncated")


def jon13_links(spark, d):
    names = code.read(spark, d, code.NAMES)
    cite = citation("snapshot_id", F.lit("r1"), "path", "start_line", "end_line")
    places = code.definitions(spark, d).select("name", "snapshot_id", cite.alias("citation"), "role")
    rel = code.calls(spark, d).select(F.col("source_name").alias("name"), "snapshot_id", cite.alias("citation"), "target_text")
    contexts = G.symbol_contexts(names, places, rel, 50, 4, 200)
    return G.cross_links(contexts, places.select("snapshot_id", F.col("snapshot_id").alias("repository")).distinct(), 50).select("query_id", "symbol", "source_citation", "target_citation")


def pck3_coverage(spark, d):
    """Every query also in a form without a known word."""
    asked = A.queries(spark, d).select("query_id").union(A.queries(spark, d).select(-F.col("query_id") - 1))
    totals = G.budgets(G.evidence(hits(spark, d), 700, 6))
    got = G.coverage(asked, totals, asked.where("query_id % 3 = 0"))
    return got.select("query_id", "evidence_status", F.size("gaps").alias("gaps"), F.size("warnings").alias("warnings"))


def annotations(spark, d):
    """Benchmark texts that stand in documents, with the lines they touch."""
    docs = A.table(spark, d, "documents").select(F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text")
    marks = A.table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("passage"))
    found = S.passage_matches(docs.withColumnRenamed("text", "body"), marks).withColumn("before", F.split_part("body", "passage", F.lit(1)))
    breaks = lambda c: F.char_length(c) - F.char_length(F.replace(c, F.lit("\n"), F.lit("")))
    return found.select("question_id", "path", (breaks(F.col("before")) + 1).alias("start_line"), (breaks(F.col("before")) + breaks(F.col("passage")) + 1).alias("end_line"))


def results(spark, d):
    """Word search by the stored index."""
    return W.bm25(A.word_index(spark, d), A.queries(spark, d)).select(F.col("query_id").alias("question_id"), "rank", "path", "start_line", "end_line")


def _rounded(df, *names):
    return df.select(*[F.round(c, 9).alias(c) if c in names else c for c in df.columns])


def evl1_files(spark, d):
    found = results(spark, d)
    return _rounded(V.file_metrics(annotations(spark, d), found, 10), "file_recall", "file_mrr")


def evl2_ranges(spark, d):
    found = results(spark, d)
    return _rounded(V.range_metrics(annotations(spark, d), found, 10), "range_recall", "range_mrr")


def evl4_ablation(spark, d):
    """The hundred best word hits reranked by hashed vectors: the first order, the vectors' and the fused one, and the ceiling of all
    candidates."""
    h = durable(hits(spark, d, 100))
    texts = h.select("chunk_id", "content").distinct().select("chunk_id", U.embed_column(F.col("content")).alias("vector"))
    asked = A.queries(spark, d).select("query_id", U.embed_column(F.col("query"), True).alias("query_vector"))
    ranked = durable(U.rerank(h.select("query_id", "chunk_id", "rank", "repository", "path", "start_line", "end_line"), asked, texts), "ranked")
    return ablation(ranked, durable(annotations(spark, d)))


def ablation(ranked, marks):
    cols = [F.col("query_id").alias("question_id"), "path", "start_line", "end_line"]
    orders = {"candidates": "rank", "vectors": "semantic_rank", "fused": "fused_rank"}
    rows = reduce(DataFrame.union, [ranked.select(F.lit(name).alias("retriever"), F.col(by).alias("rank"), *cols) for name, by in orders.items()])
    cut = V.range_metrics(marks, rows, 10, ("retriever",)).withColumn("top_k", F.lit(10))
    return cut.union(V.range_metrics(marks, rows.where("retriever = 'candidates'"), 100, ("retriever",)).withColumn("retriever", F.lit("ceiling")).withColumn("top_k", F.lit(100)))


def evl5_routing(spark, d):
    """The repositories whose documents hold a passage against those of the hits; snapshots of even repositories are pinned."""
    want = annotations(spark, d).join(A.chunks(spark, d).select("path", "repository").distinct(), "path").select("question_id", "repository")
    h = durable(hits(spark, d)).select(F.col("query_id").alias("question_id"), "repository", "snapshot_id")
    pinned = h.where("cast(substring(repository, 4) as int) % 2 = 0").select("snapshot_id")
    return _rounded(V.routing(want, h, pinned), "routing_recall", "version_accuracy")


def evl6_annotations(spark, d):
    """Annotations moved down by a third of the file, and some to files that aren't there."""
    known = files(spark, d).select("path", F.size(lines("text")).alias("line_count"))
    moved = annotations(spark, d).withColumn("end_line", F.col("end_line") + F.col("question_id") % 5).withColumn("path", F.when(F.col("question_id") % 6 == 0, F.concat("path", F.lit(".bak"))).otherwise(F.col("path")))
    return V.evidence_violations(moved, known).groupBy("problem").agg(F.count("*").alias("n"))


def snp6_report(spark, d):
    """A stored report of the hits with faults planted by rank."""
    h, asked = hits(spark, d), A.queries(spark, d).withColumnRenamed("query_id", "question_id")
    report = h.withColumnRenamed("query_id", "question_id").join(asked, "question_id").select(
        F.when(F.col("rank") == 1, F.col("question_id") + 100_000).otherwise(F.col("question_id")).alias("question_id"), F.when(F.col("rank") == 2, F.concat("query", F.lit("?"))).otherwise(F.col("query")).alias("query"),
        F.when(F.col("rank") == 3, "gone").otherwise(F.col("chunk_id")).alias("chunk_id"), citation("repository", F.when(F.col("rank") == 4, "r9").otherwise(F.col("revision")), "path", "start_line", "end_line").alias("citation"),
        F.when(F.col("rank") == 5, "0").otherwise(F.col("content_hash")).alias("content_hash"),
    )
    return V.report_violations(report, asked, A.chunks(spark, d)).groupBy("problem").agg(F.count("*").alias("n"))


def set4_found(spark, d):
    """Expected files that the fixed-string baseline finds."""
    base = S.fixed_strings(files(spark, d), fixed_queries(spark, d)).select(F.col("query_id").alias("question_id"), "path")
    return annotations(spark, d).select("question_id", "path").intersect(base)


def snk1_publish(spark, d):
    """Blobs of two versions published one after the other, the first twice; chunks of one snapshot written twice."""
    path = _scratch(spark, "blobs")
    for make in (A.tree, A.tree, A.changed_tree):
        blobs = T.scan(make(spark, d)).select(F.col("blob_id").alias("id"), "size_bytes", "content")
        N.publish(blobs, path, "id")
    rows = A.chunks(spark, d).select("chunk_id", "snapshot_id")
    at = _scratch(spark, "chunks")
    N.publish(rows, at)
    stored = N.publish(rows.where("chunk_id < 'chunk_8'"), at).select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id"))
    return spark.read.parquet(path).select(F.lit("blob").alias("kind"), "id").union(stored)


def _audit(spark, d):
    """Events as audit records; a tenth of them comes again."""
    e = A.table(spark, d, "events").selectExpr("cast(ts as timestamp) as ts", "cast(user_id as string) as principal_id", "'d1' as security_domain_id", "cast(event_id as string) as request_id", "event_type as tool", "case when event_id % 20 = 19 then 'unknown' when event_id % 3 = 0 then 'denied' else 'success' end as outcome")
    return e.union(e.where("cast(request_id as int) % 10 = 3"))


def snk3_audit(spark, d):
    """What a batch adds to a log that holds every fourth request."""
    rows = _audit(spark, d)
    return J.append_audit(rows, J.audit_ids(rows.where("cast(request_id as int) % 4 = 0"))).select("id", "outcome")


def str1_audit_stream(spark, d):
    source, out = _scratch(spark, "audit-in"), _scratch(spark, "audit")
    rows = _audit(spark, d)
    rows.write.parquet(source)
    J.stream_audit(spark.readStream.schema(rows.schema).parquet(source), out, out + "-log", "400 days").awaitTermination()
    return spark.read.parquet(out).select("id", "outcome")


QUERIES = {f.__name__: f for f in (
    src2_questions, src3_scope, src4_members, pck1_evidence, pck2_symbols, jon13_links, pck3_coverage, evl1_files, evl2_ranges, evl4_ablation, evl5_routing, evl6_annotations, snp6_report, set4_found, snk1_publish,
    snk3_audit, str1_audit_stream,
)}

_ANN = r"""ann AS (SELECT question_id, path, (length(before) - length(replace(before, chr(10), '')) + 1)::INTEGER AS start_line, (length(before) - length(replace(before, chr(10), '')) + length(passage) - length(replace(passage, chr(10), '')) + 1)::INTEGER AS end_line, source
    FROM (SELECT item_id AS question_id, b.text AS passage, lang || '/' || doc_id || '.txt' AS path, source, left(d.text, position(b.text IN d.text) - 1) AS before FROM documents d JOIN benchmark b ON contains(d.text, b.text)) x)"""
_HITS = f"{BM25}, {CUT}, hits AS (SELECT t.query_id, t.rank, c.* FROM top t JOIN chunks c USING (chunk_id)), {_ANN}"
_AUD = f"aud AS (SELECT {stable('audit', chr(39) + 'd1' + chr(39), 'user_id::VARCHAR', 'event_id::VARCHAR', 'event_type')} AS id, CASE WHEN event_id % 3 = 0 THEN 'denied' ELSE 'success' END AS outcome, event_id FROM events WHERE event_id % 20 <> 19)"
_RANGES = "rr AS (SELECT a.question_id, a.path, a.start_line, a.end_line, min(h.rank) FILTER (WHERE a.start_line <= h.end_line AND h.start_line <= a.end_line) AS rank FROM ann a LEFT JOIN hits h ON h.query_id = a.question_id AND h.path = a.path GROUP BY ALL), rq AS (SELECT question_id, count(*) AS n, count(rank) AS f, coalesce(1.0::DOUBLE / min(rank), 0) AS rr FROM rr GROUP BY 1)"
_WALK = f"""{_HITS}, walk AS (SELECT DISTINCT query_id, 0::BIGINT AS rank, NULL::VARCHAR AS chunk_id, NULL::VARCHAR AS disposition, NULL::VARCHAR AS kept, false AS content_truncated, 0 AS items, 0::BIGINT AS used FROM hits
        UNION ALL SELECT query_id, rank, chunk_id, disposition, kept, kept IS NOT NULL AND NOT fits, items + (kept IS NOT NULL)::INTEGER, used + coalesce(length(kept), 0)
        FROM (SELECT *, CASE WHEN disposition = 'selected' THEN CASE WHEN fits THEN content ELSE regexp_replace(left(content, greatest(1, 2799 - used)::BIGINT), '\\s+$', '') || '…' END END AS kept
            FROM (SELECT w.query_id, h.rank, h.chunk_id, h.content, w.items, w.used, length(h.content) <= 2800 - w.used AS fits, CASE WHEN w.items >= 6 THEN 'item_budget' WHEN 2800 - w.used < 64 THEN 'token_budget' ELSE 'selected' END AS disposition FROM walk w JOIN hits h ON h.query_id = w.query_id AND h.rank = w.rank + 1) x) y),
    totals AS (SELECT query_id, count_if(disposition = 'selected') AS items, sum(coalesce(length(kept), 0))::BIGINT AS chars, count_if(disposition <> 'selected') AS omitted, string_agg(chunk_id, ',' ORDER BY rank) FILTER (WHERE disposition = 'selected') AS picked FROM walk WHERE rank > 0 GROUP BY 1)"""
_CITE = "snapshot_id || '@r1:' || path || ':' || start_line || '-' || end_line"
_CONTEXTS = lambda symbols, occurrences, relations: f"""{code.C}, oc AS (SELECT name, snapshot_id, {_CITE} AS citation, role, row_number() OVER (PARTITION BY name, snapshot_id ORDER BY {_CITE}, role) AS n FROM defs),
    rl AS (SELECT *, row_number() OVER (PARTITION BY name, snapshot_id ORDER BY citation, target_text) AS n FROM (SELECT DISTINCT source_name AS name, snapshot_id, {_CITE} AS citation, target_text FROM calls) x),
    oo AS (SELECT name, snapshot_id, least(count(*), {occurrences})::INTEGER AS occurrences, count(*) > {occurrences} AS more FROM oc GROUP BY ALL), rr AS (SELECT name, snapshot_id, least(count(*), {relations})::INTEGER AS relations, count(*) > {relations} AS more FROM rl GROUP BY ALL),
    ctx AS (SELECT query_id, name, snapshot_id, coalesce(occurrences, 0) AS occurrences, coalesce(relations, 0) AS relations, coalesce(o.more, false) OR coalesce(r.more, false) AS truncated FROM names JOIN (oo o FULL JOIN rr r USING (name, snapshot_id)) USING (name) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY name_order, snapshot_id) <= {symbols})"""  # noqa: E731
ORACLES = {
    "set4_found": f"WITH {_ANN}, base AS ({searching.ORACLES['lex4_fixed_strings']}) SELECT DISTINCT question_id, a.path FROM ann a JOIN base b ON b.query_id = a.question_id AND b.path = a.path",
    "pck1_evidence": f"WITH RECURSIVE {_WALK} SELECT query_id, rank::INTEGER AS rank, chunk_id, disposition, length(kept)::INTEGER AS kept_chars, content_truncated FROM walk WHERE rank > 0",
    "pck3_coverage": f"WITH RECURSIVE {_WALK}, a AS (SELECT item_id AS query_id FROM benchmark UNION ALL SELECT -item_id - 1 FROM benchmark) SELECT query_id, CASE WHEN coalesce(items, 0) > 0 THEN 'available_unassessed' ELSE 'none' END AS evidence_status, (1 + coalesce((omitted > 0)::INTEGER, 0))::INTEGER AS gaps, (query_id % 3 = 0)::INTEGER AS warnings FROM a LEFT JOIN totals USING (query_id)",
    "pck2_symbols": f"WITH {_CONTEXTS(6, 4, 8)} SELECT query_id, name, snapshot_id, occurrences, relations, truncated FROM ctx",
    "jon13_links": f"""WITH {_CONTEXTS(50, 4, 200)}, s AS (SELECT query_id, c.snapshot_id, citation, target_text FROM ctx c JOIN rl r ON r.name = c.name AND r.snapshot_id = c.snapshot_id AND r.n <= 200),
        t AS (SELECT query_id, c.name, c.snapshot_id, arg_min(citation, n) AS citation FROM ctx c JOIN oc o ON o.name = c.name AND o.snapshot_id = c.snapshot_id AND o.n <= 4 WHERE role = 'definition' GROUP BY ALL),
        l AS (SELECT DISTINCT s.query_id, t.name AS symbol, s.snapshot_id AS a, s.citation AS source_citation, t.snapshot_id AS b, t.citation AS target_citation FROM s JOIN t ON s.query_id = t.query_id AND s.target_text = t.name AND s.snapshot_id <> t.snapshot_id)
        SELECT query_id, symbol, source_citation, target_citation FROM l QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY symbol, a, source_citation, b, target_citation) <= 50""",
    "src2_questions": "WITH u AS (SELECT conv_id FROM conversations) SELECT CASE WHEN conv_id % 7 = 0 THEN 'not_json' WHEN conv_id % 11 = 0 THEN 'missing_field' WHEN conv_id % 5 = 0 THEN 'no_query_terms' ELSE 'accepted' END AS outcome, count(*)::BIGINT AS n FROM u GROUP BY 1",
    "src3_scope": f"WITH {FILES} SELECT repository, path FROM files WHERE lang <> 'de' AND NOT contains(path, '/1') AND strlen(text) <= 3000",
    "src4_members": "WITH m AS (SELECT 'sol' || s_nationkey AS solution_id, 'r' || s_suppkey AS repository, 'role' || s_suppkey AS role FROM supplier), g AS (SELECT solution_id, sha256('{\"members\":[' || string_agg('{\"repository\":\"' || repository || '\",\"role\":\"' || role || '\",\"snapshot_id\":\"s1\"}', ',' ORDER BY repository) || '],\"solution\":\"' || solution_id || '\"}') AS manifest_digest FROM m GROUP BY 1) SELECT m.solution_id, repository, (row_number() OVER (PARTITION BY m.solution_id ORDER BY repository) - 1)::INTEGER AS ordinal, manifest_digest FROM m JOIN g USING (solution_id)",
    "evl1_files": f"WITH {_HITS}, w AS (SELECT DISTINCT question_id, path FROM ann), f AS (SELECT w.*, (SELECT min(rank) FROM hits h WHERE h.query_id = w.question_id AND h.path = w.path) AS rank FROM w), q AS (SELECT question_id, count(*) AS n, count(rank) AS f, coalesce(1.0::DOUBLE / min(rank), 0) AS rr FROM f GROUP BY 1) SELECT sum(f)::BIGINT AS files_found, sum(n)::BIGINT AS files_total, round(sum(f)::DOUBLE / sum(n), 9) AS file_recall, round(avg(rr), 9) AS file_mrr FROM q",
    "evl2_ranges": f"WITH {_HITS}, {_RANGES} SELECT sum(f)::BIGINT AS ranges_found, sum(n)::BIGINT AS ranges_total, round(sum(f)::DOUBLE / sum(n), 9) AS range_recall, round(avg(rr), 9) AS range_mrr, count_if(f = n)::BIGINT AS questions_complete, count_if(f > 0 AND f < n)::BIGINT AS questions_partial, count_if(f = 0)::BIGINT AS questions_missed FROM rq",
    "evl5_routing": f"WITH {_HITS}, g AS (SELECT query_id, string_agg(DISTINCT repository, ',' ORDER BY repository) AS got FROM hits GROUP BY 1), w AS (SELECT question_id, string_agg(DISTINCT source, ',' ORDER BY source) AS wanted FROM ann GROUP BY 1) SELECT (SELECT round(avg((coalesce(got, '') = wanted)::INTEGER::DOUBLE), 9) FROM w LEFT JOIN g ON question_id = query_id) AS routing_recall, (SELECT round(avg((substr(repository, 4)::INTEGER % 2 = 0)::INTEGER::DOUBLE), 9) FROM hits) AS version_accuracy",
    "evl6_annotations": f"WITH {FILES}, {_ANN}, n AS (SELECT path, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - (CASE WHEN right(text, 1) = chr(10) THEN 1 ELSE 0 END) END AS n FROM files), p AS (SELECT CASE WHEN question_id % 6 = 0 THEN 'missing_file' WHEN end_line + question_id % 5 > n THEN 'lines_out_of_bounds' END AS problem FROM ann JOIN n USING (path)) SELECT problem, count(*)::BIGINT AS n FROM p WHERE problem IS NOT NULL GROUP BY 1",
    "snp6_report": f"WITH {_HITS} SELECT CASE rank WHEN 1 THEN 'unknown_question' WHEN 2 THEN 'other_query' WHEN 3 THEN 'unknown_chunk' WHEN 4 THEN 'other_citation' ELSE 'other_content' END AS problem, count(*)::BIGINT AS n FROM hits WHERE rank <= 5 GROUP BY 1",
    "snk1_publish": f"WITH {CHUNKS}, b AS (SELECT sha256(text) AS id FROM documents UNION SELECT sha256(CASE WHEN doc_id % 10 = 7 THEN text || chr(10) || 'one more line' ELSE text END) FROM documents WHERE doc_id % 10 <> 3), again AS (SELECT DISTINCT snapshot_id FROM chunks WHERE chunk_id < 'chunk_8') SELECT 'blob' AS kind, id FROM b UNION ALL SELECT 'chunk', chunk_id FROM chunks WHERE chunk_id < 'chunk_8' OR snapshot_id NOT IN (SELECT snapshot_id FROM again)",
    "snk3_audit": f"WITH {_AUD} SELECT DISTINCT id, outcome FROM aud WHERE event_id % 4 <> 0",
    "str1_audit_stream": f"WITH {_AUD} SELECT DISTINCT id, outcome FROM aud",
}
