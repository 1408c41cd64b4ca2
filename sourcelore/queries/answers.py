"""Queries from questions to packs, over parts read as code: three real channels, their fusion, packs and the comparison of retrievers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcelore import adapters as A
from sourcelore.operators import fusion as U
from sourcelore.operators import index as W
from sourcelore.plans import answers as Q
from sourcelore.plans import evaluate as V
from sourcelore.queries import code
from sourcelore.queries.base import stable
from sourcelore.queries.packs import _CITE, _rounded
from sourcelore.queries.searching import CUT, SCORED, WORDS
from sourcelore.storage import durable, scratch

TOP, ITEMS, TOKENS, SYMBOLS, RELATIONS = 10, 4, 120, 6, 8
# In SQL that Spark and DuckDB both take: a line of code for each part, and two hundred parts to a question.
_LINES = f"""SELECT {code._FILE} || ':' || {code._PATH} || ':' || CAST(CAST(floor(p_partkey / 10) AS INT) AS STRING) AS chunk_id, p_partkey AS k, {code._NAME} AS name,
    'int ' || {code._NAME} || '(size_' || CAST(p_size AS STRING) || ' a) // ' || lower(p_type) || ' ' || p_name AS line FROM {{part}}"""
_ASKED = f"SELECT CAST(floor(p_partkey / 200) AS BIGINT) AS query_id, p_partkey AS k, {code._NAME} || ' ' || lower(p_type) AS piece FROM {{part}}"


def questions(spark, d) -> DataFrame:
    pieces = code.read(spark, d, _ASKED).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("k", "piece"))).alias("all"))
    return pieces.select("query_id", F.array_join(F.transform("all", lambda x: x["piece"]), " ").alias("query"))


def catalog(spark, d) -> Q.Catalog:
    """What ingest has stored of this version of the tables."""
    return A.once(spark, d, "catalog", lambda: _ingested(spark, d), ("part", "lineitem"))


def _ingested(spark, d) -> Q.Catalog:
    """The rows of a snapshot for each repository, stored, and the index of their chunks, written by snapshot."""
    lines = code.read(spark, d, _LINES).groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("k", "line", "name"))).alias("all"))
    text = lines.select("chunk_id", F.array_join(F.transform("all", lambda x: x["line"]), "\n").alias("content"), F.get("all", 0)["name"].alias("symbol"))
    chunks = code.read(spark, d, code.CODE_CHUNKS).join(text, "chunk_id").withColumns({"revision": F.lit("r1"), "content_hash": F.sha2("content", 256)})
    chunks = durable(chunks, "chunks")
    path = scratch(spark, "index")
    for n in (0, 1):
        W.add_snapshots(chunks.where(F.lit(n == 1) | (F.col("snapshot_id") == "repo0")), path)
    return Q.Catalog(W.WordIndex(spark, path), chunks, durable(code._symbols(spark, d), "symbols"), durable(code.definitions(spark, d), "places"), durable(code.resolved(spark, d), "relations"))


def w2_catalog(spark, d):
    """The stored rows and postings by kind."""
    own = catalog(spark, d)
    kinds = {"chunk": own.chunks, "logical_symbol": own.symbols, "symbol_occurrence": own.occurrences, "relation": own.relations, "indexed_chunk": own.index.chunks}
    counts = [rows.agg(F.lit(kind).alias("kind"), F.count("*").alias("n")) for kind, rows in kinds.items()]
    return reduce(DataFrame.union, [*counts, own.index.postings.agg(F.lit("posting").alias("kind"), F.sum("n").alias("n"))])


def _channels(spark, d):
    return Q.channels(catalog(spark, d), questions(spark, d), TOP)


def rrf1_fusion(spark, d):
    return U.fuse(_channels(spark, d), TOP).select("query_id", "snapshot_id", "chunk_id", "rank", "best_rank", F.round("fused_score", 12).alias("fused_score"), F.array_join("contributions", " ").alias("contributions"))


def rrf2_repositories(spark, d):
    """The repositories as members of a solution."""
    found = _channels(spark, d)
    members = code.read(spark, d, code.CODE_CHUNKS).select("snapshot_id").distinct().select("snapshot_id", F.expr("cast(substring(snapshot_id, 5) as int)").alias("ordinal"))
    return U.fuse_repositories(found, members, TOP).select("query_id", "chunk_id", "rank", "repository_rank", "ordinal")


def agg9_channel_counts(spark, d):
    return U.channel_counts(_channels(spark, d))


def pck4_packs(spark, d):
    """Questions to packs, in one job."""
    got = Q.packs(catalog(spark, d), questions(spark, d), TOKENS, ITEMS, SYMBOLS, RELATIONS, top_k=TOP)
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).alias(c)
    return got.select("query_id", "id", "trace_id", size("evidence"), size("symbols"), size("links"), "evidence_status", F.size("gaps").alias("gaps"))


def annotations(spark, d):
    """The lines that define the first five parts of each question."""
    at = code.read(spark, d, code.DEFS.replace("SELECT ", "SELECT p_partkey, ", 1)).where("p_partkey % 200 < 5")
    return at.select(F.floor(F.col("p_partkey") / 200).alias("question_id"), "path", "start_line", "end_line")


def evl3_compare(spark, d):
    """Words alone against the fusion of all three channels."""
    own = catalog(spark, d)
    asked = questions(spark, d)
    cols = [F.col("query_id").alias("question_id"), "rank", "path", "start_line", "end_line"]
    channels = Q.channels(own, asked, TOP)
    hits = lambda name, rows: rows.select(F.lit(name).alias("retriever"), "query_id", "rank", "path", "start_line", "chunk_id")
    found = hits("word", channels.where("channel = 'word'")).union(hits("hybrid", U.fuse(channels, TOP)))
    found = found.join(own.chunks.select("chunk_id", "end_line"), "chunk_id").select("retriever", *cols)
    return _rounded(V.compare(durable(annotations(spark, d)), durable(found), TOP, "word", "hybrid"), "base", "other", "delta")


QUERIES = {f.__name__: f for f in (w2_catalog, rrf1_fusion, rrf2_repositories, agg9_channel_counts, pck4_packs, evl3_compare)}

_OVER = code._OVER
_CH = f"""{code.C}, piece AS ({_LINES.format(part='part')}), body AS (SELECT chunk_id, string_agg(line, chr(10) ORDER BY k) AS content, arg_min(name, k) AS symbol FROM piece GROUP BY 1),
    chunks AS (SELECT c.*, content, symbol, sha256(content) AS content_hash FROM chunk c JOIN body USING (chunk_id)),
    question AS (SELECT query_id, string_agg(piece, ' ' ORDER BY k) AS query FROM ({_ASKED.format(part='part')}) x GROUP BY 1), asked AS (SELECT query_id, unnest({WORDS.format('query')}) AS term FROM question), {SCORED}, {CUT},
    idents AS (SELECT query_id, w AS name, min(i) AS i FROM (SELECT query_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT query_id, regexp_extract_all(query, '[\\p{{L}}\\p{{N}}_]+') AS ws FROM question) a) b WHERE regexp_full_match(w, '[A-Za-z_][A-Za-z0-9_]*') GROUP BY ALL),
    qn AS (SELECT query_id, name, row_number() OVER (PARTITION BY query_id ORDER BY i) AS name_order FROM idents QUALIFY name_order <= 16),
    sf AS (SELECT n.query_id, n.name, n.name_order, s.role, s.start_line, c.chunk_id, c.path, c.snapshot_id, c.repository, c.start_line AS at FROM qn n JOIN defs s USING (name) JOIN {_OVER}),
    sg AS (SELECT * FROM sf QUALIFY row_number() OVER (PARTITION BY query_id, name ORDER BY CASE role WHEN 'definition' THEN 0 WHEN 'declaration' THEN 1 ELSE 2 END, path, start_line, chunk_id) <= 30),
    sk AS (SELECT * FROM sg QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY name_order, CASE role WHEN 'definition' THEN 0 ELSE 1 END, path, start_line) = 1),
    st AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY name_order, CASE role WHEN 'definition' THEN 0 ELSE 1 END, path, start_line, chunk_id)::INTEGER AS rank FROM sk QUALIFY rank <= {TOP}),
    ids AS (SELECT DISTINCT query_id, name_order, logical_symbol_id FROM qn JOIN defs USING (name)),
    rh AS (SELECT query_id, name_order, id FROM rel JOIN ids ON source_symbol_id = logical_symbol_id UNION ALL SELECT query_id, name_order, id FROM rel JOIN ids ON target_symbol_id = logical_symbol_id UNION ALL SELECT query_id, name_order, id FROM rel JOIN qn ON target_text = name),
    rm AS (SELECT query_id, id, min(name_order) AS name_order FROM rh GROUP BY ALL), rf AS (SELECT m.query_id, m.name_order, s.confidence, s.start_line, s.id, c.path, c.chunk_id FROM rm m JOIN rel s USING (id) JOIN {_OVER}),
    rk AS (SELECT * FROM rf QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY name_order, CASE confidence WHEN 'source_exact' THEN 0 ELSE 1 END, path, start_line, id) = 1),
    rt AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY name_order, CASE confidence WHEN 'source_exact' THEN 0 ELSE 1 END, path, start_line, id, chunk_id)::INTEGER AS rank FROM rk QUALIFY rank <= {TOP}),
    ch AS (SELECT query_id, 'word' AS channel, rank, chunk_id FROM top UNION ALL SELECT query_id, 'symbol_exact', rank, chunk_id FROM st UNION ALL SELECT query_id, 'relation_source', rank, chunk_id FROM rt),
    sums AS (SELECT query_id, chunk_id, any_value(c.repository) AS repository, any_value(c.snapshot_id) AS snapshot_id, any_value(c.path) AS path, any_value(c.start_line) AS start_line, any_value(c.end_line) AS end_line, min(rank) AS best_rank,
        coalesce(max(1.0::DOUBLE / (60 + rank)) FILTER (WHERE channel = 'word'), 0) + coalesce(max(2.0::DOUBLE / (60 + rank)) FILTER (WHERE channel = 'symbol_exact'), 0) + coalesce(max(0.75::DOUBLE / (60 + rank)) FILTER (WHERE channel = 'relation_source'), 0) AS fused,
        concat_ws(' ', 'word:' || min(rank) FILTER (WHERE channel = 'word'), 'symbol_exact:' || min(rank) FILTER (WHERE channel = 'symbol_exact'), 'relation_source:' || min(rank) FILTER (WHERE channel = 'relation_source')) AS contributions FROM ch JOIN chunks c USING (chunk_id) GROUP BY query_id, chunk_id),
    fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, best_rank, repository, path, start_line, chunk_id)::INTEGER AS rank FROM sums QUALIFY rank <= {TOP})"""
_json = lambda **fields: "'{' || " + " || ',' || ".join(f"'\"{k}\":\"' || {fields[k]} || '\"'" for k in sorted(fields)) + " || '}'"
_evidence_id = lambda prefix, **fields: f"'{prefix}_' || substr(sha256({_json(**fields)}), 1, 24)"
_CHARS = 4 * TOKENS
_PACKS = f"""{_CH}, walk AS (SELECT query_id, 0 AS rank, NULL::VARCHAR AS chunk_id, NULL::VARCHAR AS disposition, NULL::VARCHAR AS kept, 0 AS items, 0::BIGINT AS used FROM question
        UNION ALL SELECT query_id, rank, chunk_id, disposition, kept, items + (kept IS NOT NULL)::INTEGER, used + coalesce(length(kept), 0)
        FROM (SELECT *, CASE WHEN disposition = 'selected' THEN CASE WHEN fits THEN content ELSE regexp_replace(left(content, greatest(1, {_CHARS - 1} - used)::BIGINT), '\\s+$', '') || '…' END END AS kept
            FROM (SELECT w.query_id, h.rank, h.chunk_id, c.content, w.items, w.used, length(c.content) <= {_CHARS} - w.used AS fits, CASE WHEN w.items >= {ITEMS} THEN 'item_budget' WHEN {_CHARS} - w.used < 64 THEN 'token_budget' ELSE 'selected' END AS disposition
                FROM walk w JOIN fused h ON h.query_id = w.query_id AND h.rank = w.rank + 1 JOIN chunks c ON c.chunk_id = h.chunk_id) x) y),
    cand AS (SELECT w.query_id, w.rank, w.chunk_id, w.disposition, w.kept, f.fused, f.contributions, f.snapshot_id, c.content_hash, {_evidence_id('evidence', snapshot_id='f.snapshot_id', chunk_id='w.chunk_id', content_hash='c.content_hash')} AS evidence_id
        FROM walk w JOIN fused f USING (query_id, chunk_id) JOIN chunks c USING (chunk_id)),
    totals AS (SELECT query_id, count_if(disposition = 'selected') AS items, sum(coalesce(length(kept), 0))::BIGINT AS chars, count_if(disposition <> 'selected') AS omitted, string_agg(chunk_id || '|' || fused::DECIMAL(20, 12)::VARCHAR || '|' || contributions || '|' || disposition, ',' ORDER BY rank) AS candidates, string_agg(evidence_id, ',' ORDER BY rank) FILTER (WHERE disposition = 'selected') AS evidence_ids FROM cand GROUP BY 1),
    cn AS (SELECT query_id, name, row_number() OVER (PARTITION BY query_id ORDER BY o, name) AS name_order FROM (SELECT query_id, name, min(o) AS o FROM (SELECT query_id, name, name_order - 1 AS o FROM qn UNION ALL SELECT f.query_id, c.symbol, f.rank + 1000 FROM fused f JOIN chunks c USING (chunk_id)) a GROUP BY ALL) b),
    oc AS (SELECT name, snapshot_id, {_CITE} AS citation, role, row_number() OVER (PARTITION BY name, snapshot_id ORDER BY {_CITE}, role) AS n FROM (SELECT DISTINCT name, snapshot_id, path, start_line, end_line, role, logical_symbol_id, file_id FROM defs) z),
    rl AS (SELECT *, row_number() OVER (PARTITION BY name, snapshot_id ORDER BY citation, target_text) AS n FROM (SELECT DISTINCT d.name, r.snapshot_id, {_CITE.replace('snapshot_id', 'r.snapshot_id').replace('path', 'r.path').replace('start_line', 'r.start_line').replace('end_line', 'r.end_line')} AS citation, r.target_text FROM rel r JOIN (SELECT DISTINCT logical_symbol_id, name FROM defs) d ON r.source_symbol_id = d.logical_symbol_id) x),
    oo AS (SELECT name, snapshot_id, count(*) AS occurrences FROM oc GROUP BY ALL), rr AS (SELECT name, snapshot_id, count(*) AS relations FROM rl GROUP BY ALL),
    ctx AS (SELECT query_id, name, name_order, snapshot_id FROM cn JOIN (oo FULL JOIN rr USING (name, snapshot_id)) USING (name) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY name_order, snapshot_id) <= {SYMBOLS}),
    ls AS (SELECT query_id, c.snapshot_id, citation, target_text FROM ctx c JOIN rl r ON r.name = c.name AND r.snapshot_id = c.snapshot_id AND r.n <= {RELATIONS}),
    lt AS (SELECT query_id, c.name, c.snapshot_id, arg_min(citation, n) AS citation FROM ctx c JOIN oc o ON o.name = c.name AND o.snapshot_id = c.snapshot_id AND o.n <= 4 WHERE role = 'definition' GROUP BY ALL),
    l0 AS (SELECT DISTINCT s.query_id, t.name AS symbol, s.snapshot_id AS a, s.citation AS source_citation, t.snapshot_id AS b, t.citation AS target_citation FROM ls s JOIN lt t ON s.query_id = t.query_id AND s.target_text = t.name AND s.snapshot_id <> t.snapshot_id),
    l1 AS (SELECT *, {_evidence_id('cross_link', symbol='symbol', source_snapshot_id='a', source_citation='source_citation', target_snapshot_id='b', target_citation='target_citation')} AS link_id FROM l0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY symbol, a, source_citation, b, target_citation) <= 50),
    lg AS (SELECT query_id, count(*) AS links, string_agg(link_id, ',' ORDER BY symbol, a, source_citation, b, target_citation) AS link_ids FROM l1 GROUP BY 1),
    sy AS (SELECT query_id, count(*) AS symbols, string_agg(name || '|' || snapshot_id, ',' ORDER BY name_order, snapshot_id) AS symbol_names FROM ctx GROUP BY 1),
    ct AS (SELECT query_id, string_agg(channel || ':' || n, ',' ORDER BY channel) AS counts FROM (SELECT query_id, channel, count(*) AS n FROM ch GROUP BY ALL) a GROUP BY 1),
    sc AS (SELECT string_agg(DISTINCT snapshot_id, ',' ORDER BY snapshot_id) AS snapshots FROM chunks),
    whole_ AS (SELECT query_id, query, snapshots, coalesce(candidates, '') AS candidates, coalesce(evidence_ids, '') AS evidence_ids, coalesce(symbol_names, '') AS symbol_names, coalesce(link_ids, '') AS link_ids, coalesce(counts, '') AS counts, coalesce(items, 0) AS items, coalesce(omitted, 0) AS omitted, coalesce(symbols, 0) AS symbols, coalesce(links, 0) AS links,
        '{TOKENS}|{ITEMS}|{SYMBOLS}|{RELATIONS}|' || coalesce(items, 0) || '|' || coalesce(chars, 0) || '|' || coalesce(omitted, 0) AS budget FROM question LEFT JOIN totals USING (query_id) LEFT JOIN sy USING (query_id) LEFT JOIN lg USING (query_id) LEFT JOIN ct USING (query_id), sc),
    traced AS (SELECT *, {_evidence_id('trace', query='query', snapshots='snapshots', candidates='candidates', symbols='symbol_names', links='link_ids', counts='counts', budget='budget')} AS trace_id FROM whole_)"""
_ANN = f"ann AS (SELECT floor(p_partkey / 200)::BIGINT AS question_id, path, start_line, end_line FROM ({code.DEFS.replace('SELECT ', 'SELECT p_partkey, ', 1).format(part='part')}) x WHERE p_partkey % 200 < 5)"
ORACLES = {
    "w2_catalog": f"""WITH {_CH} SELECT 'chunk' AS kind, count(*)::BIGINT AS n FROM chunks UNION ALL SELECT 'indexed_chunk', count(*) FROM chunks UNION ALL SELECT 'logical_symbol', count(DISTINCT logical_symbol_id) FROM defs UNION ALL SELECT 'symbol_occurrence', count(*) FROM defs
        UNION ALL SELECT 'relation', count(*) FROM rel UNION ALL SELECT 'posting', count(*) FROM (SELECT DISTINCT chunk_id, term FROM token) x""",
    "rrf1_fusion": f"WITH {_CH} SELECT query_id, snapshot_id, chunk_id, rank, best_rank, round(fused, 12) AS fused_score, contributions FROM fused",
    "rrf2_repositories": f"""WITH {_CH}, loc AS (SELECT *, row_number() OVER (PARTITION BY query_id, repository ORDER BY fused DESC, best_rank, path, start_line, chunk_id)::INTEGER AS repository_rank, substr(repository, 5)::INTEGER AS ordinal FROM sums QUALIFY repository_rank <= {TOP})
        SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY repository_rank, ordinal, fused DESC, path, start_line, chunk_id)::INTEGER AS rank, repository_rank, ordinal FROM loc QUALIFY rank <= {TOP}""",
    "agg9_channel_counts": f"WITH {_CH} SELECT query_id, channel, count(*)::BIGINT AS candidates FROM ch GROUP BY ALL",
    "pck4_packs": f"WITH RECURSIVE {_PACKS} SELECT query_id, {_evidence_id('context', trace='trace_id', snapshots='snapshots', evidence='evidence_ids', links='link_ids')} AS id, trace_id, items::INTEGER AS evidence, symbols::INTEGER AS symbols, links::INTEGER AS links, CASE WHEN items > 0 THEN 'available_unassessed' ELSE 'none' END AS evidence_status, (1 + (omitted > 0)::INTEGER)::INTEGER AS gaps FROM traced",
    "evl3_compare": f"""WITH {_CH}, {_ANN}, res AS (SELECT 'word' AS retriever, query_id, rank, path, start_line, end_line FROM top UNION ALL SELECT 'hybrid', query_id, rank, path, start_line, end_line FROM fused), both_r AS (SELECT unnest(['word', 'hybrid']) AS retriever),
        fr AS (SELECT b.retriever, w.question_id, w.path, (SELECT min(h.rank) FROM res h WHERE h.retriever = b.retriever AND h.query_id = w.question_id AND h.path = w.path) AS rank FROM (SELECT DISTINCT question_id, path FROM ann) w, both_r b),
        rg AS (SELECT b.retriever, w.question_id, (SELECT min(h.rank) FROM res h WHERE h.retriever = b.retriever AND h.query_id = w.question_id AND h.path = w.path AND w.start_line <= h.end_line AND h.start_line <= w.end_line) AS rank FROM (SELECT DISTINCT question_id, path, start_line, end_line FROM ann) w, both_r b),
        q AS (SELECT 'file' AS what, retriever, question_id, count(*) AS n, count(rank) AS f, coalesce(1.0::DOUBLE / min(rank), 0) AS rr FROM fr GROUP BY ALL UNION ALL SELECT 'range', retriever, question_id, count(*), count(rank), coalesce(1.0::DOUBLE / min(rank), 0) FROM rg GROUP BY ALL),
        m AS (SELECT what || '_recall' AS metric, retriever, sum(f)::DOUBLE / sum(n) AS v FROM q GROUP BY ALL UNION ALL SELECT what || '_mrr', retriever, avg(rr) FROM q GROUP BY what, retriever), p AS (SELECT metric, max(v) FILTER (WHERE retriever = 'word') AS base, max(v) FILTER (WHERE retriever = 'hybrid') AS other FROM m GROUP BY 1)
        SELECT metric, round(base, 9) AS base, round(other, 9) AS other, round(other - base, 9) AS delta FROM p""",
}
