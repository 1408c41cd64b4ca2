"""Queries over the search channels."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourcelore import adapters as A
from sourcelore.functions.ids import stable_id
from sourcelore.functions.text import decoded, terms
from sourcelore.operators import index as W
from sourcelore.operators import search as S
from sourcelore.queries.base import CHUNKS, FILES, N_LINES, SNAPSHOT
from sourcelore.storage import durable

WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
ASKED = f"asked AS (SELECT item_id AS query_id, unnest({WORDS.format('text')}) AS term FROM benchmark)"
#: DuckDB: the first 32 distinct terms of each query.
FEW = f"few_asked AS (SELECT query_id, term FROM (SELECT query_id, term, min(pos) AS pos FROM (SELECT item_id AS query_id, unnest(ws) AS term, generate_subscripts(ws, 1) AS pos FROM (SELECT item_id, {WORDS.format('text')} AS ws FROM benchmark) w) x GROUP BY ALL) y QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pos) <= 32)"
#: DuckDB: the best hits of scored(query_id, chunk_id, score).
CUT = """met AS (SELECT s.*, c.repository, c.snapshot_id, c.path, c.start_line, c.end_line FROM scored s JOIN chunks c USING (chunk_id)),
    first AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, start_line, chunk_id) AS n FROM met QUALIFY n <= 50),
    few AS (SELECT *, row_number() OVER (PARTITION BY query_id, snapshot_id, path ORDER BY n) AS f FROM first QUALIFY f <= 2),
    top AS (SELECT query_id, chunk_id, score, repository, path, start_line, end_line, row_number() OVER (PARTITION BY query_id ORDER BY n)::INTEGER AS rank FROM few QUALIFY rank <= 10)"""
#: DuckDB: from chunks and asked to scored.
SCORED = f"""token AS (SELECT chunk_id, unnest({WORDS.format('content')}) AS term FROM chunks),
    size AS (SELECT chunk_id, len({WORDS.format('content')}) AS size FROM chunks),
    whole AS (SELECT count(*) AS chunks, avg(size) AS average FROM size),
    tf AS (SELECT chunk_id, term, count(*) AS tf FROM token WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
    idf AS (SELECT term, greatest(ln(((SELECT chunks FROM whole) - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf FROM tf GROUP BY term),
    scored AS (SELECT query_id, chunk_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / (SELECT average FROM whole)))), 9) AS score
        FROM asked JOIN tf USING (term) JOIN idf USING (term) JOIN size USING (chunk_id) GROUP BY ALL)"""
BM25 = f"{CHUNKS}, {ASKED}, {SCORED}"
TOP = ["query_id", "chunk_id", "score", "repository", "path", "start_line", "end_line", "rank"]


def files(spark, d):
    return A.tree(spark, d).select("repository", "path", stable_id("snapshot", "repository", F.lit("r1")).alias("snapshot_id"), decoded("content").alias("text"))


def lex1_index(spark, d):
    """The stored index, written in two batches: every term with its chunks and its occurrences."""
    found = A.word_index(spark, d).postings
    return found.groupBy("term").agg(F.sum("n").alias("chunks"), F.sum("times").alias("occurrences"))


def lex1_bm25(spark, d):
    """By the stored index and its bounds."""
    return W.bm25(A.word_index(spark, d), A.queries(spark, d)).select(*TOP)


def lex1_scan(spark, d):
    """The same without an index."""
    return S.bm25(A.chunk_table(spark, d), A.queries(spark, d)).select(*TOP)


def lex2_term_frequency(spark, d):
    return W.term_frequency(A.word_index(spark, d), A.queries(spark, d)).select(*TOP)


def _line_hits(spark, d):
    """The repositories of odd number are out of scope."""
    all_files = files(spark, d)
    return S.line_matches(all_files, A.queries(spark, d), scope=all_files.where("cast(substring(repository, 4) as int) % 2 = 0").select("snapshot_id"))


def lex3_lines(spark, d):
    return _line_hits(spark, d).select("query_id", "repository", "path", "line", F.col("score").cast("long").alias("score"), "n")


def lex3_chunks(spark, d):
    """The matching lines' chunks, as a channel of hits."""
    return S.location_chunks(durable(_line_hits(spark, d)), A.chunks(spark, d), 10).select("query_id", "path", "line", "chunk_id", "rank")


def fixed_queries(spark, d):
    """The distinct terms of each benchmark text, of every length."""
    return A.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_distinct(terms("text")).alias("query_terms"))


def lex4_fixed_strings(spark, d):
    return S.fixed_strings(files(spark, d), fixed_queries(spark, d)).select("query_id", "path", "matched_terms", "hit_count", "score", "rank", "truncated_terms", F.array_join(F.transform("hits", lambda h: F.concat(h["line"].cast("string"), F.lit(":"), h["term"])), " ").alias("samples"))


def locations(spark, d):
    """One line of each document, asked by document."""
    docs = A.table(spark, d, "documents").where("text <> ''")
    n = F.size(F.regexp_extract_all("text", F.lit("[^\n]*\n|[^\n]+$"), F.lit(0)))
    return docs.select((F.col("doc_id") % 50).alias("query_id"), F.col("source").alias("repository"), stable_id("snapshot", "source", F.lit("r1")).alias("snapshot_id"), F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), (F.col("doc_id") % n + 1).cast("int").alias("line"), F.col("doc_id").alias("n"))


def jon10_locations(spark, d):
    return S.location_chunks(locations(spark, d), A.chunks(spark, d), 10).select("query_id", "path", "line", "chunk_id", "rank")


def jon11_context(spark, d):
    asked = locations(spark, d).withColumn("query_id", F.col("n")).withColumn("line", F.when(F.col("n") % 9 == 0, 0).otherwise(F.col("line"))).drop("n")
    return S.context_of(asked, A.chunks(spark, d)).select("query_id", "path", "line", "chunk_id")


_AT = f"""{CHUNKS}, asked_lines AS (SELECT doc_id % 50 AS query_id, doc_id AS n, repository, snapshot_id, path, (doc_id % n + 1)::INTEGER AS line FROM (SELECT *, {N_LINES} AS n, {SNAPSHOT} AS snapshot_id FROM files WHERE text <> '') x),
    hit AS (SELECT a.*, c.chunk_id FROM asked_lines a JOIN chunks c ON a.repository = c.repository AND a.path = c.path AND a.line BETWEEN c.start_line AND c.end_line
        QUALIFY row_number() OVER (PARTITION BY a.query_id, a.n ORDER BY c.end_line - c.start_line, c.ordinal) = 1)"""

_LINE_HITS = f"""{CHUNKS}, {FEW}, l AS (SELECT repository, path, string_split(text, chr(10)) AS ls FROM files WHERE substr(repository, 4)::INTEGER % 2 = 0), n AS (SELECT repository, path, unnest(ls) AS body, generate_subscripts(ls, 1)::INTEGER AS line FROM l),
    word AS (SELECT DISTINCT repository, path, line, unnest({WORDS.format('body')}) AS term FROM n),
    m AS (SELECT query_id, repository, path, line, count(*) AS s FROM few_asked JOIN word USING (term) GROUP BY ALL),
    f AS (SELECT *, greatest(s, sum(s) OVER (PARTITION BY query_id, repository, path))::BIGINT AS score FROM m),
    line_hit AS (SELECT query_id, repository, path, line, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, repository, path, line)::INTEGER AS n FROM f QUALIFY n <= 50)"""

QUERIES = {f.__name__: f for f in (lex1_index, lex1_bm25, lex1_scan, lex2_term_frequency, lex3_lines, lex3_chunks, lex4_fixed_strings, jon10_locations, jon11_context)}
ORACLES = {
    "lex1_index": f"WITH {CHUNKS}, token AS (SELECT chunk_id, unnest({WORDS.format('content')}) AS term FROM chunks) SELECT term, count(DISTINCT chunk_id)::BIGINT AS chunks, count(*)::BIGINT AS occurrences FROM token GROUP BY term",
    "lex1_bm25": f"WITH {BM25}, {CUT} SELECT * FROM top",
    "lex1_scan": f"WITH {BM25}, {CUT} SELECT * FROM top",
    "lex2_term_frequency": f"""WITH {CHUNKS}, {FEW}, token AS (SELECT chunk_id, unnest({WORDS.format('content')}) AS term FROM chunks),
        scored AS (SELECT query_id, chunk_id, round((count(*) * 0.1)::DOUBLE, 6) AS score FROM few_asked JOIN token USING (term) GROUP BY ALL), {CUT} SELECT * FROM top""",
    "lex3_lines": f"WITH {_LINE_HITS} SELECT query_id, repository, path, line, score, n FROM line_hit",
    "lex3_chunks": f"""WITH {_LINE_HITS}, met AS (SELECT h.*, c.chunk_id FROM line_hit h JOIN chunks c ON h.repository = c.repository AND h.path = c.path AND h.line BETWEEN c.start_line AND c.end_line QUALIFY row_number() OVER (PARTITION BY h.query_id, h.n ORDER BY c.end_line - c.start_line, c.ordinal) = 1),
        one AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY n) = 1) SELECT query_id, path, line, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY n)::INTEGER AS rank FROM one QUALIFY rank <= 10""",
    "lex4_fixed_strings": f"""WITH {FILES}, words AS (SELECT item_id AS query_id, {WORDS.format('text')} AS ws FROM benchmark),
        placed AS (SELECT query_id, unnest(ws) AS term, generate_subscripts(ws, 1) AS pos FROM words), firsts AS (SELECT query_id, term, min(pos) AS pos FROM placed GROUP BY ALL),
        asked AS (SELECT query_id, term FROM firsts),
        l AS (SELECT path, string_split(text, chr(10)) AS ls FROM files), n AS (SELECT path, unnest(ls) AS body, generate_subscripts(ls, 1) AS line FROM l),
        h AS (SELECT term, path, line FROM n JOIN (SELECT DISTINCT term FROM asked) t ON contains(n.body, t.term) QUALIFY row_number() OVER (PARTITION BY term, path ORDER BY line) <= 20),
        k AS (SELECT term, path, line FROM h QUALIFY row_number() OVER (PARTITION BY term ORDER BY path, line) <= 2000),
        s AS (SELECT query_id, path, count(DISTINCT term)::BIGINT AS matched_terms, count(*)::BIGINT AS hit_count, array_to_string(list_slice(list(line || ':' || term ORDER BY line, term), 1, 8), ' ') AS samples FROM k JOIN asked USING (term) GROUP BY ALL),
        r AS (SELECT *, matched_terms * 100 + least(hit_count, 50) AS score FROM s), many AS (SELECT term FROM h GROUP BY term HAVING count(*) > 2000), over_ AS (SELECT query_id, count(*)::BIGINT AS n FROM asked JOIN many USING (term) GROUP BY 1)
        SELECT r.*, coalesce(o.n, 0) AS truncated_terms, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path)::INTEGER AS rank FROM r LEFT JOIN over_ o USING (query_id) QUALIFY rank <= 10""",
    "jon10_locations": f"WITH {_AT}, one AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY n) = 1) SELECT query_id, path, line, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY n)::INTEGER AS rank FROM one QUALIFY rank <= 10",
    "jon11_context": f"WITH {_AT} SELECT n AS query_id, path, line, chunk_id FROM hit WHERE n % 9 <> 0",
}
