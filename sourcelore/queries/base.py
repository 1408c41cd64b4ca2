"""Queries over trees, texts, ids and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourcelore import adapters as A
from sourcelore.functions import ids, text
from sourcelore.operators import chunks as C
from sourcelore.sources import tree as T

FILES = "files AS (SELECT source AS repository, lang || '/' || doc_id || '.txt' AS path, doc_id, lang, text FROM documents)"
N_LINES = "(CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - (CASE WHEN right(text, 1) = chr(10) THEN 1 ELSE 0 END) END)"


def stable(prefix: str, *parts: str) -> str:
    return f"'{prefix}_' || substr(sha256({' || chr(0) || '.join(parts)}), 1, 24)"


SNAPSHOT = stable("snapshot", "repository", "'r1'")
#: DuckDB: the chunks of the tree.
CHUNKS = f"""{FILES},
    counted AS (SELECT *, string_split(text, chr(10)) AS ls, {N_LINES}::INTEGER AS n, {SNAPSHOT} AS snapshot_id FROM files),
    identified AS (SELECT *, {stable("file", "snapshot_id", "path")} AS file_id FROM counted),
    dealt AS (SELECT *, unnest(generate_series(0, greatest(0, n - {A.CHUNK_OVERLAP} - 1), {A.CHUNK_LINES - A.CHUNK_OVERLAP})) AS s FROM identified WHERE n > 0),
    cut AS (SELECT repository, snapshot_id, file_id, path, doc_id, sha256(text) AS blob_id, (s // {A.CHUNK_LINES - A.CHUNK_OVERLAP})::INTEGER AS ordinal, (s + 1)::INTEGER AS start_line, least(s + {A.CHUNK_LINES}, n)::INTEGER AS end_line,
        array_to_string(list_slice(ls, s + 1, least(s + {A.CHUNK_LINES}, n)), chr(10)) || (CASE WHEN least(s + {A.CHUNK_LINES}, n) < len(ls) THEN chr(10) ELSE '' END) AS content FROM dealt),
    hashed AS (SELECT *, sha256(content) AS content_hash FROM cut),
    chunks AS (SELECT *, {stable("chunk", "file_id", "ordinal::VARCHAR", "start_line::VARCHAR", "end_line::VARCHAR", "content_hash")} AS chunk_id FROM hashed)"""


def src1_tree(spark, d):
    """Files of all repositories; a listing has each path once."""
    return A.tree(spark, d).select("repository", "path", F.octet_length("content").cast("long").alias("size_bytes"))


def fil1_roots(spark, d):
    return A.tree(spark, d).where(T.under_roots("path", ["en", "de/1.txt", "fr/"])).select("repository", "path")


def fil2_globs(spark, d):
    return A.tree(spark, d).where(~T.excluded("path", ["e?/*1*", "*/[0-4]*.txt", "fr/"])).select("repository", "path")


def fil3_size(spark, d):
    return T.scan_counts(A.tree(spark, d), ["."], [], most_bytes=2000)


def fil4_first_files(spark, d):
    return T.first_files(A.tree(spark, d), 5).select("repository", "path")


_NAMES = ["a.c", "a.H", "a.S", "a.s", "b.rs", "c.py", "R.MD", "x.bin", "Makefile", "Kbuild", "Kconfig", "Makefile.build", "kconfig.x", "noext", ".c", "y.yml"]
_EXPECT = ["c", "c-header", "assembly-preprocessed", "assembly", "rust", "python", "markdown", None, "kbuild", "kbuild", "kconfig", "kbuild", "kconfig", None, None, "yaml"]


def prj1_language(spark, d):
    names = F.array(*[F.lit(n) for n in _NAMES])
    paths = A.table(spark, d, "part").select("p_partkey", F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("/"), F.get(names, (F.col("p_partkey") % 16).cast("int"))).alias("path"))
    return paths.select("p_partkey", T.language("path").alias("language"))


def prj2_decode(spark, d):
    """Half of the texts get a byte that no UTF-8 has."""
    content = F.when(F.col("doc_id") % 2 == 0, F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FF")))).otherwise(F.col("text").cast("binary"))
    docs = A.table(spark, d, "documents").select("doc_id", content.alias("content"))
    return docs.select("doc_id", text.decode_status("content").alias("decode_status"), F.sha2(text.decoded("content"), 256).alias("text_hash"))


def prj3_lines(spark, d):
    return A.table(spark, d, "documents").select("doc_id", F.size(text.lines("text")).alias("line_count"), F.char_length(F.get(text.lines("text"), 0)).alias("first_length"))


def prj4_blobs(spark, d):
    """Distinct contents with their first path."""
    return A.tree(spark, d).groupBy(F.sha2("content", 256).alias("blob_id")).agg(F.min(F.octet_length("content").cast("long")).alias("size_bytes"), F.count("*").alias("files"))


def prj5_stable_ids(spark, d):
    return A.tree(spark, d).select("path", ids.stable_id("snapshot", "repository", F.lit("r1")).alias("snapshot_id"), ids.stable_id("file", "repository", "path", F.lit(None)).alias("file_id"))


def prj6_evidence_ids(spark, d):
    return A.table(spark, d, "part").select("p_partkey", ids.evidence_id("evidence", repository="p_brand", path="p_name", line="p_partkey").alias("evidence_id"))


def prj7_citations(spark, d):
    return A.chunks(spark, d).select("chunk_id", ids.citation("repository", "revision", "path", "start_line", "end_line").alias("citation"))


def prj8_cut_content(spark, d):
    return A.table(spark, d, "documents").select("doc_id", F.sha2(text.cut_content("text"), 256).alias("content_hash"), text.is_cut("text").alias("content_truncated"))


def prj9_cited_lines(spark, d):
    return A.table(spark, d, "documents").select("doc_id", F.sha2(text.line_range("text", F.lit(2), F.lit(4)), 256).alias("content_hash"))


def prj10_identifiers(spark, d):
    return A.table(spark, d, "conversations").select("conv_id", "turn", F.array_join(text.identifiers("text"), " ").alias("names"))


def prj11_normalized(spark, d):
    raw = F.concat(F.lit("  \t"), F.replace("text", F.lit(" "), F.lit(" \n  ")), F.lit(" "))
    return A.table(spark, d, "conversations").select("conv_id", "turn", text.normalized_query(raw).alias("query"))


def prj11_rejects(spark, d):
    """Turns of which every third is white space only: what is asked, and what is rejected."""
    asked = A.table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.when(F.col("turn") % 3 == 1, " \t\n").otherwise(F.col("text")).alias("query"))
    good, bad = text.checked_queries(asked, 10)
    return good.select("query_id", F.lit("asked").alias("outcome")).union(bad)


def prj12_semantic_document(spark, d):
    return A.chunks(spark, d).select("chunk_id", F.sha2(text.semantic_document("path", "start_line", "end_line", "kind", "symbol", "content"), 256).alias("document_hash"))


def chk1_windows(spark, d):
    return A.chunks(spark, d).select("repository", "path", "ordinal", "start_line", "end_line", "content_hash")


def chk3_parts(spark, d):
    """Texts of over eight lines as parts."""
    docs = A.table(spark, d, "documents").select("doc_id", F.lit("function").alias("kind"), F.lit(11).alias("start_line"), (F.size(text.lines("text")) + 10).alias("end_line"), F.col("text").alias("content"))
    return C.split_large(docs, 8, 3).select("doc_id", "kind", "start_line", "end_line", F.sha2("content", 256).alias("content_hash"))


def chk4_symbols(spark, d):
    """Rendered code of each kind has its known name."""
    code = {
        "macro": "concat('/* m */\n#define ', name, '(x) (x + 1)\n')",
        "function": "concat('static int ', name, '(void)\n{ return other(1); }\n')",
        "type": "concat('typedef struct { int a; } ', name, ';\n')",
        "declaration": "concat('extern unsigned int ', name, '_v;\n')",
        "macro_invocation": "concat('MODULE_', name, '(\"GPL\");\n')",
    }
    parts = A.table(spark, d, "part").select("p_partkey", F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string")).alias("name"))
    rows = parts.selectExpr("p_partkey", "stack({}, {}) as (kind, content)".format(len(code), ", ".join(f"'{k}', {v}" for k, v in code.items())))
    return rows.select("p_partkey", "kind", C.symbol("kind", "content").alias("symbol"))


def chk5_chunk_rows(spark, d):
    return A.chunks(spark, d).select("chunk_id", "file_id", "ordinal", "generator")


def agg1_manifest(spark, d):
    return T.manifest(T.scan(A.tree(spark, d)))


def agg7_basenames(spark, d):
    paths = A.table(spark, d, "documents").select(F.concat("source", F.lit("/"), "lang", F.lit("/f"), (F.col("doc_id") % 13).cast("string"), F.lit(".txt")).alias("path"))
    return T.basename_index(paths)


QUERIES = {f.__name__: f for f in (
    src1_tree, fil1_roots, fil2_globs, fil3_size, fil4_first_files, prj1_language, prj2_decode, prj3_lines, prj4_blobs, prj5_stable_ids, prj6_evidence_ids, prj7_citations,
    prj8_cut_content, prj9_cited_lines, prj10_identifiers, prj11_normalized, prj11_rejects, prj12_semantic_document, chk1_windows, chk3_parts, chk4_symbols, chk5_chunk_rows, agg1_manifest, agg7_basenames,
)}

ORACLES = {
    "src1_tree": f"WITH {FILES} SELECT repository, path, max(strlen(text))::BIGINT AS size_bytes FROM files GROUP BY ALL",
    "fil1_roots": f"WITH {FILES} SELECT repository, path FROM files WHERE lang IN ('en', 'fr') OR path = 'de/1.txt'",
    "fil2_globs": f"WITH {FILES} SELECT repository, path FROM files WHERE NOT (regexp_matches(path, '^e./.*1') OR regexp_matches(path, '/[0-4].*\\.txt$') OR lang = 'fr')",
    "fil3_size": f"WITH {FILES} SELECT repository, count_if(strlen(text) <= 2000)::BIGINT AS file_count, count_if(strlen(text) > 2000)::BIGINT AS skipped_file_count, coalesce(sum(CASE WHEN strlen(text) <= 2000 THEN strlen(text) END), 0)::BIGINT AS byte_count FROM files GROUP BY repository",
    "fil4_first_files": f"WITH {FILES} SELECT repository, path FROM files QUALIFY row_number() OVER (PARTITION BY repository ORDER BY lang, doc_id || '.txt') <= 5",
    "prj1_language": "SELECT p_partkey, CASE p_partkey % 16 {} END AS language FROM part".format(" ".join(f"WHEN {i} THEN " + (f"'{x}'" if x else "NULL") for i, x in enumerate(_EXPECT))),
    "prj2_decode": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'replacement' ELSE 'utf8' END AS decode_status, sha256(text || CASE WHEN doc_id % 2 = 0 THEN chr(65533) ELSE '' END) AS text_hash FROM documents",
    "prj3_lines": f"SELECT doc_id, {N_LINES}::INTEGER AS line_count, (CASE WHEN text = '' THEN NULL ELSE length(string_split(text, chr(10))[1]) + (CASE WHEN position(chr(10) IN text) > 0 THEN 1 ELSE 0 END) END)::INTEGER AS first_length FROM documents",
    "prj4_blobs": "SELECT sha256(text) AS blob_id, min(strlen(text))::BIGINT AS size_bytes, count(*)::BIGINT AS files FROM documents GROUP BY 1",
    "prj5_stable_ids": f"WITH {FILES} SELECT path, {SNAPSHOT} AS snapshot_id, {stable('file', 'repository', 'path', chr(39) * 2)} AS file_id FROM files",
    "prj6_evidence_ids": """SELECT p_partkey, 'evidence_' || substr(sha256('{"line":"' || p_partkey || '","path":"' || p_name || '","repository":"' || p_brand || '"}'), 1, 24) AS evidence_id FROM part""",
    "prj7_citations": f"WITH {CHUNKS} SELECT chunk_id, repository || '@r1:' || path || ':' || start_line || '-' || end_line AS citation FROM chunks",
    "prj8_cut_content": "SELECT doc_id, sha256(CASE WHEN length(text) > 1600 THEN regexp_replace(substr(text, 1, 1600), '\\s+$', '') || chr(10) || '…' ELSE text END) AS content_hash, length(text) > 1600 AS content_truncated FROM documents",
    "prj9_cited_lines": f"WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls, {N_LINES} AS n FROM documents) SELECT doc_id, sha256(CASE WHEN n < 2 THEN '' ELSE array_to_string(list_slice(ls, 2, least(4, n)), chr(10)) || (CASE WHEN least(4, n) < len(ls) THEN chr(10) ELSE '' END) END) AS content_hash FROM l",
    "prj10_identifiers": """
        WITH w AS (SELECT conv_id, turn, regexp_extract_all(text, '[\\p{L}\\p{N}_]+') AS ws FROM conversations),
        e AS (SELECT conv_id, turn, unnest(ws) AS t, generate_subscripts(ws, 1) AS pos FROM w),
        f AS (SELECT conv_id, turn, t, min(pos) AS pos FROM e WHERE regexp_full_match(t, '[A-Za-z_][A-Za-z0-9_]*') GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS n FROM f)
        SELECT w.conv_id, w.turn, coalesce(string_agg(t, ' ' ORDER BY pos) FILTER (WHERE n <= 16), '') AS names FROM w LEFT JOIN r ON w.conv_id = r.conv_id AND w.turn = r.turn GROUP BY ALL""",
    "prj11_rejects": "SELECT conv_id || '-' || turn AS query_id, CASE WHEN turn % 3 = 1 OR trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN 'empty_query' ELSE 'asked' END AS outcome FROM conversations",
    "prj11_normalized": "SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS query FROM conversations",
    "prj12_semantic_document": f"WITH {CHUNKS} SELECT chunk_id, sha256('File: ' || path || chr(10) || 'Lines: ' || start_line || '-' || end_line || chr(10) || 'Kind: line_window' || chr(10) || 'Symbol: (none)' || chr(10) || 'Content:' || chr(10) || content) AS document_hash FROM chunks",
    "chk1_windows": f"WITH {CHUNKS} SELECT repository, path, ordinal, start_line, end_line, content_hash FROM chunks",
    "chk3_parts": f"""
        WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls, {N_LINES}::INTEGER AS n FROM documents),
        w AS (SELECT *, unnest(generate_series(0, greatest(0, n - 4), 5)) AS s FROM l WHERE n > 8)
        SELECT doc_id, 'function_part' AS kind, (s + 11)::INTEGER AS start_line, (least(s + 8, n) + 10)::INTEGER AS end_line,
               sha256(array_to_string(list_slice(ls, s + 1, least(s + 8, n)), chr(10)) || (CASE WHEN least(s + 8, n) < len(ls) THEN chr(10) ELSE '' END)) AS content_hash FROM w
        UNION ALL SELECT doc_id, 'function', 11, n + 10, sha256(text) FROM l WHERE n <= 8""",
    "chk4_symbols": """
        WITH p AS (SELECT p_partkey, replace(p_name, ' ', '_') || '_' || p_partkey AS name FROM part)
        SELECT p_partkey, kind, CASE kind WHEN 'declaration' THEN name || '_v' WHEN 'macro_invocation' THEN 'MODULE_' || name ELSE name END AS symbol
        FROM p, (SELECT unnest(['macro', 'function', 'type', 'declaration', 'macro_invocation']) AS kind) k""",
    "chk5_chunk_rows": f"WITH {CHUNKS} SELECT chunk_id, file_id, ordinal, 'line-window-v1' AS generator FROM chunks",
    "agg1_manifest": f"WITH {FILES} SELECT repository, sha256(string_agg(path || chr(0) || sha256(text) || chr(0) || strlen(text) || chr(10), '' ORDER BY path)) AS manifest_digest, count(*)::BIGINT AS file_count, sum(strlen(text))::BIGINT AS byte_count FROM files GROUP BY repository",
    "agg7_basenames": "WITH p AS (SELECT DISTINCT source || '/' || lang || '/f' || (doc_id % 13) || '.txt' AS path, 'f' || (doc_id % 13) || '.txt' AS basename FROM documents) SELECT basename, path FROM p",
}
