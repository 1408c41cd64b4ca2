"""The numbered queries: thin digests of the operators' results over the whole tables, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelore.llm import collocations, html, lines, lm, mixing, packing, ranked, simhash, substrings, tokens, toxicity, vectors
from sourcelore.llm.common import id_crc_mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=4, shingle=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=400)
    return found.select("doc_id", F.col("byte_count").alias("n_bytes"), F.col("bytes_removed").alias("n_removed"), F.col("spans_removed").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = toxicity.fit(docs, labels, toxicity.training_rows())
    scored = toxicity.score(docs.select("doc_id", "text"), machine)
    return scored.select("doc_id", (id_crc_mod("doc_id", 5) == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=5, min_chars=40)
    return found.select("doc_id", F.col("line_count").alias("n_lines"), F.col("lines_dropped").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm.score(table(spark, sf_dir, "documents"), id_crc_mod("doc_id", 7) != 2)
    return found.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), capacity=2048, end_id=1)
    return pieces.select(F.col("doc").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), min_cosine=0.98)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), alpha=0.5, total=1.0, seed=42)


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), k=20)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"), min_count=10, max_words=3, within_percent=50, top=2000)
    return found.drop("words")


def op13_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokens.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_html": op2_html,
    "op3_suffixes": op3_suffixes,
    "op4_toxicity": op4_toxicity,
    "op5_nearest": op5_nearest,
    "op6_lines": op6_lines,
    "op7_lm": op7_lm,
    "op8_packing": op8_packing,
    "op9_vectors": op9_vectors,
    "op10_mixing": op10_mixing,
    "op11_ranked": op11_ranked,
    "op12_collocations": op12_collocations,
    "op13_tokens": op13_tokens,
}

_KEY = "translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_UNIFORM = "(('0x' || substr(md5({}), 1, 13))::BIGINT)::DOUBLE / 4503599627370496.0"

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = f"unnest(regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"

ORACLES = {
    "op6_lines": f"""
        WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM parts),
        keyed AS (SELECT doc_id, pos, line, {_KEY} AS k FROM lines),
        common AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
        marked AS (SELECT d.doc_id, d.pos, d.line, (c.k IS NOT NULL AND d.doc_id <> c.keeper) AS dropped FROM keyed d LEFT JOIN common c ON d.k = c.k)
        SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(dropped)::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op10_mixing": f"""
        WITH RECURSIVE size AS (SELECT source, sum(length(coalesce(text, '')))::DOUBLE AS size FROM documents GROUP BY source),
        share AS (SELECT source, size, sqrt(size) / sum(sqrt(size)) OVER () * sum(size) OVER () AS target FROM size),
        rate AS (SELECT source, CASE WHEN size > 0 THEN target / size ELSE 0.0 END AS rate FROM share),
        part AS (SELECT source, rate, greatest(1, ceil(rate / 8.0))::INTEGER AS parts FROM rate),
        cdf AS (SELECT source, 0 AS k, exp(-(rate / parts)) AS p, exp(-(rate / parts)) AS c FROM part
                UNION ALL
                SELECT f.source, f.k + 1, f.p * (t.rate / t.parts) / (f.k + 1), f.c + f.p * (t.rate / t.parts) / (f.k + 1) FROM cdf f JOIN part t ON f.source IS NOT DISTINCT FROM t.source WHERE f.k < 60),
        draw AS (SELECT d.doc_id, d.source, t.rate, {_UNIFORM.format("'42:' || d.doc_id || ':' || j.part")} AS u
                 FROM documents d JOIN part t ON d.source IS NOT DISTINCT FROM t.source, LATERAL (SELECT unnest(generate_series(1, t.parts)) AS part) j),
        times AS (SELECT w.doc_id, any_value(w.rate) AS rate, count(f.k)::INTEGER AS n FROM draw w JOIN cdf f ON w.source IS NOT DISTINCT FROM f.source AND f.c <= w.u GROUP BY w.doc_id),
        copies AS (SELECT doc_id, rate, n, unnest(generate_series(1, n))::INTEGER AS mix_copy FROM times)
        SELECT d.*, c.n AS mix_copies, c.rate AS mix_rate, c.mix_copy, {_UNIFORM.format("'42:order:' || d.doc_id || ':' || c.mix_copy")} AS mix_key
        FROM documents d JOIN copies c ON d.doc_id = c.doc_id""",
    "op11_ranked": f"""
        WITH held AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, {_TERMS} AS term FROM documents) GROUP BY ALL),
        sized AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM held GROUP BY doc_id),
        total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sized),
        asked AS (SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, {_TERMS} AS term FROM benchmark) GROUP BY ALL),
        weighed AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
                    FROM held, total WHERE term IN (SELECT term FROM asked) GROUP BY term),
        measured AS (SELECT doc_id, 75 + (25 * n * docs) // terms AS m FROM sized, total),
        scored AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
                   FROM asked JOIN weighed USING (term) JOIN held USING (term) JOIN measured USING (doc_id) GROUP BY ALL)
        SELECT item_id, rank, doc_id, score FROM
        (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0) WHERE rank <= 20""",
    "op12_collocations": f"""
        WITH pieces AS (SELECT lang, doc, unnest(ps) AS piece, generate_subscripts(ps, 1) AS p FROM
             (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc, regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]') AS ps FROM documents)),
        words AS (SELECT lang, doc, p, list_filter(regexp_split_to_array(piece, '[ \\x09]+'), lambda w: w <> '') AS ws FROM pieces),
        placed AS (SELECT lang, doc, p, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM words),
        runs AS (SELECT lang, w AS w1, lead(w) OVER own AS w2, lead(w, 2) OVER own AS w3 FROM placed WINDOW own AS (PARTITION BY doc, p ORDER BY i)),
        f1 AS (SELECT lang, w1, count(*)::HUGEINT AS a FROM runs GROUP BY ALL),
        total AS (SELECT lang, sum(a)::BIGINT AS n FROM f1 GROUP BY lang),
        f2 AS (SELECT lang, w1, w2, count(*)::HUGEINT AS a FROM runs WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
        f3 AS (SELECT lang, w1, w2, w3, count(*)::HUGEINT AS a FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
        around AS (SELECT lang, w1, w2, max(a) AS most FROM (SELECT lang, w1, w2, a FROM f3 UNION ALL SELECT lang, w2, w3, a FROM f3) GROUP BY ALL),
        cuts AS (SELECT b.lang, b.w1 || ' ' || b.w2 AS phrase, b.a, x.a AS l, y.a AS r, 1 AS k
                 FROM f2 b JOIN f1 x ON b.lang = x.lang AND b.w1 = x.w1 JOIN f1 y ON b.lang = y.lang AND b.w2 = y.w1
                 LEFT JOIN around o ON b.lang = o.lang AND b.w1 = o.w1 AND b.w2 = o.w2 WHERE o.most IS NULL OR 100 * o.most < 50 * b.a
                 UNION ALL
                 SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.a, x.a, y.a, 1
                 FROM f3 c JOIN f1 x ON c.lang = x.lang AND c.w1 = x.w1 JOIN f2 y ON c.lang = y.lang AND c.w2 = y.w1 AND c.w3 = y.w2
                 UNION ALL
                 SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.a, x.a, y.a, 2
                 FROM f3 c JOIN f2 x ON c.lang = x.lang AND c.w1 = x.w1 AND c.w2 = x.w2 JOIN f1 y ON c.lang = y.lang AND c.w3 = y.w1),
        scored AS (SELECT *, (1000000::HUGEINT * a * a) // (l * r) AS score FROM cuts),
        least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM least)
        SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000""",
}
