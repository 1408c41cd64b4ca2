"""Search channels for many queries at once: words, terms, lines, fixed strings, symbols, relations, locations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcelore.functions.text import identifiers, lines, terms
from sourcelore.operators.automaton import lines_with, strings_in
from sourcelore.operators.scoring import LEAST_IDF, best_sums
from sourcelore.storage import durable

PER_FILE = 2


def _ranked(rows: DataFrame, by: list, order: list, name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def query_terms(queries: DataFrame, distinct: bool = False, most: int | None = None) -> DataFrame:
    """``(query_id, term, times)``: how often a query asks for a term; optionally only its first distinct ones, once each."""
    found = F.array_distinct(terms("query")) if distinct else terms("query")
    found = F.slice(found, 1, most) if most else found
    return queries.select("query_id", F.explode(found).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


MOST_BROADCAST = 200_000


def _meet(dealt: DataFrame, asked: DataFrame, key: str | list[str]) -> DataFrame:
    """An equi-join of exploded rows with what is asked. Spark's estimate doesn't see the explode and may take the large side for
    small: what is asked is broadcast if it is counted to be small, else both sides are shuffled."""
    small = asked.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    return dealt.join(F.broadcast(asked), key) if small else dealt.hint("merge").join(asked, key)


_PLACE = ["chunk_id", "repository", "snapshot_id", "path", "start_line", "end_line"]


def tokenized(chunks: DataFrame) -> DataFrame:
    """The chunks' places with their terms in place of the text, stored: they are read for statistics and for scores."""
    return durable(chunks.select(*_PLACE, terms("content").alias("tokens")).withColumn("size", F.size("tokens")), "tokens")


def cut_hits(hits: DataFrame, top_k: int) -> DataFrame:
    """The first 5k hits, then at most two of a file, then k."""
    order = [F.desc("score"), "path", "start_line", "chunk_id"]
    hits = _ranked(hits, ["query_id"], order, "n").where(F.col("n") <= 5 * top_k)
    hits = _ranked(hits, ["query_id", "snapshot_id", "path"], ["n"], "in_file").where(F.col("in_file") <= PER_FILE)
    return _ranked(hits, ["query_id"], ["n"]).where(F.col("rank") <= top_k).drop("n", "in_file")


def inverse_frequency(chunks: str = "chunks", n: str = "n") -> Column:
    return F.greatest(F.log((F.col(chunks) - F.col(n) + 0.5) / (F.col(n) + 0.5)), F.lit(LEAST_IDF))


def bm25(chunks: DataFrame, queries: DataFrame, top_k: int = 10, scope: DataFrame | None = None) -> DataFrame:
    """Word search: any term, best first by BM25 (k1 1.2, b 0.75); repeated query terms count as often as they stand.

    Corpus statistics cover all of ``chunks``; ``scope`` (``snapshot_id``) narrows the hits only. A chunk is scored where it lies,
    and only what may be among a query's first 5k leaves its task (see ``scoring``).
    """
    wanted, own = durable(query_terms(queries), "wanted"), tokenized(chunks)
    whole = own.agg(F.count("*").alias("chunks"), F.avg("size").alias("average")).first()  # one row
    frequency = _meet(own.select(F.explode(F.array_distinct("tokens")).alias("term")), wanted.select("term").distinct(), "term").groupBy("term").agg(F.count("*").alias("n"))
    weights = wanted.join(frequency.withColumn("chunks", F.lit(whole["chunks"])), "term").select("query_id", "term", (F.col("times") * inverse_frequency()).alias("weight"))
    inside = own if scope is None else own.join(scope.select("snapshot_id").distinct(), "snapshot_id", "left_semi")
    return cut_hits(best_sums(inside, weights, 5 * top_k, whole["average"] or 1.0).withColumn("score", F.round("score", 9)), top_k)


def term_frequency(chunks: DataFrame, queries: DataFrame, top_k: int = 10, most_terms: int = 32) -> DataFrame:
    """Word search by plain frequency: distinct terms, 32 at most, a tenth for each time one is found."""
    wanted = query_terms(queries, distinct=True, most=most_terms).select("query_id", "term", F.lit(1.0).alias("weight"))
    return cut_hits(best_sums(tokenized(chunks), wanted, 5 * top_k).withColumn("score", F.round(F.col("score") * 0.1, 6)), top_k)


def line_matches(files: DataFrame, queries: DataFrame, top_k: int = 10, scope: DataFrame | None = None) -> DataFrame:
    """Lines that hold a query's terms (its first 32): ``(query_id, repository, snapshot_id, path, line, score, n)``, best files
    first. ``scope(snapshot_id)`` narrows the files; a listing has each path once.

    A file scores the number of its matches; a line ranks within its file by its place among the matches. Files are scored where they
    lie (see ``scoring``), and only those are cut into lines that can have one among a query's first 5k: a file of score s has s / 32
    lines at least.
    """
    most_terms, first = 32, 5 * top_k
    files = files if scope is None else files.join(scope.select("snapshot_id").distinct(), "snapshot_id", "left_semi")
    wanted = durable(query_terms(queries, distinct=True, most=most_terms).select("query_id", "term", F.lit(1.0).alias("weight")), "wanted")
    words = F.flatten(F.transform(lines("text"), lambda line: F.array_distinct(terms(line))))
    scored = best_sums(files.select("repository", "snapshot_id", "path", words.alias("tokens"), F.lit(0).alias("size")), wanted, first).withColumn("score", F.round("score").cast("long"))
    upto = Window.partitionBy("query_id").orderBy(F.desc("score"), "repository", "path").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy("query_id", "score", "repository", "path")
    least = F.ceil(F.col("score") / most_terms)
    chosen = scored.withColumn("before", F.sum(least).over(upto) - F.sum(least).over(same)).where(F.col("before") < first).drop("before")
    chosen = durable(chosen.join(wanted.groupBy("query_id").agg(F.collect_list("term").alias("asked")), "query_id"), "chosen")
    small = chosen.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    own = files.select("repository", "snapshot_id", "path", "text").join(F.broadcast(chosen) if small else chosen, ["repository", "snapshot_id", "path"])
    at = F.transform(lines("text"), lambda line, i: F.struct((i + 1).alias("line"), F.size(F.array_intersect(terms(line), "asked")).alias("found")))
    found = own.select("query_id", "repository", "snapshot_id", "path", "score", F.explode(F.filter(at, lambda x: x["found"] > 0)).alias("at"))
    return _ranked(found.select("query_id", "repository", "snapshot_id", "path", "at.line", "score"), ["query_id"], [F.desc("score"), "repository", "path", "line"], "n").where(F.col("n") <= first)


def passage_matches(texts: DataFrame, passages: DataFrame) -> DataFrame:
    """``texts(body, ...)`` with each row of ``passages(passage, ...)`` whose passage its body holds verbatim.

    A passage of five words or more holds some of its words whole, which any body that holds it has side by side: row
    numbers and passages meet by three of them, and only then by the bodies. Shorter passages are found by an
    automaton, line by line, as far as they don't cross lines.
    """
    words = F.split("passage", r"\s+")
    three = lambda w, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    long = passages.withColumn("__words", words).where(F.size("__words") >= 5).withColumn("__key", three(F.col("__words"), F.lit(1))).drop("__words")
    own = durable(texts.withColumn("__row", F.monotonically_increasing_id()), "texts")  # a row's number must outlive its task
    cut = own.select("__row", F.split("body", r"\s+").alias("__words"))
    starts = F.when(F.size("__words") >= 3, F.sequence(F.lit(0), F.size("__words") - 3)).otherwise(F.array().cast("array<int>"))
    dealt = cut.select("__row", F.explode(F.array_distinct(F.transform(starts, lambda i: three(F.col("__words"), i)))).alias("__key"))
    met = durable(_meet(dealt, long, "__key").drop("__key"), "met")
    few = met.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    found = own.join(F.broadcast(met) if few else met, "__row").where(F.contains("body", "passage")).drop("__row")
    short = passages.where(F.size(words) < 5)
    if short.isEmpty():
        return found
    near = strings_in(own.select("__row", F.explode(F.split("body", "\n")).alias("body")), short.select(F.col("passage").alias("term")))
    near = near.select("__row", F.col("term").alias("passage")).distinct()
    return found.unionByName(own.join(near, "__row").drop("__row").join(short, "passage").select(*found.columns))


def fixed_strings(files: DataFrame, queries: DataFrame, top_k: int = 10, per_file: int = 20, most_hits: int = 2_000, samples: int = 8) -> DataFrame:
    """The baseline: case-sensitive substrings, ``queries(query_id, query_terms)``; a file scores 100 for each distinct term
    and 1 for each hit up to 50. At most 20 lines of a file and 2,000 of a term count; ``truncated_terms`` says how many of
    the query's terms had more. ``hits`` are the file's first 8 by line and term. One pass finds all terms (see ``automaton``)."""
    wanted = queries.select("query_id", F.explode(F.array_distinct("query_terms")).alias("term")).where(F.char_length("term").between(1, 128))
    found = lines_with(files, wanted, per_file, most_hits + 1)
    by_path = Window.partitionBy("term").orderBy("path")
    found = found.withColumn("__n", F.row_number().over(by_path)).where(F.col("__n") <= most_hits + 1).drop("__n")  # a line each at least
    found = found.withColumn("before", F.coalesce(F.sum(F.size("at")).over(by_path.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    found = durable(found.where(F.col("before") <= most_hits), "found")
    cut = found.where(F.col("before") + F.size("at") > most_hits).select("term").distinct().join(wanted, "term").groupBy("query_id").agg(F.count("*").alias("truncated_terms"))
    found = found.select("term", "path", F.transform(F.slice("at", 1, (most_hits - F.col("before")).cast("int")), lambda line: line + 1).alias("at")).where(F.size("at") > 0)
    scored = found.join(wanted, "term").groupBy("query_id", "path").agg(F.count("*").alias("matched_terms"), F.sum(F.size("at")).alias("hit_count"))
    scored = scored.withColumn("score", F.col("matched_terms") * 100 + F.least("hit_count", F.lit(50)))
    best = durable(_ranked(scored, ["query_id"], [F.desc("score"), "path"]).where(F.col("rank") <= top_k), "best")
    # the places of the best files only
    places = F.flatten(F.collect_list(F.transform("at", lambda line: F.struct(line.alias("line"), F.col("term").alias("term")))))
    shown = best.select("query_id", "path").join(wanted, "query_id").join(found, ["term", "path"]).groupBy("query_id", "path").agg(F.slice(F.array_sort(places), 1, samples).alias("hits"))
    return best.join(shown, ["query_id", "path"]).join(cut, "query_id", "left").withColumn("truncated_terms", F.coalesce("truncated_terms", F.lit(0).cast("long")))


def query_names(queries: DataFrame) -> DataFrame:
    """``(query_id, name, name_order)``: the identifiers of each query in their order."""
    return queries.select("query_id", F.posexplode(identifiers("query")).alias("name_order", "name"))


def line_buckets(start: str, end: str, bucket: int) -> Column:
    """The buckets of ``bucket`` lines that lines start to end touch."""
    return F.sequence(F.floor(F.col(start) / bucket), F.floor(F.greatest(start, end) / bucket))


def overlapping(spans: DataFrame, chunks: DataFrame, bucket: int = 64) -> DataFrame:
    """Spans (``file_id, start_line, end_line`` and more) with the chunks of their file that they touch.

    Both are laid out to buckets of lines, so that they meet by file and bucket, however many chunks the file has; a pair
    counts in the bucket where the later of the two starts.
    """
    own = chunks.withColumnsRenamed({"start_line": "chunk_start", "end_line": "chunk_end", "kind": "chunk_kind"})
    own = own.withColumn("__bucket", F.explode(line_buckets("chunk_start", "chunk_end", bucket)))
    s = spans.withColumn("__bucket", F.explode(line_buckets("start_line", "end_line", bucket)))
    both = s.join(own, ["file_id", "__bucket"]).where((F.col("chunk_start") <= F.col("end_line")) & (F.col("chunk_end") >= F.col("start_line")))
    return both.where(F.col("__bucket") == F.floor(F.greatest("chunk_start", "start_line") / bucket)).drop("__bucket")


def _first_of_chunk(rows: DataFrame, order: list, top_k: int) -> DataFrame:
    rows = _ranked(rows, ["query_id", "chunk_id"], order, "__first").where("__first = 1").drop("__first")
    return _ranked(rows, ["query_id"], order).where(F.col("rank") <= top_k)


def _names_once(names: DataFrame) -> DataFrame:
    """A name that a query has more than once counts where it stands first."""
    return names.groupBy("query_id", "name").agg(F.min("name_order").alias("name_order"))


def symbol_hits(names: DataFrame, symbols: DataFrame, occurrences: DataFrame, chunks: DataFrame, top_k: int = 20) -> DataFrame:
    """Exact symbols: per name its first 3k places (definitions, declarations, other), then by name; one row a chunk.

    A name's places are found once, however many queries ask for it."""
    names = _names_once(names)
    found = names.select("name").distinct().join(symbols.select(F.col("id").alias("logical_symbol_id"), "name"), "name").join(occurrences.select("logical_symbol_id", "role", "file_id", "start_line", "end_line"), "logical_symbol_id")
    found = overlapping(found, chunks.select("chunk_id", "file_id", "path", "repository", "snapshot_id", "start_line", "end_line"))
    role = F.when(F.col("role") == "definition", 0).when(F.col("role") == "declaration", 1).otherwise(2)
    found = _ranked(found, ["name"], [role, "path", "start_line", "chunk_id"], "of_name").where(F.col("of_name") <= min(3 * top_k, 100))
    found = durable(found, "of_name").join(names, "name")
    return _first_of_chunk(found, ["name_order", F.when(F.col("role") == "definition", 0).otherwise(1), "path", "start_line", "chunk_id"], top_k)


#: A query's first names that are looked up before the others, and relations of a name for each chunk of its first (Spark prunes ranks by task up to 1,000).
FIRST_NAMES, MOST_RELATIONS, MOST_RANKED = (1, 16), 64, 1_000


def relation_hits(names: DataFrame, symbols: DataFrame, relations: DataFrame, chunks: DataFrame, top_k: int = 20) -> DataFrame:
    """Relations whose source, target or text has one of the names: one equi-join of what they may be found by; never an OR join.

    Hits are ordered by the name's place in the query first, so a query that has k chunks by its first names needs no others: names are
    looked up by their place, in rounds, for the queries that still lack chunks. A name's first k chunks are found once, however many
    queries ask for it, and are enough: where a query's earlier names have t < k chunks, at most t of these k are among them,
    so that k - t others are left.
    """
    order = ["name_order", "inexact", "path", "start_line", "relation_id", "chunk_id"]
    left = durable(_names_once(names).withColumn("place", F.rank().over(Window.partitionBy("query_id").orderBy("name_order"))), "names")
    out = None
    for upto in (*FIRST_NAMES, None):
        asked = left if upto is None else left.where(F.col("place") <= upto)
        found = _relations_of(asked.select("name").distinct(), symbols, relations, chunks, top_k)
        hits = durable(_first_of_chunk(found.join(asked.drop("place"), "name"), order, top_k).drop("inexact", "name"), "hits")
        unread = left.where(F.lit(False)) if upto is None else left.where(F.col("place") > upto)
        full = hits.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= top_k)
        lacking = durable(unread.select("query_id").distinct().join(full, "query_id", "left_anti"), "lacking")
        last = lacking.isEmpty()
        hits = hits if last else hits.join(lacking, "query_id", "left_anti")
        out = hits if out is None else out.unionByName(hits)
        if last:
            return out
        left = durable(left.join(lacking, "query_id", "left_semi"), "names")


def _relations_of(asked: DataFrame, symbols: DataFrame, relations: DataFrame, chunks: DataFrame, top_k: int) -> DataFrame:
    """For each of ``asked(name)`` its first k chunks by their first relation.

    Relations are cut to a name's first by path and line before they meet chunks, each task its own. What is kept is a beginning of the
    name's relations, ties included: if it has k chunks they are the first; names that have fewer are looked up again, whole.
    """
    order = ["inexact", "path", "start_line"]
    own = chunks.select("chunk_id", "file_id", "path", "repository", "snapshot_id", "start_line", "end_line")
    paths = own.select("file_id", "path").distinct()
    paths = F.broadcast(paths) if paths.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else paths
    rest = ["relation_id", "confidence", "repository", "snapshot_id", "end_line", "chunk_start", "chunk_end", "file_id"]
    key = lambda by, c: F.struct(F.lit(by).alias("by"), F.col(c).alias("key"))
    other = F.when(~F.col("target_symbol_id").eqNullSafe(F.col("source_symbol_id")), F.col("target_symbol_id")).alias("target_symbol_id")
    rel = relations.select(F.col("id").alias("relation_id"), F.col("source_file_id").alias("file_id"), "source_symbol_id", other, "target_text", "start_line", "end_line", F.when(F.col("confidence") == "source_exact", 0).otherwise(1).alias("inexact"), "confidence")
    told = F.inline(F.array(key(0, "source_symbol_id"), key(0, "target_symbol_id"), key(1, "target_text")))  # no function of arrays, which Spark would interpret row by row
    rel = rel.select("relation_id", "file_id", told, "start_line", "end_line", "inexact", "confidence").where("key is not null")
    out, most = None, min(MOST_RELATIONS * top_k, MOST_RANKED)
    while True:
        keys = symbols.join(asked, "name", "left_semi").select(F.lit(0).alias("by"), F.col("id").alias("key"), "name").union(asked.select(F.lit(1).alias("by"), F.col("name").alias("key"), "name"))
        met = _meet(rel, durable(keys, "keys"), ["by", "key"]).drop("by", "key")
        if most:
            met = met.join(paths, "file_id").withColumn("__at", F.rank().over(Window.partitionBy("name").orderBy(*order))).where(F.col("__at") <= most).drop("__at", "path")
            met = durable(met, "met")
        found = overlapping(met, own).groupBy("name", "chunk_id").agg(F.min(F.struct(*order, *rest)).alias("first")).select("name", "chunk_id", "first.*")
        found = durable(_ranked(found, ["name"], [*order, "relation_id", "chunk_id"], "of_name").where(F.col("of_name") <= top_k).drop("of_name"), "of_name")
        if not most:
            return found if out is None else out.unionByName(found)
        cut = met.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") >= most)
        full = found.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") >= top_k)
        asked = durable(cut.join(full, "name", "left_anti").select("name"), "asked")
        if asked.isEmpty():
            return found
        out, most = found.join(asked, "name", "left_anti"), None


def location_chunks(locations: DataFrame, chunks: DataFrame, top_k: int = 10) -> DataFrame:
    """``locations(query_id, repository, snapshot_id, path, line, n)`` to chunks: the narrowest around the line; a chunk
    counts for its first location; k by the locations' order."""
    own = chunks.select("chunk_id", "repository", "snapshot_id", "path", "start_line", "end_line", "ordinal")
    own = own.withColumn("__bucket", F.explode(line_buckets("start_line", "end_line", 64)))
    found = locations.withColumn("__bucket", F.floor(F.col("line") / 64)).join(own, ["repository", "snapshot_id", "path", "__bucket"]).where("line between start_line and end_line").drop("__bucket")
    found = _ranked(found, ["query_id", "n"], [F.col("end_line") - F.col("start_line"), "ordinal"], "narrow").where("narrow = 1").drop("narrow", "ordinal")
    return _first_of_chunk(found, ["n"], top_k)


def context_of(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """One chunk for each request ``(query_id, repository, snapshot_id, path, line)``. Paths that leave the tree and
    lines under 1 find nothing."""
    good = (F.col("line") >= 1) & ~F.startswith("path", F.lit("/")) & ~F.array_contains(F.split("path", "/"), "..")
    return location_chunks(requests.where(good).withColumn("n", F.lit(1)), chunks, 1)


def symbol_report(names: DataFrame, symbols: DataFrame, occurrences: DataFrame, relations: DataFrame, files: DataFrame, top_k: int = 20) -> tuple[DataFrame, DataFrame]:
    """For ``names(name)``: occurrences by repository, path, line; and relations that have the name as source, target or text."""
    if not 1 <= top_k <= 200:
        raise ValueError("top_k must be between 1 and 200")
    at = files.select(F.col("id").alias("file_id"), "repository", "path")
    ids = symbols.select(F.col("id").alias("logical_symbol_id"), "name")
    found = names.join(ids, "name").join(occurrences, "logical_symbol_id").join(at, "file_id")
    found = _ranked(found, ["name"], ["repository", "path", "start_line", "logical_symbol_id", "role"]).where(F.col("rank") <= top_k)
    sides = [F.col("source_symbol_id"), F.col("target_symbol_id")]
    hits = [relations.join(names.join(ids, "name"), side == F.col("logical_symbol_id")).select("name", F.col("id").alias("relation_id")) for side in sides]
    hits.append(relations.join(names, F.col("target_text") == F.col("name")).select("name", F.col("id").alias("relation_id")))
    details = relations.select(F.col("id").alias("relation_id"), "source_file_id", "kind", "start_line")
    own = hits[0].union(hits[1]).union(hits[2]).distinct().join(details, "relation_id")
    own = own.join(at, own["source_file_id"] == at["file_id"], "left")
    return found, _ranked(own, ["name"], ["repository", "path", "start_line", F.col("kind"), "relation_id"]).where(F.col("rank") <= top_k)
