"""Evidence packs: what fits a budget, symbols around it, links between repositories, gaps and ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sourcelore.functions.text import identifiers
from sourcelore.storage import durable

CHARS_PER_TOKEN, LEAST_CHARS, MOST_LINKS, MOST_CANDIDATES = 4, 64, 50, 100
#: Chosen names that are broadcast, by count; more are joined by a shuffle.
MOST_BROADCAST = 200_000


def evidence(hits: DataFrame, token_budget: int = 1_000, most_items: int = 10) -> DataFrame:
    """``hits(query_id, rank, chunk_id, content, content_truncated, ...)`` with what becomes of each: ``disposition`` (selected,
    item_budget, token_budget) and the ``content`` that is kept.

    A walk in rank order over three candidates an item, at most 100: an item too long is cut to what is left and loses the white space
    at its end, so what is left for the next follows from the cut, not from a running sum.
    """
    row = F.struct("rank", "chunk_id", "content", "content_truncated")
    walked = hits.where(F.col("rank") <= min(MOST_CANDIDATES, 3 * most_items)).groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("all"))
    # one row of the walk; it also gives the element type of the list of done ones
    done_type = "array<struct<chunk_id string, disposition string, content string, content_truncated boolean>>"
    left = lambda s: F.lit(token_budget * CHARS_PER_TOKEN) - s["used"]

    def step(s, x):
        fits = F.char_length(x["content"]) <= left(s)
        cut = F.concat(F.regexp_replace(F.substring(x["content"], F.lit(1), F.greatest(F.lit(1), left(s) - 1)), r"(?U)\s+$", ""), F.lit("…"))
        content = F.when(fits, x["content"]).otherwise(cut)
        state = F.when(s["items"] >= most_items, "item_budget").when(left(s) < LEAST_CHARS, "token_budget").otherwise("selected")
        kept = state == "selected"
        entry = F.struct(x["chunk_id"].alias("chunk_id"), state.alias("disposition"), F.when(kept, content).alias("content"), (kept & (x["content_truncated"] | ~fits)).alias("content_truncated"))
        return F.struct((s["items"] + kept.cast("int")).alias("items"), (s["used"] + F.when(kept, F.char_length(content)).otherwise(0)).alias("used"), F.array_append(s["done"], entry).alias("done"))

    start = F.struct(F.lit(0).alias("items"), F.lit(0).alias("used"), F.array().cast(done_type).alias("done"))
    folded = walked.select("query_id", F.posexplode(F.aggregate("all", start, step, lambda s: s["done"])).alias("at", "x"))
    return folded.select("query_id", (F.col("at") + 1).alias("rank"), "x.*")


def budgets(packed: DataFrame) -> DataFrame:
    """Per query: items and characters used, tokens (four characters each, rounded up), omitted candidates, truncation."""
    used = F.sum(F.coalesce(F.char_length("content"), F.lit(0)))
    picked = F.col("disposition") == "selected"
    return packed.groupBy("query_id").agg(
        F.count_if(picked).alias("items_used"), used.alias("chars_used"), F.ceil(used / CHARS_PER_TOKEN).alias("tokens_used"), F.count_if(~picked).alias("omitted"),
        ((F.count_if(~picked) > 0) | F.bool_or("content_truncated")).alias("truncated"),
    )


def coverage(queries: DataFrame, totals: DataFrame, inactive: DataFrame) -> DataFrame:
    """Per query: status, gaps and warnings, also for queries without any hit. ``inactive(query_id)``: scopes with a snapshot that
    isn't active."""
    old = inactive.select("query_id").distinct().withColumn("old", F.lit(True))
    rows = queries.select("query_id").join(totals, "query_id", "left").join(old, "query_id", "left")
    some = F.coalesce("items_used", F.lit(0)) > 0
    gaps = F.array_compact(F.array(F.when(some, "coverage not assessed").otherwise("no evidence in scope"), F.when(F.col("omitted") > 0, "candidates omitted by budget")))
    warnings = F.array_compact(F.array(F.when(F.col("old"), "a snapshot in scope is no longer active")))
    return rows.select("query_id", F.when(some, "available_unassessed").otherwise("none").alias("evidence_status"), gaps.alias("gaps"), warnings.alias("warnings"))


def candidate_names(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """``(query_id, name, name_order)``: the query's identifiers, then the symbols of its hits by rank, each once."""
    asked = queries.select("query_id", F.posexplode(identifiers("query")).alias("o", "name"))
    found = hits.where("symbol is not null").select("query_id", (F.col("rank") + 1_000).alias("o"), F.col("symbol").alias("name"))
    first = asked.union(found).groupBy("query_id", "name").agg(F.min("o").alias("o"))
    return first.select("query_id", "name", F.row_number().over(Window.partitionBy("query_id").orderBy("o", "name")).alias("name_order"))


def symbol_contexts(names: DataFrame, occurrences: DataFrame, relations: DataFrame, most_symbols: int = 8, most_occurrences: int = 4, most_relations: int = 8) -> DataFrame:
    """``(query_id, name, snapshot_id, occurrences, relations, truncated)``: for each name and snapshot its first places and
    relations; names without either don't count towards ``most_symbols``.

    ``occurrences(name, snapshot_id, citation, role)`` and ``relations(name, snapshot_id, citation, target_text)``; a relation
    that is given twice counts once. The names are chosen first, by keys alone; only the rows of the chosen are gathered, and of a name's
    relations a task sends only those that may be among its first.
    """
    def firsts(rows: DataFrame, most: int, fields: list[str], out: str) -> DataFrame:
        ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("name", "snapshot_id").orderBy("citation", *fields)))
        return ranked.where(F.col("n") <= most + 1).groupBy("name", "snapshot_id").agg(F.array_sort(F.collect_list(F.when(F.col("n") <= most, F.struct("n", "citation", *fields)))).alias(out), (F.count("*") > most).alias(out + "_more"))

    def once(rows: DataFrame, most: int) -> DataFrame:
        place = F.dense_rank().over(Window.partitionBy("name", "snapshot_id").orderBy("citation", "target_text"))
        return rows.withColumn("n", place).where(F.col("n") <= most + 1).drop("n").distinct()

    key = ["name", "snapshot_id"]
    places = occurrences.select(*key).distinct().union(relations.select(*key).distinct()).distinct()
    ranked = names.join(places, "name").withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy("name_order", "snapshot_id")))
    chosen = durable(ranked.where(F.col("at") <= most_symbols).drop("at", "name_order"), "contexts")
    few = chosen.select(*key).distinct()
    few = F.broadcast(few) if few.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else few
    kept = lambda rows: rows.join(few, key, "left_semi")
    own = firsts(kept(occurrences), most_occurrences, ["role"], "occurrences").join(firsts(once(kept(relations).select(*key, "citation", "target_text"), most_relations), most_relations, ["target_text"], "relations"), key, "full_outer")
    return chosen.join(own, key).withColumn("truncated", F.coalesce("occurrences_more", F.lit(False)) | F.coalesce("relations_more", F.lit(False))).drop("occurrences_more", "relations_more")


def cross_links(contexts: DataFrame, repositories: DataFrame, most: int = MOST_LINKS) -> DataFrame:
    """Links between repositories: a relation whose text is the name of a symbol that another repository defines.

    ``repositories(snapshot_id, repository)``. One link for each source snapshot and pair of citations."""
    own = contexts.join(repositories, "snapshot_id")
    source = own.select("query_id", F.col("repository").alias("source_repository"), F.col("snapshot_id").alias("source_snapshot_id"), F.explode("relations").alias("r")).select("query_id", "source_repository", "source_snapshot_id", F.col("r.citation").alias("source_citation"), F.col("r.target_text").alias("symbol"))
    defined = F.element_at(F.filter("occurrences", lambda o: o["role"] == "definition"), 1)
    target = own.where(F.exists("occurrences", lambda o: o["role"] == "definition")).select("query_id", F.col("name").alias("symbol"), F.col("repository").alias("target_repository"), F.col("snapshot_id").alias("target_snapshot_id"), defined["citation"].alias("target_citation"))
    links = source.join(target, ["query_id", "symbol"]).where("source_repository <> target_repository").dropDuplicates(["query_id", "source_snapshot_id", "source_citation", "target_citation"])
    order = Window.partitionBy("query_id").orderBy("symbol", "source_repository", "source_citation", "target_repository", "target_citation")
    return links.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).drop("n")
