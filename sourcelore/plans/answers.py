"""Questions to evidence packs in one job: three channels over a snapshot's rows, fused, cut to a budget, with symbols, links and ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelore.functions.ids import citation, evidence_id
from sourcelore.operators import fusion as U
from sourcelore.operators import index as W
from sourcelore.operators import search as S
from sourcelore.plans import pack as G
from sourcelore.storage import durable

_HIT = ["query_id", "channel", "rank", "snapshot_id", "chunk_id", "repository", "path", "start_line"]


class Catalog:
    """What a search reads: the stored word index, and ``chunk``, ``logical_symbol``, ``symbol_occurrence`` and ``relation`` rows of ingest
    (see ``plans.ingest``), with ``chunk_id``, ``repository`` and ``path`` on the chunks."""

    def __init__(self, index: W.WordIndex, chunks: DataFrame, symbols: DataFrame, occurrences: DataFrame, relations: DataFrame) -> None:
        self.index, self.chunks, self.symbols, self.occurrences, self.relations = index, chunks, symbols, occurrences, relations


def channels(catalog: Catalog, questions: DataFrame, top_k: int, scope: DataFrame | None = None) -> DataFrame:
    """``questions(query_id, query)`` to the hits of the word, symbol and relation channels, ``top_k`` of each, within the snapshots of
    ``scope(snapshot_id)``. Names are the question's first identifiers."""
    if not 1 <= top_k <= 100:
        raise ValueError("top_k must be between 1 and 100")
    inside = lambda rows: rows if scope is None else rows.join(scope.select("snapshot_id").distinct(), "snapshot_id", "left_semi")
    names, chunks = S.query_names(questions), inside(catalog.chunks)
    word = W.bm25(catalog.index, questions, top_k, scope)
    symbol = S.symbol_hits(names, catalog.symbols, catalog.occurrences, chunks, top_k)
    relation = S.relation_hits(names, catalog.symbols, catalog.relations, chunks, top_k)
    rows = [hits.withColumn("channel", F.lit(name)).select(*_HIT) for name, hits in zip(U.WEIGHTS, (word, symbol, relation))]
    return durable(rows[0].union(rows[1]).union(rows[2]), "channels")


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.limit(S.MOST_BROADCAST + 1).count() <= S.MOST_BROADCAST else rows


def _decimal(score: str) -> Column:
    """A score as text, the same on every engine."""
    return F.round(score, 12).cast("decimal(20,12)").cast("string")


def _listed(rows: DataFrame, text: Column, order: list, name: str) -> DataFrame:
    """The texts of a query's rows in their order, as one: some hundred at most, by the bounds of packs."""
    gathered = F.array_sort(F.collect_list(F.struct(*order, text.alias("__text"))))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(gathered, lambda x: x["__text"]), ",").alias(name))


def packs(catalog: Catalog, questions: DataFrame, token_budget: int = 3_000, most_items: int = 8, most_symbols: int = 5, most_relations: int = 8, scope: DataFrame | None = None, inactive: DataFrame | None = None, top_k: int | None = None) -> DataFrame:
    """One row a question: ``query_id, query, id, trace_id, evidence, symbols, links`` and the columns of its budget and coverage.

    Candidates are the fused hits of the channels, three an item. The trace's id is over the question, the scope's
    snapshots, all candidates with scores, ranks and dispositions, the symbols, the links, the channels' counts and the budget;
    the pack's over the trace, the snapshots, the evidence and the links. So an id changes whenever one of these does.
    ``inactive(snapshot_id)``: snapshots that are no longer active.
    """
    top_k = min(G.MOST_CANDIDATES, 3 * most_items) if top_k is None else top_k
    found = channels(catalog, questions, top_k, scope)
    fused = U.fuse(found, top_k)
    details = ["chunk_id", "content", "content_hash", "symbol", "revision", "end_line"]
    hits = durable(fused.join(catalog.chunks.select(*details), "chunk_id").withColumn("content_truncated", F.lit(False)), "hits")
    packed = durable(G.evidence(hits, token_budget, most_items), "packed")
    totals = G.budgets(packed)

    cite = citation("repository", "revision", "path", "start_line", "end_line")
    snapshots = catalog.chunks.select("snapshot_id", "repository", "revision").distinct()
    snapshots = snapshots if scope is None else snapshots.join(scope.select("snapshot_id").distinct(), "snapshot_id", "left_semi")
    files = catalog.chunks.select("file_id", "snapshot_id", "repository", "revision", "path").distinct()
    files = _few(durable(files.join(snapshots.select("snapshot_id"), "snapshot_id", "left_semi"), "files"))
    names = durable(G.candidate_names(questions, hits), "names")
    ids = _few(durable(catalog.symbols.select(F.col("id").alias("logical_symbol_id"), "name").join(names.select("name").distinct(), "name", "left_semi"), "ids"))
    places = catalog.occurrences.select("logical_symbol_id", "role", "file_id", "start_line", "end_line").distinct().join(ids, "logical_symbol_id").join(files, "file_id").select("name", "snapshot_id", cite.alias("citation"), "role")
    told = catalog.relations.select(F.col("source_symbol_id").alias("logical_symbol_id"), F.col("source_file_id").alias("file_id"), "target_text", "start_line", "end_line").join(ids, "logical_symbol_id").join(files, "file_id")
    contexts = durable(G.symbol_contexts(names, places, told.select("name", "snapshot_id", cite.alias("citation"), "target_text"), most_symbols, 4, most_relations), "contexts")
    links = G.cross_links(contexts, snapshots.select("snapshot_id", "repository"))
    links = links.withColumn("link_id", evidence_id("cross_link", symbol="symbol", source_snapshot_id="source_snapshot_id", source_citation="source_citation", target_snapshot_id="target_snapshot_id", target_citation="target_citation"))
    links = durable(links, "links")

    chosen = packed.join(hits.select("query_id", "chunk_id", "fused_score", "contributions", "snapshot_id", "content_hash", "repository", "revision", "path", "start_line", "end_line"), ["query_id", "chunk_id"])
    chosen = chosen.withColumns({"evidence_id": evidence_id("evidence", snapshot_id="snapshot_id", chunk_id="chunk_id", content_hash="content_hash"), "citation": cite})
    item = F.struct("rank", "evidence_id", "chunk_id", "citation", "content", "content_truncated", _decimal("fused_score").alias("score"), "contributions")
    own = chosen.where("disposition = 'selected'")
    evidence = own.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("evidence"))
    # a place among the symbols, as the contexts are ranked: by the name's order, then by snapshot
    ranked = contexts.join(names, ["query_id", "name"])
    symbols = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("name_order", "snapshot_id", "name", "occurrences", "relations", "truncated"))).alias("symbols"))
    linked = links.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("symbol", "source_repository", "source_citation", "target_repository", "target_citation", "link_id"))).alias("links"))
    counts = found.groupBy("query_id", "channel").agg(F.count("*").alias("n"))
    said = [
        _listed(chosen, F.concat_ws("|", "chunk_id", _decimal("fused_score"), F.array_join("contributions", " "), "disposition"), ["rank"], "candidates"),
        _listed(own, F.col("evidence_id"), ["rank"], "evidence_ids"),
        _listed(ranked, F.concat_ws("|", "name", "snapshot_id"), ["name_order", "snapshot_id"], "symbol_names"),
        _listed(links, F.col("link_id"), ["symbol", "source_repository", "source_citation", "target_repository", "target_citation"], "link_ids"),
        _listed(counts, F.concat_ws(":", "channel", F.col("n").cast("string")), ["channel"], "counts"),
    ]
    scoped = snapshots.agg(F.array_join(F.array_sort(F.collect_list("snapshot_id")), ",").alias("snapshots"))  # one row; a snapshot a repository
    old = questions.select("query_id").where(F.lit(False)) if inactive is None else questions.select("query_id").join(snapshots.join(inactive.select("snapshot_id"), "snapshot_id", "left_semi").limit(1).select(F.lit(1)), how="cross")
    rows = questions.select("query_id", "query").join(totals, "query_id", "left").join(G.coverage(questions, totals, old), "query_id")
    for more in (evidence, symbols, linked, *said):
        rows = rows.join(more, "query_id", "left")
    rows = rows.crossJoin(F.broadcast(scoped))  # one row
    budget = F.concat_ws("|", F.lit(token_budget), F.lit(most_items), F.lit(most_symbols), F.lit(most_relations), *[F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in ("items_used", "chars_used", "omitted")])
    rows = rows.withColumn("trace_id", evidence_id("trace", query="query", snapshots="snapshots", candidates="candidates", symbols="symbol_names", links="link_ids", counts="counts", budget=budget))
    rows = rows.withColumn("id", evidence_id("context", trace="trace_id", snapshots="snapshots", evidence="evidence_ids", links="link_ids"))
    return rows.drop("candidates", "evidence_ids", "symbol_names", "link_ids", "counts", "snapshots")
