"""Versioned snapshots: identity, states, manifests of change, publishing, export, counters, solutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcelore.functions.ids import stable_id
from sourcelore.operators.chunks import LINE_GENERATOR

STATES = ("building", "validated", "active")


def snapshot_ids(manifests: DataFrame, revision: str, profile: str) -> DataFrame:
    """One snapshot for each repository's manifest: the same input has the same id."""
    return manifests.withColumn("revision", F.lit(revision)).withColumn("index_profile_digest", F.lit(profile)).withColumn("id", stable_id("snapshot", "repository", "revision", "manifest_digest", "index_profile_digest"))


def absent(rows: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key isn't known yet: what an idempotent insert adds."""
    return rows.join(known.select(key).distinct(), key, "left_anti")


def current_states(events: DataFrame, key: str = "snapshot_id") -> DataFrame:
    """The state by the latest event of each key."""
    return events.groupBy(key).agg(F.max_by("state", "event_seq").alias("state"), F.max("event_seq").alias("event_seq"))


def activation_events(events: DataFrame, owners: DataFrame, activate: DataFrame) -> DataFrame:
    """Events to append so that each of ``activate(snapshot_id)`` becomes its repository's one active snapshot.

    ``owners(snapshot_id, repository_id)``. New ones pass through building and validated; the one active until now is
    superseded; one that is active already gets none. Sequence numbers go on from the log's last.
    """
    now = owners.join(current_states(events), "snapshot_id", "left")
    wanted = activate.select("snapshot_id").distinct().join(now, "snapshot_id").where("state is null or state <> 'active'")
    new = wanted.select("snapshot_id", F.explode(F.when(F.col("state").isNull(), F.array(*map(F.lit, STATES))).otherwise(F.array(F.lit("active")))).alias("state"))
    old = now.where("state = 'active'").join(wanted.select("repository_id").distinct(), "repository_id", "left_semi").select("snapshot_id", F.lit("superseded").alias("state"))
    order = F.when(F.col("state") == "building", 0).when(F.col("state") == "validated", 1).when(F.col("state") == "superseded", 2).otherwise(3)
    last = events.agg(F.coalesce(F.max("event_seq"), F.lit(0)).alias("last"))
    rows = new.union(old).join(F.broadcast(last))  # one row is broadcast
    # a few events a snapshot: the log of one activation, not of the data
    return rows.withColumn("event_seq", F.col("last") + F.row_number().over(Window.orderBy(order, "snapshot_id"))).select("event_seq", "snapshot_id", "state")


def order_violations(events: DataFrame) -> DataFrame:
    """Snapshots whose log doesn't begin with building, validated, active."""
    early = events.withColumn("__n", F.row_number().over(Window.partitionBy("snapshot_id").orderBy("event_seq"))).where(F.col("__n") <= len(STATES))
    first = early.groupBy("snapshot_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", "state"))), lambda e: e["state"]).alias("states"))
    return first.where(F.col("states") != F.array(*map(F.lit, STATES)))


def active_violations(events: DataFrame, owners: DataFrame) -> DataFrame:
    """Repositories with more than one active snapshot."""
    return current_states(events).where("state = 'active'").join(owners, "snapshot_id").groupBy("repository_id").agg(F.count("*").alias("active")).where("active > 1")


def resolve_snapshots(snapshots: DataFrame, events: DataFrame, repository: str | None = None, snapshot_id: str | None = None) -> DataFrame:
    """The named snapshot, or the active ones (of a repository), by repository and id."""
    states = snapshots.join(current_states(events), snapshots["id"] == F.col("snapshot_id"))
    found = states.where(F.col("id") == snapshot_id) if snapshot_id else states.where("state = 'active'")
    return found.where(F.col("repository") == repository) if repository else found


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(repository, path, change)`` between two scans: added, removed, changed or unchanged, by blob."""
    key = ["repository", "path"]
    both = before.select(*key, F.col("blob_id").alias("old")).join(after.select(*key, F.col("blob_id").alias("new")), key, "full_outer")
    return both.withColumn("change", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed"))


def artifact_ids(scanned: DataFrame, profile: str) -> DataFrame:
    """Distinct analyses: by blob, language and profile, whatever the path."""
    return scanned.withColumn("artifact_id", stable_id("analysis", "blob_id", "language", F.lit(profile)))


def cache_split(scanned: DataFrame, cache: DataFrame, profile: str) -> tuple[DataFrame, DataFrame]:
    """Hits and misses, one row for each artifact; only misses need to be analysed. Ids are shuffled, not contents."""
    ids = artifact_ids(scanned, profile)
    one = ids.groupBy("artifact_id").agg(F.min(F.struct("repository", "path")).alias("at"), F.first("language").alias("language"), F.first("blob_id").alias("blob_id"))
    known = cache.select("artifact_id").distinct()
    return one.join(known, "artifact_id", "left_semi"), one.join(known, "artifact_id", "left_anti")


ARTIFACT_VERSION = 1


PAYLOAD = {
    "chunks": ("ordinal", "kind", "start_line", "end_line", "symbol", "content"), "conditions": ("start_line", "end_line", "depth", "expression"),
    "occurrences": ("start_line", "end_line", "name", "kind", "role", "scope", "signature"), "relations": ("start_line", "end_line", "kind", "source_name", "target_text", "target_path", "condition", "confidence"),
}


def artifacts(found: dict[str, DataFrame]) -> DataFrame:
    """Analyses as nested rows, one for each ``artifact_id``: its chunks, conditions, occurrences and relations (those of PAYLOAD
    that are given, each with the columns named there) in their order, with a version. What is gathered is one file's."""
    out = None
    for name, fields in PAYLOAD.items():
        if name in found:
            own = found[name].groupBy("artifact_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
            out = own if out is None else out.join(own, "artifact_id", "full_outer")
    return out.withColumn("version", F.lit(ARTIFACT_VERSION))


def artifact_rows(stored: DataFrame, name: str = "chunks") -> DataFrame:
    """Back to rows of one kind; an artifact of another version is an error."""
    good = F.when(F.col("version") == ARTIFACT_VERSION, F.col(name)).otherwise(F.raise_error(F.concat(F.lit("artifact version "), F.col("version").cast("string"))))
    return stored.select("artifact_id", F.inline(good))


def publish(rows: DataFrame, path: str, key: str | None = None) -> DataFrame:
    """Write rows to the store. Content-addressed rows (with a ``key``): only absent ones are appended. Versioned rows: the
    partitions of their snapshots are replaced. Nothing is visible until the snapshot's active event is in the log."""
    spark = rows.sparkSession
    if key:
        try:
            new = absent(rows.dropDuplicates([key]), spark.read.parquet(path), key)
        except Exception as e:  # the first publish finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
            new = rows.dropDuplicates([key])
        new.write.mode("append").parquet(path)
    else:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(path)
    return spark.read.parquet(path)


def export_violations(files: DataFrame) -> DataFrame:
    """Files whose content isn't what their blob id and size say."""
    return files.where((F.sha2("content", 256) != F.col("blob_id")) | (F.octet_length("content") != F.col("size_bytes")))


def export_manifest(files: DataFrame) -> DataFrame:
    """Per snapshot: number of files, bytes, and a digest over path and blob in order."""
    line = F.concat("path", F.lit("\0"), "blob_id", F.lit("\n"))
    return files.groupBy("snapshot_id").agg(F.count("*").alias("file_count"), F.sum("size_bytes").alias("byte_count"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ""), 256).alias("export_digest"))


def export(files: DataFrame, path: str) -> DataFrame:
    """Write ``(snapshot_id, path, content)`` of verified files, and return the manifest. The same export again writes nothing; an
    export of other files to the same place is an error, as is a file whose content isn't what its blob id says."""
    spark = files.sparkSession
    bad = export_violations(files).select("path").first()
    if bad:
        raise ValueError(f"content and blob id differ: {bad[0]}")
    new = export_manifest(files)
    try:
        old = spark.read.parquet(f"{path}/manifest")
    except Exception as e:  # the first export finds no manifest
        if "PATH_NOT_FOUND" not in str(e):
            raise
        files.select("snapshot_id", "path", "content").write.mode("overwrite").partitionBy("snapshot_id").parquet(f"{path}/files")
        new.write.parquet(f"{path}/manifest")  # written last: without it, an export isn't there
        return spark.read.parquet(f"{path}/manifest")
    if new.exceptAll(old.select(*new.columns)).union(old.select(*new.columns).exceptAll(new)).first():
        raise ValueError("another export is at this place")
    return old


def snapshot_counters(files: DataFrame, chunks: DataFrame, occurrences: DataFrame | None = None, relations: DataFrame | None = None, conditions: DataFrame | None = None) -> DataFrame:
    """Counts per snapshot, one aggregate for each table, joined."""
    errors = [F.coalesce(F.sum("syntax_error_count"), F.lit(0)).alias("parse_error_count")] if "syntax_error_count" in files.columns else []
    out = files.groupBy("snapshot_id").agg(F.count("*").alias("file_count"), F.countDistinct("blob_id").alias("blob_count"), F.sum("size_bytes").alias("byte_count"), *errors)
    by_lines = F.col("generator") == LINE_GENERATOR
    kinds = chunks.groupBy("snapshot_id").agg(F.count("*").alias("chunk_count"), F.count_if(~by_lines).alias("structured_chunk_count"), F.count_if(by_lines).alias("fallback_chunk_count"))
    out = out.join(kinds, "snapshot_id", "left")
    for rows, name in ((occurrences, "symbol_occurrence_count"), (relations, "relation_count"), (conditions, "condition_count")):
        if rows is not None:
            out = out.join(rows.groupBy("snapshot_id").agg(F.count("*").alias(name)), "snapshot_id", "left")
    return out.na.fill(0)


def count_violations(declared: DataFrame, counted: DataFrame) -> DataFrame:
    """``(snapshot_id, counter, declared, counted)`` where they differ."""
    names = [c for c in counted.columns if c != "snapshot_id" and c in declared.columns]
    long = lambda df, value: df.unpivot(["snapshot_id"], names, "counter", value)
    return long(declared.select("snapshot_id", *names), "declared").join(long(counted.select("snapshot_id", *names), "counted"), ["snapshot_id", "counter"], "full_outer").where(~F.col("declared").eqNullSafe(F.col("counted")))


def summary(snapshots: DataFrame, events: DataFrame, solutions: DataFrame | None = None, solution_events: DataFrame | None = None) -> DataFrame:
    """The catalog in one row; ``solutions(id, solution_id)`` are solution snapshots, with a log of their own."""
    states = current_states(events)
    out = snapshots.join(states, snapshots["id"] == states["snapshot_id"], "left").agg(F.countDistinct("repository").alias("repositories"), F.count("*").alias("snapshots"), F.count_if(F.col("state") == "active").alias("active_snapshots"))
    if solutions is None:
        return out
    states = current_states(solution_events)
    own = solutions.join(states, solutions["id"] == states["snapshot_id"], "left").agg(F.countDistinct("solution_id").alias("solutions"), F.count("*").alias("solution_snapshots"), F.count_if(F.col("state") == "active").alias("active_solution_snapshots"))
    return out.join(own)  # one row each


def published_solutions(members: DataFrame, states: DataFrame, known: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Publish the solutions of ``members`` that break no rule: ``(solution snapshots to add, events to add, violations)``.

    ``known(id, solution_id)`` are those published before, ``log`` their events. The same members again have the same id: nothing
    is added if it is active, and it is activated again if it was superseded. One is active for each solution.
    """
    bad = member_violations(members, states)
    ids = solution_ids(members.join(bad.select("solution_id").distinct(), "solution_id", "left_anti")).select("id", "solution_id", "digest")
    new = absent(ids, known)
    owners = known.select("id", "solution_id").union(new.select("id", "solution_id")).select(F.col("id").alias("snapshot_id"), F.col("solution_id").alias("repository_id"))
    return new, activation_events(log, owners, ids.select(F.col("id").alias("snapshot_id"))), bad


def member_violations(members: DataFrame, states: DataFrame, least: int = 2, most: int = 32) -> DataFrame:
    """``(solution_id, problem)`` of ``members(solution_id, repository, role, snapshot_id, ordinal)``: too few or many, repeats of a
    repository, role or snapshot, and snapshots that are neither active nor superseded."""
    size = members.groupBy("solution_id").agg(F.count("*").alias("n"), *[F.countDistinct(c).alias(c) for c in ("repository", "role", "snapshot_id")])
    found = size.select("solution_id", F.explode(F.array_compact(F.array(
        F.when(~F.col("n").between(least, most), "member_count"), *[F.when(F.col(c) < F.col("n"), "duplicate_" + c) for c in ("repository", "role", "snapshot_id")],
    ))).alias("problem"))
    usable = states.where(F.col("state").isin("active", "superseded")).select("snapshot_id")
    return found.union(members.join(usable, "snapshot_id", "left_anti").select("solution_id", F.lit("unusable_snapshot").alias("problem"))).distinct()


def solution_ids(members: DataFrame) -> DataFrame:
    """A solution snapshot's id from its members in order."""
    line = F.concat_ws("\0", "repository", "role", "snapshot_id")
    digest = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line")))), lambda x: x["line"]), "\n"), 256)
    return members.groupBy("solution_id").agg(digest.alias("digest")).withColumn("id", stable_id("solution_snapshot", "solution_id", "digest"))


def solution_scope(members: DataFrame, readable: DataFrame) -> DataFrame:
    """Members that a principal may read, in order, with ``partial_visibility``; hidden repositories don't show in any column.
    ``readable(principal_id, repository)``. A solution of which nothing is visible gives no row."""
    n = members.groupBy("solution_id").agg(F.count("*").alias("n"))
    seen = members.join(readable, "repository").join(n, "solution_id")
    partly = F.count("*").over(Window.partitionBy("principal_id", "solution_id")) < F.col("n")
    return seen.withColumn("partial_visibility", partly).select("principal_id", "solution_id", "repository", "snapshot_id", "ordinal", "partial_visibility")


def scope_counts(members: DataFrame, readable: DataFrame) -> DataFrame:
    """``(principal_id, partial_visibility, members, solutions_shown)``: the rows of ``solution_scope`` counted, and the solutions that are
    wholly visible. Members are distinct by solution and repository, principals by repository.

    Solutions of the same repositories look alike to everyone: principals meet each such set once, not each solution."""
    sets = members.groupBy("solution_id").agg(F.array_sort(F.collect_set("repository")).alias("repositories")).groupBy("repositories").agg(F.count("*").alias("solutions"))
    seen = sets.select("repositories", "solutions", F.explode("repositories").alias("repository")).join(readable, "repository").groupBy("principal_id", "repositories", "solutions").agg(F.count("*").alias("seen"))
    partly = F.col("seen") < F.size("repositories")
    return seen.groupBy("principal_id", partly.alias("partial_visibility")).agg(F.sum(F.col("seen") * F.col("solutions")).alias("members"), F.sum(F.when(partly, F.lit(0)).otherwise(F.col("solutions"))).alias("solutions_shown"))


def hidden_when_partial(value: Column) -> Column:
    """What names the whole solution isn't shown to one who sees a part."""
    return F.when(~F.col("partial_visibility"), value)
