"""Who may read what: grants, teams, filters, manifests, plans of change. ``now`` is always an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelore.functions.ids import col

# fixed values: permissions from least to most
PERMISSIONS = ("read", "write", "admin")


def live(now: Column) -> Column:
    """A grant source that is neither revoked nor expired."""
    return F.col("revoked_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > now))


def permission_rank(permission: Column | str) -> Column:
    return F.when(col(permission) == "admin", 3).when(col(permission) == "write", 2).otherwise(1)


def permission_of(rank: Column | str) -> Column:
    return F.element_at(F.array(*map(F.lit, PERMISSIONS)), col(rank).cast("int"))


def readable(principals: DataFrame, domains: DataFrame, grants: DataFrame, sources: DataFrame, teams: DataFrame, members: DataFrame, now: Column) -> DataFrame:
    """``(principal_id, repository_id)``: an active principal of an active domain, a grant there with a live source, given to the
    principal or to an active team of the domain that they are in. Any permission reads.

    Grants are reduced to what they give (grantee or team, and repository) before they meet people, so that the grants of a team
    aren't multiplied by its members."""
    people = principals.where("status = 'active'").join(domains.where("status = 'active'").select(F.col("id").alias("security_domain_id")), "security_domain_id", "left_semi").select(F.col("id").alias("principal_id"), "security_domain_id")
    alive = grants.join(sources.where(live(now)).select(F.col("repository_grant_id").alias("id")), "id", "left_semi")
    given = alive.groupBy("security_domain_id", "repository_id", F.col("principal_id").alias("grantee"), "team_id").agg(F.lit(1).alias("one")).drop("one")
    direct = given.where("grantee is not null").join(people, (F.col("grantee") == people["principal_id"]) & (given["security_domain_id"] == people["security_domain_id"])).select("principal_id", "repository_id")
    team = teams.where("status = 'active'").select(F.col("id").alias("team_id"), "security_domain_id").distinct()
    of_team = given.where("team_id is not null").select("team_id", "security_domain_id", "repository_id").distinct().join(team, ["team_id", "security_domain_id"])
    inside = members.select("team_id", "principal_id").join(people, "principal_id")
    by_team = of_team.join(inside, ["team_id", "security_domain_id"]).select("principal_id", "repository_id")
    return direct.union(by_team).distinct()


def visible_rows(rows: DataFrame, snapshots: DataFrame, allowed: DataFrame, principal_id: str) -> DataFrame:
    """Rows (with ``snapshot_id``) of the snapshots whose repository the principal may read."""
    own = allowed.where(F.col("principal_id") == principal_id).select("repository_id")
    return rows.join(snapshots.join(own, "repository_id", "left_semi").select("snapshot_id"), "snapshot_id", "left_semi")


def visible_tables(tables: dict[str, DataFrame], allowed: DataFrame, principal_id: str) -> dict[str, DataFrame]:
    """The rows of each table that the principal may read, by the rule of its kind.

    Repositories by themselves; snapshots, symbols and solution members by their repository; all that has a ``snapshot_id`` by
    its snapshot; blobs and analyses if a file that is visible has them; embeddings if their chunk is; a solution snapshot, its
    events and its solution if any member is. Tables of other names aren't read. All filters are semi-joins.
    """
    own = allowed.where(F.col("principal_id") == principal_id).select("repository_id")
    seen: dict[str, DataFrame] = {}
    through = lambda name, other, key, other_key: tables[name].join(seen[other].select(F.col(other_key).alias(key)).distinct(), key, "left_semi")
    for name in tables:
        if name == "repository":
            seen[name] = tables[name].join(own.select(F.col("repository_id").alias("id")), "id", "left_semi")
        elif name in ("snapshot", "logical_symbol", "solution_snapshot_member"):
            seen[name] = tables[name].join(own, "repository_id", "left_semi")
    for name in ("snapshot_event", "source_file", "chunk", "source_condition", "symbol_occurrence", "relation"):
        if name in tables:
            seen[name] = through(name, "snapshot", "snapshot_id", "id")
    for name, other, key, other_key in (
        ("blob", "source_file", "id", "blob_id"), ("analysis_artifact", "source_file", "blob_id", "blob_id"), ("chunk_embedding", "chunk", "chunk_id", "id"), ("solution_snapshot", "solution_snapshot_member", "id", "solution_snapshot_id"),
        ("solution_snapshot_event", "solution_snapshot_member", "solution_snapshot_id", "solution_snapshot_id"), ("solution", "solution_snapshot", "id", "solution_id"),
    ):
        if name in tables:
            seen[name] = through(name, other, key, other_key)
    return seen


def own_rows(rows: DataFrame, principal_id: str, domain_id: str) -> DataFrame:
    return rows.where((F.col("principal_id") == principal_id) & (F.col("security_domain_id") == domain_id))


def effective_grants(sources: DataFrame, now: Column) -> DataFrame:
    """Per grant: whether any source is live, the highest live permission, live kinds, and the expiry (null: none)."""
    alive = live(now)
    return sources.groupBy("repository_grant_id").agg(
        F.bool_or(alive).alias("active"), permission_of(F.coalesce(F.max(F.when(alive, permission_rank("permission"))), F.lit(1))).alias("permission"),
        F.array_sort(F.collect_set(F.when(alive, F.col("source_kind")))).alias("active_source_kinds"),
        F.when(~F.coalesce(F.bool_or(alive & F.col("expires_at").isNull()), F.lit(False)), F.max(F.when(alive, F.col("expires_at")))).alias("expires_at"),
    )


def manifest_violations(principals: DataFrame, teams: DataFrame, members: DataFrame, grants: DataFrame) -> DataFrame:
    """``(problem, key)`` of a desired state: repeats, grants without exactly one grantee, references into nowhere or another
    domain, expiries without a zone (as text)."""
    twice = lambda df, problem, *keys: df.groupBy(*keys).count().where("count > 1").select(F.lit(problem).alias("problem"), F.concat_ws("/", *keys).alias("key"))
    found = twice(principals, "duplicate_principal", "id").union(twice(principals, "duplicate_identity", "issuer", "subject")).union(twice(teams, "duplicate_team", "id")).union(twice(teams, "duplicate_team_name", "security_domain_id", "name"))
    found = found.union(twice(members, "duplicate_membership", "team_id", "principal_id")).union(twice(grants, "duplicate_grant", "id"))
    found = found.union(grants.where((F.col("principal_id").isNull()) == (F.col("team_id").isNull())).select(F.lit("grantee_count"), "id"))
    found = found.union(grants.where(~F.regexp_like("expires_at", F.lit(r"(Z|[+-]\d\d:?\d\d)$"))).select(F.lit("expiry_without_zone"), "id"))
    known = principals.select(F.col("id").alias("principal_id"), F.col("security_domain_id"))
    lost = grants.where("principal_id is not null").join(known, ["principal_id", "security_domain_id"], "left_anti").select(F.lit("unknown_principal"), "id")
    lost = lost.union(grants.where("team_id is not null").join(teams.select(F.col("id").alias("team_id"), "security_domain_id"), ["team_id", "security_domain_id"], "left_anti").select(F.lit("unknown_team"), "id"))
    gone = members.join(known.select("principal_id"), "principal_id", "left_anti").select(F.lit("unknown_member"), F.concat_ws("/", "team_id", "principal_id"))
    return found.union(lost).union(gone)


def moved_identities(current: DataFrame, desired: DataFrame) -> DataFrame:
    """Principals whose identity or domain would change: both are fixed for good."""
    old = current.select("id", *[F.col(c).alias("old_" + c) for c in ("issuer", "subject", "security_domain_id")])
    return desired.join(old, "id").where("issuer <> old_issuer or subject <> old_subject or security_domain_id <> old_security_domain_id")


def upserted(current: DataFrame, desired: DataFrame, key: str = "id") -> DataFrame:
    """All current rows, those desired with their new values, and new ones. Nothing is written: a dry run by itself."""
    return current.join(desired.select(key), key, "left_anti").unionByName(desired.select(*current.columns))


def applied_members(current: DataFrame, desired: DataFrame) -> DataFrame:
    """``desired(team_id, principal_id, active)``: active ones join, others leave, the rest stays."""
    key = ["team_id", "principal_id"]
    gone = desired.where("not active").select(*key)
    return current.select(*key).union(desired.where("active").select(*key)).distinct().join(gone, key, "left_anti")


def applied_manifest(current: dict[str, DataFrame], desired: dict[str, DataFrame], now: Column) -> tuple[dict[str, DataFrame], DataFrame]:
    """All tables after a manifest, and what forbids it: ``(problem, key)``, empty if it may be written.

    Domains, principals, teams and grants are added or changed, never deleted; memberships and the manifest's grant sources
    follow ``active``. Identity and domain of a principal are fixed for good. Nothing is written; the same manifest again
    changes nothing.
    """
    after = {name: upserted(current[name], desired[name]) for name in ("domains", "principals", "teams", "grants")}
    after["members"] = applied_members(current["members"], desired["members"])
    after["sources"] = applied_sources(current["sources"], desired["sources"], now)
    moved = moved_identities(current["principals"], desired["principals"]).select(F.lit("moved_identity").alias("problem"), F.col("id").alias("key"))
    lost = desired["sources"].select("repository_grant_id").join(after["grants"].select(F.col("id").alias("repository_grant_id")), "repository_grant_id", "left_anti").select(F.lit("unknown_grant"), "repository_grant_id")
    return after, moved.union(lost)


def applied_sources(current: DataFrame, desired: DataFrame, now: Column) -> DataFrame:
    """Manifest sources of grants: ``desired(repository_grant_id, permission, active)``; an inactive one is revoked now, unless
    it was before. Sources of other kinds stay as they are."""
    return marked_sources(current, desired, now).drop("revoked_now")


def marked_sources(current: DataFrame, desired: DataFrame, now: Column) -> DataFrame:
    """``applied_sources`` with ``revoked_now``: whether it is this manifest that revokes the source. The time doesn't tell, as one
    revoked before may have been revoked at that same instant."""
    mine = current.where("source_kind = 'manifest'").select("repository_grant_id", F.col("revoked_at").alias("was"))
    new = desired.join(mine, "repository_grant_id", "left").select("repository_grant_id", F.lit("manifest").alias("source_kind"), "permission", F.when(~F.col("active"), F.coalesce("was", now)).alias("revoked_at"), F.lit(None).cast("timestamp").alias("expires_at"), (~F.col("active") & F.col("was").isNull()).alias("revoked_now"))
    rest = current.join(new.select("repository_grant_id", "source_kind"), ["repository_grant_id", "source_kind"], "left_anti").withColumn("revoked_now", F.lit(False))
    return rest.select(*new.columns).union(new)


def collaborator_permission(admin: Column, maintain: Column, push: Column, triage: Column, pull: Column) -> Column:
    """The permission that flags stand for; null (an error) if none is set."""
    return F.when(admin, "admin").when(push | maintain, "write").when(pull | triage, "read")


def collaborator_conflicts(collaborators: DataFrame) -> DataFrame:
    """Users listed with more than one permission."""
    return collaborators.groupBy("user_id").agg(F.countDistinct("permission").alias("permissions")).where("permissions > 1")


def access_plan(collaborators: DataFrame, bindings: DataFrame, grants: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """``(action, principal_id, user_id, permission, reason)``: what would bring the direct grants of one repository in line.

    ``collaborators(user_id, permission)``, ``bindings(user_id, principal_id)``. Revocations are candidates for review.
    """
    state = effective_grants(sources, now)
    current = grants.where("principal_id is not null").join(state, grants["id"] == state["repository_grant_id"], "left").select("principal_id", F.coalesce("active", F.lit(False)).alias("active"), F.coalesce("permission", F.lit("read")).alias("has"))
    bound = collaborators.join(bindings, "user_id")
    both = bound.join(current, "principal_id", "full_outer")
    wanted = F.col("user_id").isNotNull()
    reason = F.when(wanted & F.col("active").isNull(), "missing_direct_grant").when(wanted & ~F.col("active"), "inactive_direct_grant").when(wanted & (F.col("has") != F.col("permission")), "permission_change")
    action = F.when(reason.isNotNull(), "activate").when(wanted, "unchanged").when(F.col("active"), "revoke_candidate")
    plan = both.select(action.alias("action"), "principal_id", "user_id", F.coalesce("permission", "has").alias("permission"), F.coalesce(reason, F.when(~wanted, "not_a_bound_collaborator")).alias("reason")).where("action is not null")
    none = F.lit(None).cast("string")
    unmatched = collaborators.join(bindings, "user_id", "left_anti").select(F.lit("unmatched"), none, "user_id", "permission", none)
    stale = bindings.join(collaborators, "user_id", "left_anti").select(F.lit("stale_binding"), "principal_id", "user_id", none, none)
    return plan.union(unmatched).union(stale)


def valid_tokens(tokens: DataFrame, principals: DataFrame, domains: DataFrame) -> DataFrame:
    """Tokens of active principals of active domains, by issuer and subject, issued since the principal's tokens are valid."""
    people = principals.where("status = 'active'").join(domains.where("status = 'active'").select(F.col("id").alias("security_domain_id")), "security_domain_id", "left_semi").select("issuer", "subject", F.col("id").alias("principal_id"), "tokens_valid_after")
    return tokens.join(people, ["issuer", "subject"]).where(F.col("issued_at") >= F.col("tokens_valid_after")).drop("tokens_valid_after")


def revoked_tokens(principals: DataFrame, now: Column) -> DataFrame:
    """Principals whose tokens from before ``now`` don't count; the time never goes back."""
    return principals.withColumn("tokens_valid_after", F.greatest(F.coalesce("tokens_valid_after", now), now))


def with_legacy_sources(grants: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources, and one of kind ``legacy`` for each grant that has none."""
    new = grants.join(sources.select(F.col("repository_grant_id").alias("id")), "id", "left_anti")
    made = new.select(F.concat(F.lit("legacy_"), F.substring(F.md5(F.col("id").cast("binary")), 1, 24)).alias("source_id"), F.col("id").alias("repository_grant_id"), F.lit("legacy").alias("source_kind"), "permission", "expires_at", "revoked_at")
    return sources.select("source_id", "repository_grant_id", "source_kind", "permission", "expires_at", "revoked_at").union(made)
