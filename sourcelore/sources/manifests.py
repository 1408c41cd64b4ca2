"""Questions, scopes and manifests as JSON, by declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTION = "id string, question string, category string, synthetic boolean, query_terms array<string>, required_evidence array<struct<path: string, start_line: int, end_line: int, symbol: string, note: string>>"
SCOPE = "include_roots array<string>, exclude_globs array<string>, max_file_bytes long, dependency_depth int, dependency_max_files int, dependency_max_candidates int"
SOLUTION = "solution string, members array<struct<repository: string, role: string, snapshot_id: string>>"
SECURITY = {
    "domain": "id string, name string, status string", "principals": "id string, security_domain_id string, issuer string, subject string, status string", "teams": "id string, security_domain_id string, name string, status string",
    "members": "team_id string, principal_id string, active boolean", "grants": "id string, security_domain_id string, repository_id string, principal_id string, team_id string, permission string, expires_at string, active boolean",
}
COLLABORATORS = "repository string, captured_at string, collaborators array<struct<user_id: long, admin: boolean, maintain: boolean, push: boolean, triage: boolean, pull: boolean>>"
_CORRUPT = "_corrupt"


def read_questions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Questions, and rejected lines with a reason: no JSON object, or a field missing, or no query terms. Blank lines don't count."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    rows = raw.select("value", F.from_json("value", f"{QUESTION}, {_CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}).alias("q")).select("value", "q.*")
    missing = F.lit(False)
    for name in ("id", "question", "category", "synthetic", "query_terms", "required_evidence"):
        missing = missing | F.col(name).isNull()
    reason = F.when(F.col(_CORRUPT).isNotNull(), "not_json").when(missing, "missing_field").when(F.size("query_terms") == 0, "no_query_terms")
    judged = rows.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason", "value", _CORRUPT), judged.where("reason is not null").select(F.col("value").alias("line"), "reason")


def read_scope(spark: SparkSession, path: str) -> DataFrame:
    """One scope object. Anything but an object is an error."""
    rows = spark.read.schema(f"{SCOPE}, {_CORRUPT} string").option("multiLine", True).option("columnNameOfCorruptRecord", _CORRUPT).json(path)
    return rows.withColumn(_CORRUPT, F.when(F.col(_CORRUPT).isNotNull(), F.raise_error(F.lit("scope must contain a JSON object")))).drop(_CORRUPT)


def read_members(spark: SparkSession, path: str) -> DataFrame:
    """Solution manifests as member rows in their order, with the digest of the manifest's canonical JSON.

    Unknown fields are an error: the canonical text must hold as many keys as the declared fields take."""
    raw = spark.read.option("wholetext", True).text(path).select("value", F.from_json("value", SOLUTION, {"mode": "FAILFAST"}).alias("m"), F.json_object_keys("value").alias("keys"))
    strict = F.when(F.size(F.array_except("keys", F.array(F.lit("solution"), F.lit("members")))) == 0, F.col("m.members")).otherwise(F.raise_error(F.lit("unknown field in manifest")))
    digest = F.sha2(F.to_json(F.struct(F.transform("m.members", lambda x: F.struct(x["repository"].alias("repository"), x["role"].alias("role"), x["snapshot_id"].alias("snapshot_id"))).alias("members"), F.col("m.solution").alias("solution"))), 256)
    return raw.select(F.col("m.solution").alias("solution_id"), digest.alias("manifest_digest"), F.posexplode(strict).alias("ordinal", "x")).select("solution_id", "manifest_digest", "ordinal", "x.*")


def read_security(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Security manifests (one JSON object a file) as the tables of SECURITY. Unknown fields and unreadable files are errors."""
    shape = ", ".join(f"{k} {'struct' if k == 'domain' else 'array<struct'}<{v.replace(' ', ': ')}>{'' if k == 'domain' else '>'}".replace(",: ", ", ") for k, v in SECURITY.items())
    raw = spark.read.option("wholetext", True).text(path).select(F.from_json("value", shape, {"mode": "FAILFAST"}).alias("m"), F.json_object_keys("value").alias("keys"))
    strict = F.when(F.size(F.array_except("keys", F.array(*map(F.lit, SECURITY)))) == 0, F.col("m")).otherwise(F.raise_error(F.lit("unknown field in manifest")))
    rows = raw.select(strict.alias("m"))
    return {k: rows.select("m.domain.*") if k == "domain" else rows.select(F.inline(f"m.{k}")) for k in SECURITY}


def read_collaborators(spark: SparkSession, path: str) -> DataFrame:
    """Snapshots of a repository's collaborators as rows; the time of capture needs a zone."""
    raw = spark.read.option("wholetext", True).text(path).select(F.from_json("value", COLLABORATORS, {"mode": "FAILFAST"}).alias("m")).select("m.*")
    zoned = F.when(F.regexp_like("captured_at", F.lit(r"(Z|[+-]\d\d:?\d\d)$")), F.to_timestamp("captured_at")).otherwise(F.raise_error(F.lit("captured_at needs a zone")))
    return raw.select("repository", zoned.alias("captured_at"), F.inline("collaborators"))
