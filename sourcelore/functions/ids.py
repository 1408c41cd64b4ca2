"""Ids, digests and citations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nul_joined(*parts: Column | str) -> Column:
    """The parts as text with a NUL between them; a null part is empty."""
    return F.concat_ws("\0", *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts])


def stable_id(prefix: str, *parts: Column | str) -> Column:
    """``prefix_`` and 24 hex digits of the SHA-256 of the NUL-joined parts."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(nul_joined(*parts), 256), 1, 24))


def evidence_id(prefix: str, **fields: Column | str) -> Column:
    """The same over compact JSON with sorted keys."""
    ordered = F.struct(*[F.coalesce(col(fields[k]).cast("string"), F.lit("")).alias(k) for k in sorted(fields)])
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.to_json(ordered), 256), 1, 24))


def citation(repository: Column | str, revision: Column | str, path: Column | str, start: Column | str, end: Column | str) -> Column:
    """``repository@revision:path:start-end``"""
    return F.concat(col(repository), F.lit("@"), col(revision), F.lit(":"), col(path), F.lit(":"), col(start).cast("string"), F.lit("-"), col(end).cast("string"))
