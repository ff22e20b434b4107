"""Search over approved records in one call: the request is checked, what it may see is told, and only that is ranked.

A record is seen if it is approved, of a level and department of the request, unchanged since its hash was taken, and if the chunk it was made from is still there with the same approval, hash,
level and departments in a document of the requester's tenant. Of each regulation the version in force on the day counts. The index covers all records, so its statistics do not
depend on who asks; visibility is a semi-join before anything is scored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.functions.dates import effective_on
from statuta.operators import search
from statuta.operators.governance import BLOCKED_QUERIES, ROLE_LEVELS


@dataclass(frozen=True)
class Request:
    """Who asks for what. levels and asked_departments narrow what the role and departments allow."""

    query: str
    tenant: str
    role: str
    departments: tuple[str, ...] = ()
    levels: tuple[str, ...] = ()
    asked_departments: tuple[str, ...] = ()
    profile: str | None = None
    document: str | None = None
    day: str | None = None
    k: int = 10

    def allowed_levels(self) -> tuple[str, ...]:
        """The levels of the role that are asked for; a request beyond its role, for departments of others or with a blocked query is refused."""
        own = ROLE_LEVELS.get(self.role)
        if own is None:
            raise PermissionError(f"unknown role {self.role}")
        if set(self.levels) - set(own):
            raise PermissionError(f"{self.role} may not ask for {sorted(set(self.levels) - set(own))}")
        if self.role != "admin" and set(self.asked_departments) - set(self.departments):
            raise PermissionError("departments of others")
        if any(re.search(p, self.query) for p in BLOCKED_QUERIES):
            raise PermissionError("blocked query")
        return self.levels or own


def low(value: Column) -> Column:
    return F.lower(F.trim(F.coalesce(value.cast("string"), F.lit(""))))


def of_departments(acl: Column, departments: tuple[str, ...]) -> Column:
    return (F.size(acl) == 0) | F.arrays_overlap(acl, F.array(*[F.lit(d) for d in departments]).cast("array<string>"))


def visible_records(records: DataFrame, chunks: DataFrame, documents: DataFrame, request: Request, content: Column | None = None) -> DataFrame:
    """The records that a request may see. records: id, document_id, chunk_id, text, content_hash, approval_status, approval_id, approved_content_hash, security_level, department_acl,
    profile_id; chunks (as they are now): document_id, chunk_id, content_hash, approval_status, approval_id, approved_content_hash, security_level, department_acl; documents: document_id,
    tenant_id, profile_id. content: how a record's hash is made, by default sha256 of its text."""
    levels = request.allowed_levels()
    acl = F.array_sort(F.array_distinct(F.coalesce("department_acl", F.array().cast("array<string>"))))
    rows = records.withColumn("acl_", acl).withColumn("level_", low(F.col("security_level")))
    seen = (low(F.col("approval_status")) == "approved") & (low(F.col("approval_id")) != "") & F.col("level_").isin(*levels)
    seen = seen & (F.col("content_hash") == (F.sha2(F.coalesce("text", F.lit("")), 256) if content is None else content))
    if request.role != "admin":
        seen = seen & of_departments(F.col("acl_"), request.departments)
    if request.asked_departments:
        seen = seen & of_departments(F.col("acl_"), request.asked_departments)
    if request.document:
        seen = seen & (F.col("document_id") == request.document)
    own = documents.filter((F.col("tenant_id") == request.tenant) & (F.col("tenant_id") != "")).select("document_id", low(F.col("profile_id")).alias("owner_"))
    rows = rows.filter(seen).join(own, "document_id")
    if request.profile:
        told = low(F.col("profile_id"))
        rows = rows.filter(F.when(told != "", told).otherwise(F.col("owner_")) == request.profile.strip().lower())
    now = chunks.filter(low(F.col("approval_status")) == "approved").select(
        "document_id", "chunk_id", "content_hash", "approval_id", "approved_content_hash", low(F.col("security_level")).alias("level_"), acl.alias("acl_")
    )
    return rows.join(now, ["document_id", "chunk_id", "content_hash", "approval_id", "approved_content_hash", "level_", "acl_"], "left_semi").select(*[F.col(f"`{c}`") for c in records.columns])


def in_force(records: DataFrame, day: str) -> DataFrame:
    """Of each regulation (profile_id, regulation_id) the records of the version in force on a day with the latest start; records without a regulation or a start stay. The greatest start
    of a regulation is a partial aggregate, whatever its records."""
    on = F.to_date(F.lit(day))
    dated = F.col("regulation_id").isNotNull() & F.col("effective_from").isNotNull()
    rows = records.filter(~dated | effective_on(on, F.to_date("effective_from"), F.to_date("effective_to"), F.to_date("repealed_at")))
    last = rows.filter(dated).groupBy(F.coalesce("profile_id", F.lit("")).alias("p_"), F.col("regulation_id").alias("r_")).agg(F.max(F.to_date("effective_from")).alias("last_"))
    same = (F.coalesce("profile_id", F.lit("")) == F.col("p_")) & (F.col("regulation_id") == F.col("r_"))
    return rows.join(last, same, "left").filter(~dated | (F.to_date("effective_from") == F.col("last_"))).drop("p_", "r_", "last_")


def approved_search(records: DataFrame, chunks: DataFrame, documents: DataFrame, request: Request, index: search.Index | None, record_print: str | None = None) -> DataFrame:
    """The request's k best records with score and model: visible ones in force, by the index, the boosts and the listed definitions, or by the fallbacks of `search.cascade`.
    record_print: the fingerprint of the whole record table, where it is known; an index of another is not used."""
    seen = visible_records(records, chunks, documents, request)
    if request.day:
        seen = in_force(seen, request.day)
    fresh = index if index is not None and index.fingerprint == (record_print or search.fingerprint(records)) else None
    found = search.cascade(seen, request.query, fresh, max(request.k, 3), record_print=fresh.fingerprint if fresh else "")
    if "order_index" in records.columns and "article_title" in records.columns:
        found = search.promoted(found, seen, request.query)
    return found.orderBy(F.desc("score"), "id").limit(request.k)
