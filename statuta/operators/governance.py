"""Visibility, security scans, review, approval, published records and audits."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statuta.functions.text import redact

# Scan rules (id, severity, pattern).
SCAN_RULES = (
    ("resident_registration_number", "high", r"\b\d{6}-[1-4]\d{6}\b"),
    ("account_number", "medium", r"\b\d{2,6}-\d{2,6}-\d{2,8}\b"),
    ("phone_number", "medium", r"\b01[016789]-\d{3,4}-\d{4}\b"),
    ("prompt_injection", "high", r"(?i)(ignore\s+(?:previous|system)\s+instructions|reveal\s+the\s+system\s+prompt)"),
    ("local_path", "medium", r"(?<![A-Za-z])[A-Za-z]:[\\/][^\s\"'<>`]+"),
)
# Levels in ascending order, what a role may see, requests that are refused, local paths, flags and warnings that ask for review.
LEVELS = ("public", "internal", "sensitive", "confidential")
ROLE_LEVELS = {"admin": LEVELS, "operator": LEVELS[:3], "viewer": LEVELS[:1]}
BLOCKED_QUERIES = (
    r"(?i)ignore\s+(?:all\s+)?(?:previous|prior|system)\s+instructions", r"(?i)(?:show|reveal|print|dump)\s+(?:the\s+)?(?:system\s+)?prompt",
    r"(?i)(?:read|open|print)\s+(?:local\s+)?(?:file|path)", r"(?i)(?:execute|run)\s+(?:shell|cmd|powershell|command)",
)
LOCAL_PATHS = (
    r"(?i)\b[A-Z]:[\\/][^\s\"']+", r"(?i)\bfile://[^\s\"']+", r"(?i)(?:^|[\s\"'])(?:/app/|/data/|/home/|/mnt/|/tmp/|/usr/src/app/|/users/|/var/|/workspace/)[^\s\"']+",
    r"(?i)(?:^|[\s\"'])\\\\[^\\/\s]+[\\/][^\s\"']+",
)
REVIEW_FLAGS = ("review_required", "table_review_required", "manual_review_required", "requires_manual_review")
REVIEW_LISTS = ("review_flags", "table_review_flags", "row_quality_flags", "quality_flags")
REVIEW_WARNINGS = ("table", "row", "ocr", "mojibake", "encoding", "caption", "footnote", "endnote", "appendix", "image")
RISKS = ("medium", "high", "critical")
NOT_APPROVABLE = ("security_blocked", "rejected", "superseded")
MATCH_KEY = ("document_id", "chunk_id", "tenant_id", "approval_id", "approved_content_hash")


def scan(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, rule_id, severity, start, end, match_hash): the first match of every rule in a text; places from 0, end exclusive."""
    found = []
    for rule, severity, pattern in SCAN_RULES:
        hit = F.regexp_extract(text, pattern, 0)
        start = F.length(F.regexp_extract(text, f"(?s)^(.*?)(?:{pattern})", 1))  # what stands before the match
        payload = F.to_json(F.struct(F.struct(F.lit(rule).alias("rule_id")).alias("metadata"), hit.alias("text")))
        made = F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), start.alias("start"), (start + F.length(hit)).alias("end"), F.sha2(payload, 256).alias("match_hash"))
        found.append(F.when(F.col(text).rlike(pattern), made))
    return rows.select(key, F.explode(F.array_compact(F.array(*found))).alias("f")).select(key, "f.*")


def blocked(chunks: DataFrame, findings: DataFrame, key: str = "chunk_id") -> DataFrame:
    """chunks after a scan: those with a finding of high severity are security_blocked and lose their approval."""
    hit = findings.filter("severity = 'high'").select(key).distinct().withColumn("hit", F.lit(True))
    rows = chunks.join(hit, key, "left")
    cleared = ("approval_id", "approved_by", "approved_at", "approved_content_hash")
    status = F.when(F.col("hit"), "security_blocked").otherwise(F.col("approval_status")).alias("approval_status")
    return rows.select(*[status if c == "approval_status" else F.when(F.col("hit").isNull(), F.col(c)).alias(c) if c in cleared else F.col(c) for c in chunks.columns])


def query_blocked(query: Column) -> Column:
    """A query that asks for instructions, prompts, files or commands."""
    flat = F.regexp_replace(F.trim(query), r"\s+", " ")
    out = F.lit(False)
    for pattern in BLOCKED_QUERIES:
        out = out | flat.rlike(pattern)
    return F.coalesce(out, F.lit(False))


def path_leaks(rows: DataFrame, key: str) -> DataFrame:
    """(key, field, value): strings of any column, however deep (as JSON), that name a local path."""
    kinds = dict(rows.dtypes)
    texts = {c: F.col(c) if k == "string" else F.to_json(F.col(c)) for c, k in kinds.items() if c != key and (k == "string" or k.startswith(("struct", "array", "map")))}
    leak = lambda c: F.greatest(*[c.rlike(p).cast("int") for p in LOCAL_PATHS]) == 1
    found = F.array_compact(F.array(*[F.when(leak(c), F.struct(F.lit(n).alias("field"), F.substring(c, 1, 240).alias("value"))) for n, c in texts.items()]))
    return rows.select(key, F.explode(found).alias("f")).select(key, "f.*")


def department_ids(value: Column) -> Column:
    """Departments of a comma list, each once: lower case, other signs than letters, digits, . _ - as _."""
    clean = lambda x: F.lower(F.regexp_replace(F.regexp_replace(F.trim(x), "[^A-Za-z0-9._-]+", "_"), "^[._-]+|[._-]+$", ""))
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), clean), lambda x: x != ""))


def tenant_visible(resource: Column, requester: Column) -> Column:
    return F.coalesce((resource != "") & (resource == requester), F.lit(False))


def said(value: Column) -> Column:
    return F.coalesce(F.trim(value) != "", F.lit(False))


def indexable(status: Column, approval_id: Column, content_hash: Column, tenant: Column, level: Column) -> Column:
    """Approved with an approval, the hash of what was approved, a tenant and a level that exists."""
    return F.coalesce(F.lower(F.trim(status)) == "approved", F.lit(False)) & said(approval_id) & said(content_hash) & said(tenant) & F.coalesce(F.lower(F.trim(level)).isin(*LEVELS), F.lit(False))


def provenance_issues(rows: DataFrame, key: str, needed: list[str], hashes: list[str]) -> DataFrame:
    """(key, fields): provenance that is missing, and hashes that are none."""
    missing = [F.when(~said(F.col(c)), F.lit(c)) for c in needed]
    odd = [F.when(said(F.col(c)) & ~F.lower(F.trim(c)).rlike("^[a-f0-9]{64}$"), F.lit(c)) for c in hashes]
    fields = F.array_sort(F.array_distinct(F.array_compact(F.array(*missing, *odd))))
    return rows.select(key, fields.alias("fields")).filter(F.size("fields") > 0)


def review_reasons(chunks: DataFrame) -> Column:
    """Sorted reasons for which a chunk needs a look: flags, lists of flags, parser risk with its flags and advice, warnings."""
    kinds = dict(chunks.dtypes)
    none = F.array().cast("array<string>")
    parts = [F.when(F.coalesce(F.col(c), F.lit(False)), F.array(F.lit(c))).otherwise(none) for c in REVIEW_FLAGS if c in kinds]
    for c in REVIEW_LISTS:
        if c in kinds:
            parts.append(F.coalesce(F.transform(F.filter(F.col(c), lambda x: F.trim(x) != ""), lambda x: F.concat(F.lit(f"{c}:"), F.trim(x))), none))  # noqa: B023
    if "parser_risk" in kinds:
        risky = F.coalesce(F.lower(F.trim("parser_risk")).isin(*RISKS), F.lit(False))
        parts.append(F.when(risky, F.array(F.concat(F.lit("parser_uncertainty_risk_level:"), F.lower(F.trim("parser_risk"))))).otherwise(none))
        if "parser_flags" in kinds:
            parts.append(F.when(risky, F.transform("parser_flags", lambda x: F.concat(F.lit("parser_uncertainty_flags:"), F.trim(x)))).otherwise(none))
        if "parser_advice" in kinds:
            advice = risky & said(F.col("parser_advice")) & (F.col("parser_advice") != "none")
            parts.append(F.when(advice, F.array(F.concat(F.lit("parser_uncertainty_recommendation:"), "parser_advice"))).otherwise(none))
    if "warnings" in kinds:
        asks = lambda x: F.lower(x).rlike("|".join(REVIEW_WARNINGS))
        parts.append(F.coalesce(F.transform(F.filter("warnings", asks), lambda x: F.concat(F.lit("warning:"), F.trim(x))), none))
    return F.array_sort(F.array_distinct(F.concat(none, *parts)))


def approval_errors(chunks: DataFrame, scan_id: Column, acknowledged: Column, override: Column) -> DataFrame:
    """chunks with `error`: the first reason why a chunk may not be approved (null: it may). In order: no scan, blocked by it, an ambiguous boundary, a status
    that cannot be approved, review flags that nobody acknowledged."""
    status = F.lower(F.trim(F.coalesce("approval_status", F.lit("draft"))))
    unclear = F.coalesce("ambiguous_boundary", F.lit(False)) if "ambiguous_boundary" in chunks.columns else F.lit(False)
    flagged = (F.size(review_reasons(chunks)) > 0) & ~F.coalesce(acknowledged, F.lit(False)) & ~said(override)
    error = (
        F.when(~said(scan_id), "scan required")
        .when(status == "security_blocked", "blocked by scan")
        .when(unclear, "ambiguous boundary")
        .when(status.isin(*NOT_APPROVABLE), "not approvable")
        .when(flagged, "review flags")
    )
    return chunks.withColumn("error", error)


def decided(chunks: DataFrame, decision: str, decision_id: str, by: str, at: str, content_hash: Column, reason: str = "") -> tuple[DataFrame, DataFrame]:
    """(chunks, journal) after an approval or a rejection of chunks without error. A rejection needs a reason and clears the approval."""
    if decision not in ("approved", "rejected"):
        raise ValueError(f"no such decision: {decision}")
    if decision == "rejected" and not reason.strip():
        raise ValueError("a rejection needs a reason")
    approve = decision == "approved"
    value = {
        "approval_status": F.lit(decision), "approval_id": F.lit(decision_id if approve else None).cast("string"), "approved_by": F.lit(by if approve else None).cast("string"),
        "approved_at": F.lit(at if approve else None).cast("string"), "approved_content_hash": content_hash if approve else F.lit(None).cast("string"),
    }
    out = chunks.select(*[value[c].alias(c) if c in value else F.col(c) for c in chunks.columns])
    rows = chunks.select("document_id", "chunk_id", "tenant_id", F.lit(decision_id).alias("approval_id"), content_hash.alias("approved_content_hash"), F.lit(decision).alias("decision"), F.lit(at).alias("at"), F.lit(by).alias("actor"), F.lit(reason).alias("reason"), F.col("approval_status").alias("before"))
    return out, rows


def review_status(status: Column) -> Column:
    flat = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    return F.when(flat.isin("draft", "needs_review", "pending", "pending_human_review", ""), "pending_human_review").when(flat.isin("reviewed", "human_reviewed"), "reviewed").otherwise(flat)


def completion(items: DataFrame, group: str, item: str, decision: str, confirmed: Column) -> DataFrame:
    """(group, total, reflected, skipped, remaining, approve_enabled): all distinct items decided ('reflect' or 'skip') and a person's confirmation."""
    once = items.filter(said(F.col(item))).groupBy(group, item).agg(F.max(F.when(F.col(decision).isin("reflect", "skip"), F.col(decision))).alias("d"), F.bool_or(confirmed).alias("ok"))
    n = lambda v: F.count_if(F.col("d") == v)
    out = once.groupBy(group).agg(F.count("*").alias("total"), n("reflect").alias("reflected"), n("skip").alias("skipped"), F.count_if(F.col("d").isNull()).alias("remaining"), F.bool_or("ok").alias("ok"))
    return out.select(group, "total", "reflected", "skipped", "remaining", ((F.col("remaining") == 0) & F.coalesce("ok", F.lit(False))).alias("approve_enabled"))


def journal_approved(chunks: DataFrame, journal: DataFrame) -> DataFrame:
    """Approved chunks that the journal bears out: the one newest event of their document and chunk (approvals and review decisions together) is an approval
    with the same document, chunk, tenant, approval and hash. Two events at the newest time, or one without tenant or time, void it."""
    scope = ["document_id", "chunk_id"]
    void = journal.filter(~said(F.col("tenant_id")) | ~said(F.col("at"))).select(*scope).distinct()
    newest = journal.join(void, scope, "left_anti").groupBy(*scope).agg(F.max("at").alias("at"))
    last = journal.join(newest, [*scope, "at"])
    single = last.groupBy(*scope).agg(F.count("*").alias("n"), F.first(F.struct("decision", *MATCH_KEY[2:])).alias("e")).filter("n = 1 and e.decision = 'approved'")
    match = single.select(*scope, *[F.col(f"e.{c}").alias(c) for c in MATCH_KEY[2:]])
    whole = match.filter(" and ".join(f"coalesce(trim({c}), '') <> ''" for c in MATCH_KEY[2:]))
    return chunks.filter(F.lower(F.trim("approval_status")) == "approved").join(whole, list(MATCH_KEY), "left_semi")


def export_errors(exported: DataFrame, repository: DataFrame, journal: DataFrame) -> DataFrame:
    """(document_id, chunk_id, error) of exported records that do not agree with the repository's chunk and its approval."""
    fields = ("approval_id", "approved_content_hash", "tenant_id", "security_level")
    known = repository.select("document_id", "chunk_id", F.col("approval_status").alias("r_status"), *[F.col(c).alias(f"r_{c}") for c in fields])
    held = journal_approved(repository, journal).select("document_id", "chunk_id", F.lit(True).alias("held"))
    rows = exported.join(known, ["document_id", "chunk_id"], "left").join(held, ["document_id", "chunk_id"], "left")
    same = F.lower(F.trim("r_status")) == "approved"
    for c in fields:
        same = same & F.lower(F.trim(F.col(c))).eqNullSafe(F.lower(F.trim(F.col(f"r_{c}"))))
    no_key = ~said(F.col("document_id")) | ~said(F.col("chunk_id"))
    error = F.when(no_key, "no key").when(F.col("r_status").isNull(), "not in repository").when(~F.coalesce(same, F.lit(False)), "other approval state").when(F.col("held").isNull(), "not in journal")
    return rows.select("document_id", "chunk_id", error.alias("error")).filter("error is not null")


@F.pandas_udf(T.StringType())
def canonical_sha256(payload: pd.Series) -> pd.Series:
    """sha256 of a JSON text written with sorted keys and no blanks, so equal values have one hash whatever their order."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        flat = json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        return hashlib.sha256(flat.encode()).hexdigest()

    return payload.map(one)


def verification_hashes(records: DataFrame, text: str, metadata: str) -> DataFrame:
    """records with content_hash, metadata_fingerprint, record_fingerprint and verification_hash (version 2), of id, document_id, chunk_id, tenant_id, a text
    and a metadata column (struct or map). Every one is a hash of canonical JSON."""
    meta = F.to_json(F.col(metadata))
    body = lambda **parts: F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v) for k, v in parts.items()]), F.lit("}"))
    text_of = lambda c: F.regexp_replace(F.to_json(F.struct(F.coalesce(F.col(c), F.lit("")).alias("v"))), r"(?s)^\{\"v\":(.*)\}$", "$1")
    keys = {c: text_of(c) for c in ("id", "document_id", "chunk_id", "tenant_id")}
    rows = records.withColumn("content_hash", canonical_sha256(body(text=text_of(text), metadata=meta)))
    rows = rows.withColumn("metadata_fingerprint", canonical_sha256(body(version=F.lit('"metadata-v1"'), metadata=meta)))
    rows = rows.withColumn("record_fingerprint", canonical_sha256(body(version=F.lit('"record-v1"'), text=text_of(text), metadata=text_of("metadata_fingerprint"), **keys)))
    return rows.withColumn("verification_hash", canonical_sha256(body(version=F.lit('"v2"'), content=text_of("content_hash"), metadata=text_of("metadata_fingerprint"), record=text_of("record_fingerprint"), **keys)))


def published(chunks: DataFrame, allowed: list[str]) -> DataFrame:
    """Vector records of indexable chunks with a text: id 'document:chunk', text, and the allowed metadata as a struct. The canonical path, where there is one,
    is the hierarchy path; missing lifecycle fields come from their older names."""
    first = lambda *names: F.coalesce(*[F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in chunks.columns], F.lit(None).cast("string"))
    filled = {
        "regulation_id": first("regulation_id", "regulation_no"),
        "regulation_version": first("regulation_version", "version", "revision_date", "valid_from", "effective_date"),
        "effective_from": first("effective_from", "valid_from", "effective_date", "revision_date"),
        "source_hierarchy_path": first("source_hierarchy_path", "hierarchy_path"),
        "hierarchy_path": first("canonical_hierarchy_path", "hierarchy_path"),
    }
    rows = chunks.filter(indexable(*[F.col(c) for c in ("approval_status", "approval_id", "approved_content_hash", "tenant_id", "security_level")]))
    text = F.coalesce(F.nullif(F.trim("retrieval_text"), F.lit("")), F.nullif(F.trim("normalized_text"), F.lit("")), F.trim("text"))
    fields = [filled.get(c, F.col(c) if c in chunks.columns else F.lit(None).cast("string")).alias(c) for c in dict.fromkeys([*allowed, *filled, "effective_to", "repealed_at"])]
    return rows.select(
        F.concat_ws(":", "document_id", "chunk_id").alias("id"), "document_id", "chunk_id", "tenant_id", text.alias("text"), F.struct(*fields).alias("metadata")
    ).filter("text <> ''")


def export_summary(records: DataFrame, temporal: list[str]) -> DataFrame:
    """One row: records, documents, repeated ids, records with each temporal field, and with a local path in any string."""
    ids = records.groupBy("id").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("duplicate_ids"))
    has = [F.count_if(said(F.col(f"metadata.{c}").cast("string"))).alias(f"with_{c}") for c in temporal]
    leaks = path_leaks(records, "id").agg(F.count("*").alias("path_leaks"))
    return records.agg(F.count("*").alias("records"), F.count_distinct("document_id").alias("documents"), *has).crossJoin(ids).crossJoin(leaks)  # one row each


def visibility_audit(repository: DataFrame, indexed: DataFrame, visible_ids: DataFrame) -> DataFrame:
    """(document_id, approved, indexed, visible, status) per document: how many chunks are approved, in the index and seen by the caller."""
    a = repository.filter("approval_status = 'approved'").select("document_id", "chunk_id", F.lit(1).alias("a"))
    i = indexed.select("document_id", "chunk_id", F.lit(1).alias("i"))
    v = visible_ids.select("document_id", "chunk_id", F.lit(1).alias("v"))
    both = a.join(i, ["document_id", "chunk_id"], "full_outer").join(v, ["document_id", "chunk_id"], "full_outer")
    out = both.groupBy("document_id").agg(F.count("a").alias("approved"), F.count("i").alias("indexed"), F.count("v").alias("visible"), F.count_if(F.col("a").isNull() & F.col("i").isNotNull()).alias("stale"))
    status = F.when(F.col("stale") > 0, "stale").when(F.col("indexed") < F.col("approved"), "missing").when(F.col("visible") == 0, "hidden").when(F.col("visible") < F.col("indexed"), "partly").otherwise("ok")
    return out.withColumn("status", status)


def purge_plan(tables: dict[str, DataFrame], institution: str, value: str) -> DataFrame:
    """(table, rows, documents) that a purge of one institution would delete, counted before anything is."""
    out = None
    for name, df in tables.items():
        mine = df.filter(F.col(institution) == value).agg(F.lit(name).alias("table"), F.count("*").alias("rows"), F.count_distinct("document_id").alias("documents"))
        out = mine if out is None else out.unionByName(mine)
    return out


def audit_events(events: DataFrame, detail: str) -> DataFrame:
    """Audit events with secrets and paths redacted from their detail, and an id that is the same for the same event."""
    clean = events.withColumn(detail, redact(F.col(detail)))
    return clean.withColumn("event_id", F.sha2(F.to_json(F.struct(*sorted(clean.columns))), 256))


def visible(level: Column, levels: list[str], acl: Column, departments: list[str], approved: Column) -> Column:
    """Approved, of an allowed level, and open to all departments or to one of these."""
    mine = F.array(*[F.lit(d) for d in departments]).cast("array<string>")
    return approved & level.isin(*levels) & ((F.size(acl) == 0) | F.arrays_overlap(acl, mine))


def fully_visible(rows: DataFrame, unit: str, seen: Column) -> DataFrame:
    """Units of which every row is visible."""
    return rows.groupBy(unit).agg(F.bool_and(F.coalesce(seen, F.lit(False))).alias("ok"), F.count("*").alias("n")).filter("ok").select(unit, "n")
