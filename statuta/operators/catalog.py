"""The catalog of documents: lifecycle fields, loads by key as of a day, units of a revision, hashes, evaluation, manifests and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.functions.dates import effective_on
from statuta.operators.lifecycle import latest_in_force

# Names under which lifecycle fields come, in order of precedence.
ALIASES = {
    "profile_id": ("profile_id",),
    "regulation_id": ("regulation_id",),
    "version": ("version", "regulation_version", "revision", "revision_date", "valid_from", "effective_date"),
    "effective_from": ("effective_from", "effective_date_from", "effective_start_date", "valid_from", "effective_date", "revision_date"),
    "effective_to": ("effective_to", "effective_date_to", "effective_end_date", "valid_to"),
    "repealed_at": ("repealed_at",),
    "status": ("regulation_status", "approval_status", "status"),
}
DATES = ("effective_from", "effective_to", "repealed_at")
RISKS = ("low", "medium", "high", "critical")


def lifecycle_fields(documents: DataFrame, keep: list[str]) -> DataFrame:
    """keep and the lifecycle fields of documents, each from the first of its names that says something; of dates the first that is one."""

    def read(name: str) -> Column:
        texts = [F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in ALIASES[name] if c in documents.columns]
        if name in DATES:
            texts = [F.try_to_date(F.substring(t, 1, 10), "yyyy-MM-dd") for t in texts]
        return F.coalesce(*texts, F.lit(None).cast("date" if name in DATES else "string")).alias(name)

    return documents.select(*keep, *[read(n) for n in ALIASES])


def grouped_versions(documents: DataFrame) -> DataFrame:
    """(profile_id, regulation_id, n, versions): documents by regulation; unknown keys are a group too."""
    return documents.groupBy("profile_id", "regulation_id").agg(F.count("*").alias("n"), F.count_distinct("version").alias("versions"))


def loaded(records: DataFrame, keys: dict[str, str], day: Column, unit: str = "regulation_id", version: str = "version") -> DataFrame:
    """Records with the given keys, of the version of each unit in force on a day. Equality filters reach the scan."""
    rows = records
    for name, value in keys.items():
        rows = rows.filter(F.col(name) == value)
    versions = rows.select(unit, version, "effective_from", "effective_to", "repealed_at").distinct()
    live = latest_in_force(versions, unit, day, "effective_from", F.col("effective_to"), F.col("repealed_at"), [F.desc("effective_from"), F.desc(version)])
    return rows.join(live.select(unit, version), [unit, version], "left_semi")


def in_force(day: Column) -> Column:
    return effective_on(day, F.col("effective_from"), F.col("effective_to"), F.col("repealed_at"))


def canonical_order() -> list[Column]:
    """An order of records that does not depend on when they came: profile, regulation, version, path, number, id."""
    return [F.coalesce(F.lower(c), F.lit("")) for c in ("profile_id", "regulation_id", "version", "hierarchy_path", "article_no", "id")]


def logical_hash(records: DataFrame, fields: list[str]) -> DataFrame:
    """(n, logical_hash) of a corpus, the same however it is packed: digests of the canonical records, counted by their first bytes, each bucket hashed in order, the
    buckets hashed in order. A bucket is a small share of the corpus (1 in 4,096)."""
    digest = F.sha2(F.to_json(F.struct(*sorted(fields))), 256)
    rows = records.select(digest.alias("d")).groupBy("d").agg(F.count("*").alias("n"))
    cells = rows.groupBy(F.substring("d", 1, 3).alias("b")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "d", "n"))), "\n"), 256).alias("h"))
    return cells.agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), "\n"), 256).alias("logical_hash"))


def revision_units(chunks: DataFrame, key: list[str]) -> DataFrame:
    """Units of a document version: the texts of a unit's chunks in page and id order, pages, and a hash of what the unit says."""
    part = F.struct(F.coalesce("page", F.lit(0)).alias("page"), "chunk_id", "text")
    rows = chunks.groupBy(*key).agg(F.array_sort(F.collect_list(part)).alias("parts"), F.min("page").alias("page_start"), F.max("page").alias("page_end"))
    text = F.trim(F.regexp_replace(F.array_join(F.transform("parts", lambda p: p["text"]), " "), r"(?U)\s+", " "))
    rows = rows.withColumn("text", text)
    return rows.select(*key, F.size("parts").alias("n_chunks"), F.transform("parts", lambda p: p["chunk_id"]).alias("chunk_ids"), "page_start", "page_end", "text", F.sha2(F.to_json(F.struct(*key, "text")), 256).alias("content_hash"))


def structure_scores(found: DataFrame, labelled: DataFrame, key: list[str]) -> DataFrame:
    """key, precision, recall and f1 in percent of detected counts against labelled ones: what both count is right, null where there is nothing to divide by."""
    both = found.select(*key, F.col("n").alias("f")).join(labelled.select(*key, F.col("n").alias("l")), key, "full_outer").fillna(0, ["f", "l"])
    right = F.least("f", "l")
    rows = both.withColumn("precision", F.round(100 * F.try_divide(right, F.col("f")), 2)).withColumn("recall", F.round(100 * F.try_divide(right, F.col("l")), 2))
    p, r = F.col("precision"), F.col("recall")
    return rows.select(*key, "precision", "recall", F.when(p.isNotNull() & r.isNotNull(), F.when(p + r <= 0, 0.0).otherwise(F.round(2 * p * r / (p + r), 2))).alias("f1"))


def law_report(edges: DataFrame, most: int = 20) -> DataFrame:
    """(law, citations, documents, articles) of the most cited laws; a top-k report."""
    return edges.groupBy("law").agg(F.count("*").alias("citations"), F.count_distinct("document_id").alias("documents"), F.count_distinct("article").alias("articles")).orderBy(F.desc("citations"), "law").limit(most)


def attention_report(chunks: DataFrame, reasons: str) -> DataFrame:
    """(reason, chunks, documents): what the chunks with reasons need looking at for."""
    return chunks.select("document_id", "chunk_id", F.explode(F.array_distinct(reasons)).alias("reason")).groupBy("reason").agg(F.count("*").alias("chunks"), F.count_distinct("document_id").alias("documents"))


def usable_rows(manifest: DataFrame) -> DataFrame:
    """Rows of a batch report that need no character recognition and did not fail."""
    return manifest.filter(~F.coalesce("ocr_required", F.lit(False)) & (F.coalesce("status", F.lit("")) != "failed"))


def retry_manifest(runs: DataFrame, retriable: tuple[str, ...]) -> DataFrame:
    """Documents whose latest run failed for a reason that may pass, with the number of tries so far."""
    last = runs.groupBy("document_id").agg(F.max_by(F.struct("status", "category"), "run").alias("r"), F.count("*").alias("tries"))
    return last.filter((F.col("r.status") == "failed") & F.col("r.category").isin(*retriable)).select("document_id", F.col("r.category").alias("category"), "tries")


def with_profile(rows: DataFrame, profiles: DataFrame, default: str | None, fields: list[str]) -> DataFrame:
    """rows with the fields of their institution's profile where their own are blank, and `missing`: required fields (profiles.required) still blank. A row without
    a profile takes the default one; the profile table is small and is counted before it is broadcast."""
    key = F.regexp_replace(F.lower(F.trim(F.coalesce(F.nullif(F.trim("profile_id"), F.lit("")), F.lit(default)))), "[^0-9a-z_-]+", "-")
    few = profiles.limit(10_001).count() <= 10_000
    side = profiles.select(F.col("profile_id").alias("pid"), "required", *[F.col(f).alias(f"p_{f}") for f in fields])
    out = rows.withColumn("pid", key).join(F.broadcast(side) if few else side, "pid", "left")
    values = {f: F.coalesce(F.nullif(F.trim(f), F.lit("")), F.col(f"p_{f}")) for f in fields}
    out = out.select(*[F.col("pid").alias("profile_id") if c == "profile_id" else values[c].alias(c) if c in values else F.col(c) for c in rows.columns], "required")
    gaps = F.array_compact(F.array(*[F.when(F.array_contains("required", f) & F.col(f).isNull(), F.lit(f)) for f in fields]))
    return out.withColumn("missing", F.coalesce(gaps, F.array().cast("array<string>"))).drop("required")


def uncertainty(source: Column, risk: Column, flags: Column, confidence: Column, advice: Column) -> Column:
    """A parser's stamp: source, risk (medium where it is none of the four), confidence from 0 to 1 to three places, flags in order, advice."""
    level = F.lower(F.trim(risk))
    sure = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(confidence.try_cast("double"), F.lit(0.0)))), 3)
    clean = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(flags, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")))
    return F.struct(F.lower(F.trim(source)).alias("source"), F.when(level.isin(*RISKS), level).otherwise("medium").alias("risk_level"), sure.alias("confidence"), clean.alias("flags"), F.coalesce(F.nullif(F.trim(advice), F.lit("")), F.lit("none")).alias("recommendation"))


def admitted(files: DataFrame, most_bytes: int) -> DataFrame:
    """Uploaded files (path, length, content) with sha256 and error: an unknown extension, an empty or too large file, or bytes that are not of the kind."""
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    head = F.hex(F.substring("content", 1, 8))
    magic = F.when(kind.isin("docx", "hwpx"), head.startswith("504B0304")).when(kind == "pdf", head.startswith("25504446")).when(kind == "hwp", head.startswith("D0CF11E0A1B11AE1")).when(kind.isin("txt", "md", "hml", "hwpml"), F.lit(True))
    error = F.when(magic.isNull(), "unknown kind").when(F.col("length") == 0, "empty").when(F.col("length") > most_bytes, "too large").when(~magic, "other bytes than its kind")
    return files.select("path", "length", kind.alias("kind"), F.sha2("content", 256).alias("sha256"), error.alias("error"))


def flat_export(chunks: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Chunks as flat rows: the fields of a metadata struct beside the others (own columns win), defaults where a field is missing."""
    meta = [f.name for f in chunks.schema["metadata"].dataType.fields] if "metadata" in chunks.columns else []
    own = [c for c in chunks.columns if c != "metadata"]
    out = chunks.select(*own, *[F.col(f"metadata.{c}").alias(c) for c in meta if c not in own])
    for name, value in defaults.items():
        out = out.withColumn(name, F.coalesce(F.col(name).cast("string"), F.lit(value)) if name in out.columns else F.lit(value))
    return out


def export_manifest(rows: DataFrame, kind: str, error: str) -> DataFrame:
    """One row: how many of each kind (a map), all rows, and whether any has an error."""
    counts = rows.groupBy(kind).agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.trim(error) != "", F.lit(False))).alias("e"))
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "n")))).alias("counts"), F.sum("n").alias("n"), (F.sum("e") > 0).alias("has_errors"))


def upload_manifest(records: DataFrame, collection: str, batch: int = 256) -> DataFrame:
    """What an upload to a vector store would send: points, batches, dimensions and payload bytes. Nothing is sent."""
    return records.agg(
        F.lit(collection).alias("collection"), F.count("*").alias("points"), F.ceil(F.count("*") / batch).alias("batches"), F.min(F.size("vector")).alias("least_dimensions"),
        F.max(F.size("vector")).alias("most_dimensions"), F.sum(F.octet_length(F.to_json("payload"))).alias("payload_bytes"), F.lit(True).alias("dry_run"),
    )


def boundary_errors(chunks: DataFrame) -> DataFrame:
    """(document_id, n) of documents that an index must refuse: chunks of a combined book whose boundary is ambiguous."""
    flag = F.coalesce("ambiguous_boundary", F.lit(False)) | F.coalesce(F.array_contains("warnings", "ambiguous_combined_book_boundary_requires_reparse"), F.lit(False))
    return chunks.filter(flag).groupBy("document_id").agg(F.count("*").alias("n"))


def backfill_report(before: DataFrame, after: DataFrame, fields: list[str]) -> DataFrame:
    """(field, filled_before, filled_after, gained) of temporal fields."""
    count = lambda df, out: df.agg(*[F.count(f).alias(f) for f in fields]).unpivot([], fields, "field", out)
    return count(before, "filled_before").join(count(after, "filled_after"), "field").withColumn("gained", F.col("filled_after") - F.col("filled_before"))


def evidence_errors(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """(batch_id, error) of review batches whose evidence does not hold: another manifest hash, another set of chunks (by the fingerprint of their ids and hashes), or
    chunks that are not there. claims: batch_id, manifest_hash, expected_hash, chunk_fingerprint; chunks: batch_id, chunk_id, content_hash."""
    lines = F.array_sort(F.collect_list(F.concat_ws(":", "chunk_id", "content_hash")))  # one batch, bounded by its size
    now = chunks.groupBy("batch_id").agg(F.sha2(F.array_join(lines, "\n"), 256).alias("now"))
    rows = claims.join(now, "batch_id", "left")
    error = F.when(F.col("manifest_hash") != F.col("expected_hash"), "manifest changed").when(F.col("now").isNull(), "chunks missing").when(F.col("now") != F.col("chunk_fingerprint"), "chunks changed")
    return rows.select("batch_id", error.alias("error")).filter("error is not null")
