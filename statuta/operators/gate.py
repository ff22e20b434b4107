"""The quality gate of a document: measures of its chunks, nodes and source text, 17 checks, the score and recommendations.

Frames use these columns. Chunks: document_id, chunk_id, chunk_type, text, normalized_text, retrieval_text, order_index, source_page_start,
source_page_end, source_node_ids, warnings and metadata columns. Nodes: document_id, node_id, node_type, number, title, parent_id. Every measure is one
aggregation by document; the line check brings pieces of a document's text together.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.functions.text import compact
from statuta.operators.numbering import running
from statuta.operators.quality import score
from statuta.session import shared_folder, written

# Metadata that every chunk has; fields whose coverage is counted; table scaffold; lines shorter than this are not looked for.
REQUIRED = ("document_name", "source_file", "hierarchy_path", "chunk_type")
COVERED = (
    "references", "article_refs", "regulation_article_refs", "appendix_refs", "form_refs", "external_law_refs", "revision_events", "revision_history",
    "effective_date", "revision_date", "valid_from", "article_effective_overrides", "supplementary_identifier_date", "supplementary_paragraph_label",
    "supplementary_boilerplate",
)
SCAFFOLD = r"[|+\-─-╿]+"
SHORTEST_LINE = 12
END_OF_LINE = r"\r\n|[\n\r]"
#: Characters of a document's text in which lines are sought at once; any odd number of 64 bits for hashes.
PIECE = 1 << 21
HASH_BASE = 0x9E3779B97F4A7C15
CONTEXT_HEADER = r"(?s)\A.*?\[본문\]\s*"
PRIVATE_USE = r"[-]"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"


@dataclass(frozen=True)
class Profile:
    """Thresholds of an institution; out-of-range values raise ValueError."""

    coverage_ratio_min: float = 0.80
    coverage_ratio_max: float = 1.30
    table_false_positive_attention_max_count: int = 6
    table_false_positive_attention_max_ratio: float = 0.15

    def __post_init__(self) -> None:
        if not 0 <= self.coverage_ratio_min <= self.coverage_ratio_max:
            raise ValueError("coverage ratios must be 0 or more, the least first")
        if self.table_false_positive_attention_max_count < 0 or not 0 <= self.table_false_positive_attention_max_ratio <= 1:
            raise ValueError("table limits are a count and a share")


def read_profiles(content: bytes) -> tuple[Profile, dict[str, Profile]]:
    """The default profile and those of a JSON configuration, by lower-cased id; fields that are not known raise ValueError."""
    raw = json.loads(content)
    known = {f.name for f in fields(Profile)}

    def made(values: dict, base: Profile) -> Profile:
        if not isinstance(values, dict) or set(values) - known:
            raise ValueError(f"unknown profile fields: {sorted(set(values) - known)}")
        return Profile(**{**asdict(base), **values})

    if not isinstance(raw, dict) or set(raw) - {"default", "profiles"}:
        raise ValueError("a profile configuration holds default and profiles")
    default = made(raw.get("default", {}), Profile())
    return default, {name.strip().lower(): made(values, default) for name, values in raw.get("profiles", {}).items()}


def profile_table(spark: SparkSession, default: Profile, profiles: dict[str, Profile]) -> DataFrame:
    """(profile_id, thresholds); a null profile_id is the default."""
    names = [f.name for f in fields(Profile)]
    rows = [(key, *[float(getattr(p, n)) for n in names]) for key, p in [(None, default), *profiles.items()]]
    return spark.createDataFrame(rows, "profile_id string, " + ", ".join(f"{n} double" for n in names))


def filled(value: Column, kind: str = "string") -> Column:
    """A value that says something: not null, not blank, not an empty list, not false."""
    if kind.startswith(("array", "map")):
        return F.coalesce(F.size(value) > 0, F.lit(False))
    return F.coalesce(value if kind == "boolean" else F.trim(value.cast("string")) != "", F.lit(False))


def missing_metadata(chunks: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """(document_id, chunks_missing_metadata, fields_missing_metadata)."""
    kinds = dict(chunks.dtypes)
    gaps = [(~filled(F.col(c), kinds[c])).cast("int") if c in kinds else F.lit(1) for c in required]
    total = sum(gaps[1:], gaps[0])
    return chunks.groupBy("document_id").agg(F.count_if(total > 0).alias("chunks_missing_metadata"), F.sum(total).alias("fields_missing_metadata"))


def metadata_coverage(chunks: DataFrame, names: tuple[str, ...] = COVERED) -> DataFrame:
    """(document_id, chunks_with_<name> of every field)."""
    kinds = dict(chunks.dtypes)
    return chunks.groupBy("document_id").agg(
        *[(F.count_if(filled(F.col(n), kinds[n])) if n in kinds else F.lit(0).cast("long")).alias(f"chunks_with_{n}") for n in names]
    )


def table_metrics(chunks: DataFrame) -> DataFrame:
    """18 measures of the tables among a document's chunks. table_cell_rows: array of (review_required, row_quality_flags)."""
    like = F.coalesce(F.col("table_like"), F.lit(False))
    cells, raw = F.coalesce(F.size("table_cell_rows"), F.lit(0)), F.coalesce(F.size("table_rows"), F.lit(0))
    cells, raw = F.greatest(cells, F.lit(0)), F.greatest(raw, F.lit(0))
    wrong = F.coalesce(F.col("table_classification").startswith("probable_false_positive"), F.lit(False))
    stable = F.coalesce(F.col("table_false_positive_stability") == "stable", F.lit(False))
    flagged = F.filter("table_cell_rows", lambda r: F.coalesce(r["review_required"], F.lit(False)) | (F.coalesce(F.size(r["row_quality_flags"]), F.lit(0)) > 0))
    to_review = F.coalesce(F.exists("table_cell_rows", lambda r: F.coalesce(r["review_required"], F.lit(False))), F.lit(False))
    path = F.coalesce("hierarchy_path", F.lit(""))
    cited = filled(F.col("table_citation_label")) | filled(F.col("table_appendix_no")) | path.contains("별표") | path.contains("별지")
    n = lambda test: F.count_if(test)
    rows = F.coalesce(F.sum(F.when(like, cells)), F.lit(0))
    return chunks.groupBy("document_id").agg(
        n(like).alias("table_like_chunks"),
        n(like & (cells > 0)).alias("chunks_with_table_cell_rows"),
        n(like & (cells > 0)).alias("chunks_with_table_rows"),
        n(like & (cells == 0)).alias("table_like_without_cell_rows"),
        rows.alias("table_cell_row_count"),
        rows.alias("table_row_count"),
        F.coalesce(F.sum(F.when(like, raw)), F.lit(0)).alias("table_raw_row_count"),
        F.coalesce(F.max(F.when(like, F.col("table_column_count"))), F.lit(0)).alias("max_table_column_count"),
        F.coalesce(F.round(F.avg(F.when(like, F.coalesce("table_confidence", F.lit(0.0)))), 3), F.lit(0.0)).alias("avg_table_confidence"),
        n(wrong).alias("probable_table_false_positive_chunks"),
        n(wrong & stable).alias("stable_table_false_positive_chunks"),
        n(wrong & ~stable).alias("table_false_positive_attention_chunks"),
        n(F.coalesce(F.col("table_classification") == "probable_table_extraction_failed", F.lit(False))).alias("probable_table_extraction_failed_chunks"),
        n(like & (F.coalesce("table_review_required", F.lit(False)) | to_review)).alias("table_review_required_chunks"),
        F.coalesce(F.sum(F.when(like, F.greatest(F.size(flagged), F.lit(0)))), F.lit(0)).alias("table_review_required_row_count"),
        n(like & (cells > 0) & cited).alias("table_citation_ready_chunks"),
        n(like & F.coalesce(F.col("source_page_start") != F.col("source_page_end"), F.lit(False))).alias("multi_page_table_like_chunks"),
        n(like & ((F.col("chunk_type") == "appendix") | path.contains("별표"))).alias("appendix_table_like_chunks"),
    )


def owners(nodes: DataFrame, kind: str = "regulation", depth: int = 16) -> DataFrame:
    """(document_id, node_id, owner): the nearest node of a kind at or above each node, by pointer doubling: log2(depth) joins."""
    at = F.when(F.col("node_type") == kind, F.col("node_id")).otherwise(F.col("parent_id"))
    found = nodes.select("document_id", "node_id", at.alias("owner"), (F.col("node_type") == kind).alias("own"))
    step = 1
    while step < depth:
        above = found.select("document_id", F.col("node_id").alias("owner"), F.col("owner").alias("next"), F.col("own").alias("stop"))
        found = found.join(above, ["document_id", "owner"], "left").select(
            "document_id", "node_id", F.when(F.col("stop"), F.col("owner")).otherwise(F.col("next")).alias("owner"), "own"
        )
        step *= 2
    real = nodes.filter(F.col("node_type") == kind).select("document_id", F.col("node_id").alias("owner"))
    return found.join(real, ["document_id", "owner"], "left_semi").select("document_id", "node_id", "owner")


def structure_metrics(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Numbers, identities, titles and parents of a document's regulations, and how far they reach its chunks."""
    of = lambda kind: F.count_if(F.col("node_type") == kind)
    by_node = nodes.groupBy("document_id").agg(
        of("regulation").alias("regulation_node_count"),
        *[of(k).alias(f"{k}_node_count") for k in ("article", "appendix", "form", "supplementary")],
    )
    numbered = nodes.filter((F.col("node_type") == "regulation") & filled(F.col("number")))
    title = F.regexp_replace(F.coalesce("title", F.lit("")), r"(?U)\s+", "")
    identities = numbered.groupBy("document_id", "number", title.alias("title")).agg(F.count("*").alias("n"), F.collect_set(F.coalesce("parent_id", F.lit(""))).alias("parents"))
    numbers = identities.groupBy("document_id", "number").agg(
        F.count("*").alias("titles"), F.sum("n").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_list("parents")))).alias("parents")
    )
    by_number = numbers.groupBy("document_id").agg(
        F.count("*").alias("unique_regulation_no_count"),
        F.sum("titles").alias("unique_regulation_identity_count"),
        F.sum(F.col("n") - F.col("titles")).alias("duplicate_regulation_node_count"),
        F.sum(F.col("titles") - 1).alias("regulation_title_variant_count"),
        F.count_if(F.col("parents") > 1).alias("same_regulation_multiple_parent_count"),
    )
    reached = chunks.select("document_id", F.explode("source_node_ids").alias("node_id")).distinct().join(owners(nodes), ["document_id", "node_id"])
    regulations = nodes.filter("node_type = 'regulation'").select("document_id", F.col("node_id").alias("owner"))
    lonely = regulations.join(reached, ["document_id", "owner"], "left_anti").groupBy("document_id").agg(F.count("*").alias("zero_chunk_regulation_node_count"))
    told = chunks.filter(filled(F.col("regulation_no"))).select("document_id", F.col("regulation_no").alias("number")).distinct()
    silent = numbers.join(told, ["document_id", "number"], "left_anti").groupBy("document_id").agg(F.count("*").alias("detected_reg_no_without_chunk_metadata_count"))
    has = filled(F.col("regulation_no"))
    fallback = F.coalesce("structure_fallback", F.lit(False)) | F.coalesce(F.array_contains("warnings", "structure_fallback_document_chunk"), F.lit(False))
    by_chunk = chunks.groupBy("document_id").agg(
        F.count_if(has).alias("chunks_with_regulation_metadata"),
        F.count_distinct(F.when(has, F.col("regulation_no"))).alias("unique_chunk_regulation_no_count"),
        F.count_if(~has).alias("chunks_missing_regulation_no"),
        F.count_if(~has & (F.col("chunk_type") == "article")).alias("article_chunks_missing_regulation_no"),
        F.count_if(fallback).alias("structure_fallback_chunk_count"),
        F.count_if(F.coalesce(F.size("source_node_ids"), F.lit(0)) <= 0).alias("chunks_without_source_nodes"),
    )
    out = by_chunk.join(by_node, "document_id", "full_outer")
    for part in (by_number, lonely, silent):
        out = out.join(part, "document_id", "left")
    return out.fillna(0)


def body_of(chunks: DataFrame) -> Column:
    return F.coalesce(F.nullif(F.col("normalized_text"), F.lit("")), F.col("text"), F.lit(""))


def content(text: Column) -> Column:
    """A text without white space and table scaffold."""
    return F.regexp_replace(compact(text), SCAFFOLD, "")


def text_metrics(chunks: DataFrame) -> DataFrame:
    """Chunks with replacement, control and private-use characters, and with a context header for a text."""
    text, body = F.coalesce("text", F.lit("")), body_of(chunks)
    return chunks.groupBy("document_id").agg(
        F.count_if(text.contains("�")).alias("replacement_char_chunks"),
        F.count_if(text.rlike(CONTROL)).alias("control_char_chunks"),
        F.count_if(text.startswith("[위치]")).alias("context_header_chunks"),
        F.count_if(body.rlike(PRIVATE_USE)).alias("private_use_char_chunks"),
        F.sum(F.length(body) - F.length(F.regexp_replace(body, PRIVATE_USE, ""))).alias("private_use_char_count"),
    )


def hashed(text: str):
    """A function of places and sizes (arrays): hashes of these stretches of a text, equal for equal stretches wherever they stand."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * np.cumprod(np.full(len(codes), HASH_BASE, np.uint64)))])
        back = np.cumprod(np.full(len(codes), pow(HASH_BASE, -1, 1 << 64), np.uint64))

    def stretch(at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (sums[at + size] - sums[at]) * back[at]

    return stretch


def held_lines(text: str, lines: list[str], least: int = SHORTEST_LINE) -> np.ndarray:
    """Which of the lines, of `least` characters or more, occur in a text. Only places where a line's first characters stand are looked at, once for each length
    that lines have; what has the hash of a line is compared with it."""
    sizes = np.array([len(x) for x in lines], np.int64)
    out = np.zeros(len(lines), bool)
    if len(text) < least or not len(lines):
        return out
    of_text, of_lines = hashed(text), hashed("".join(lines))
    starts = np.cumsum(sizes) - sizes
    heads, wholes = of_lines(starts, least), of_lines(starts, sizes)
    known, places = np.unique(heads), np.arange(len(text) - least + 1)
    begun = of_text(places, least)
    at = np.searchsorted(known, begun)
    places = places[known[np.minimum(at, len(known) - 1)] == begun]
    for size in np.unique(sizes):
        fits = places[places + size <= len(text)]
        found = of_text(fits, size)
        order = np.argsort(found, kind="stable")
        found, fits = found[order], fits[order]
        own = np.flatnonzero(sizes == size)
        for i, low, high in zip(own, np.searchsorted(found, wholes[own], "left"), np.searchsorted(found, wholes[own], "right"), strict=True):
            out[i] = any(text.startswith(lines[i], p) for p in fits[low:high])
    return out


def line_metrics(chunks: DataFrame, sources: DataFrame, piece: int = PIECE) -> DataFrame:
    """(document_id, source_lines_checked, source_lines_missing_count). A source line is found where a chunk has it as a line; the others are sought in what the
    chunks of the document are put one after another, with and without their context headers.

    That text is cut into pieces of `piece` characters, each with as many more as the longest line sought, so neither a document's text nor its lines times its chunks meet."""
    folder = shared_folder(chunks.sparkSession)
    body = body_of(chunks)
    indexed = F.coalesce(F.nullif(F.col("retrieval_text"), F.lit("")), body)
    lines = sources.select("document_id", F.explode(F.split("source_text", END_OF_LINE)).alias("line")).groupBy("document_id", content(F.col("line")).alias("line"))
    lines = lines.agg(F.count_if(F.length(compact(F.col("line"))) >= SHORTEST_LINE).alias("checked"), F.count("*").alias("n"))
    lines = written(lines, folder, "lines")
    parts = F.transform(F.split(indexed, END_OF_LINE), content)
    read = chunks.select("document_id", "order_index", content(F.regexp_replace(body, CONTEXT_HEADER, "")).alias("bare"), parts.alias("parts"))
    read = written(read, folder, "chunks")
    own = read.select("document_id", F.explode("parts").alias("line"))
    sought = lines.filter(F.length("line") >= SHORTEST_LINE).select("document_id", "line", "n")
    sought = written(sought.join(own, ["document_id", "line"], "left_anti"), folder, "sought")
    longest = sought.groupBy("document_id").agg(F.max(F.length("line")).alias("longest"))
    sides = F.array(*[F.struct(F.lit(i).alias("side"), t.alias("text")) for i, t in enumerate((F.col("bare"), F.array_join("parts", "")))])
    texts = read.join(longest.select("document_id"), "document_id", "left_semi").select("document_id", "order_index", F.inline(sides)).filter("text <> ''")
    texts = running(texts.withColumn("size", F.length("text").cast("long")), ["document_id", "side"], ["order_index", "text"], "size", "stop", folder)
    texts = texts.join(longest, "document_id").withColumn("start", F.col("stop") - F.col("size"))
    number = lambda at: F.floor(at / piece).cast("long")
    texts = texts.withColumn("piece", F.explode(F.sequence(F.greatest(F.lit(0), number(F.col("start") - F.col("longest"))), number(F.col("stop") - 1))))
    first, last = F.greatest("start", F.col("piece") * piece), F.least("stop", (F.col("piece") + 1) * piece + F.col("longest"))
    cut = texts.select("document_id", "side", "piece", first.alias("at"), F.substring("text", (first - F.col("start") + 1).cast("int"), (last - first).cast("int")).alias("text")).filter("text <> ''")
    keys = ["document_id", "side", "piece"]
    pieces = cut.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "").alias("text"))
    pieces = written(pieces, folder, "pieces")
    kind = dict(chunks.dtypes)["document_id"]

    def search(key: tuple, texts: pd.DataFrame, lines: pd.DataFrame) -> pd.DataFrame:
        asked = lines["line"].tolist()
        found = [asked[i] for i in np.flatnonzero(held_lines("".join(texts["text"]), asked))]
        return pd.DataFrame({"document_id": [key[0]] * len(found), "line": found}, dtype=object)

    asked = sought.join(written(pieces.select(*keys), folder, "places"), "document_id").select(*keys, "line")
    found = pieces.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(search, f"document_id {kind}, line string")
    missing = sought.join(found, ["document_id", "line"], "left_anti").groupBy("document_id").agg(F.sum("n").alias("source_lines_missing_count"))
    checked = lines.groupBy("document_id").agg(F.sum("checked").alias("source_lines_checked"))
    return checked.join(missing, "document_id", "left")
def coverage_metrics(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """How much of a document's source text (document_id, source_text) its chunks hold: by characters, without exempt chunks, without table
    scaffold, and by lines of SHORTEST_LINE characters or more that occur in the indexed text."""
    body = body_of(chunks)
    exempt = F.coalesce("table_promoted", F.lit(False))
    size = F.length(compact(body))
    found = chunks.groupBy("document_id").agg(
        F.sum(size).alias("chunk_compact_chars"),
        F.sum(F.when(~exempt, size).otherwise(0)).alias("source_coverage_chunk_compact_chars"),
        F.count_if(exempt).alias("source_coverage_exempt_chunk_count"),
        F.sum(F.length(content(body))).alias("content_chunk_compact_chars"),
    )
    by_line = line_metrics(chunks, sources)
    size_of = sources.select(
        "document_id", F.length(compact(F.col("source_text"))).cast("long").alias("source_compact_chars"), F.length(content(F.col("source_text"))).cast("long").alias("content_source_compact_chars")
    )
    rows = size_of.join(by_line, "document_id", "left").join(found, "document_id", "left").fillna(0)
    ratio = lambda a, b, none: F.coalesce(F.round(F.try_divide(F.col(a), F.col(b)), 3), F.lit(none))
    return rows.select(
        "*",
        ratio("chunk_compact_chars", "source_compact_chars", 0.0).alias("raw_chunk_to_source_char_ratio"),
        ratio("source_coverage_chunk_compact_chars", "source_compact_chars", 0.0).alias("chunk_to_source_char_ratio"),
        ratio("content_chunk_compact_chars", "content_source_compact_chars", 0.0).alias("content_to_source_char_ratio"),
        F.coalesce(F.round(F.try_divide(F.col("source_lines_checked") - F.col("source_lines_missing_count"), F.col("source_lines_checked")), 3), F.lit(1.0)).alias("source_line_coverage_ratio"),
    )


# The checks, their severities and what to do when one fails.
CHECKS = {
    "chunks_present": ("error", "At least one chunk must be produced."),
    "no_validation_errors": ("error", "Validation errors must be zero."),
    "unique_chunk_ids": ("error", "Chunk IDs must be unique."),
    "no_empty_chunks": ("error", "Empty chunks are not usable for retrieval."),
    "page_metadata_present": ("warning", "Every chunk should keep its source page."),
    "required_metadata_present": ("warning", "Every chunk should include the required metadata."),
    "no_replacement_characters": ("warning", "Replacement characters mean an encoding problem."),
    "no_mojibake": ("warning", "Damaged text must be compared with the source file."),
    "structured_nodes_present": ("warning", "Documents with text should have structure; fallback chunks need review."),
    "table_rows_when_table_like": ("warning", "Tables without cells should be reviewed or reclassified."),
    "chunk_source_coverage": ("warning", "Chunks should hold most of the source without much repetition."),
    "source_lines_reach_indexed_text": ("warning", "Every source line must be found in indexed text."),
    "regulation_boundary_duplication": ("warning", "Repeated regulation headings suggest running headers."),
    "article_regulation_metadata_present": ("warning", "Article chunks should carry their regulation number."),
    "detected_regulations_reach_chunks": ("warning", "Detected regulation numbers should reach a chunk."),
    "private_use_characters_observed": ("info", "Private-use characters are often bullets; watch their conversion."),
    "table_false_positive_attention": ("info", "Many unstable false tables should become fixtures."),
}


def judged(measures: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """measures (one row per document, as evaluate() joins them; missing ones count 0) with checks (name, severity, passed), counts of failed ones,
    score, passed and recommendations. Columns of Profile's names, if there, stand for the profile's values."""
    kinds = dict(measures.dtypes)
    m = lambda name: F.coalesce(F.col(name), F.lit(0)) if name in kinds else F.lit(0)
    p = lambda name: F.col(name) if name in kinds else F.lit(getattr(profile, name))
    ratio, raw = m("chunk_to_source_char_ratio"), m("raw_chunk_to_source_char_ratio")
    low, high = p("coverage_ratio_min"), p("coverage_ratio_max")
    held = ratio.between(low, high) | ((m("source_coverage_exempt_chunk_count") > 0) & (ratio < low) & (raw >= low))
    held = F.when(m("source_compact_chars") == 0, m("chunk_compact_chars") == 0).otherwise(held)
    wrong = m("table_false_positive_attention_chunks")
    few = (wrong == 0) | ((wrong <= p("table_false_positive_attention_max_count")) & (wrong / F.greatest(m("chunk_count"), F.lit(1)) <= p("table_false_positive_attention_max_ratio")))
    numbers = m("unique_regulation_no_count")
    tests = {
        "chunks_present": m("chunk_count") > 0,
        "no_validation_errors": m("validation_error_count") == 0,
        "unique_chunk_ids": m("duplicate_chunk_id_count") == 0,
        "no_empty_chunks": m("empty_chunk_count") == 0,
        "page_metadata_present": m("missing_page_count") == 0,
        "required_metadata_present": m("chunks_missing_metadata") == 0,
        "no_replacement_characters": m("replacement_char_chunks") == 0,
        "no_mojibake": (m("mojibake_chunks") + m("mojibake_removed_blocks") + m("suspicious_metadata") + m("mojibake_removed_chars")) == 0,
        "structured_nodes_present": (m("source_compact_chars") == 0) | (m("node_count") > 0),
        "table_rows_when_table_like": m("table_like_without_cell_rows") == 0,
        "chunk_source_coverage": held,
        "source_lines_reach_indexed_text": m("source_lines_missing_count") == 0,
        "regulation_boundary_duplication": (numbers == 0) | (m("duplicate_regulation_node_count") <= numbers * 0.5),
        "article_regulation_metadata_present": m("article_chunks_missing_regulation_no") == 0,
        "detected_regulations_reach_chunks": m("detected_reg_no_without_chunk_metadata_count") == 0,
        "private_use_characters_observed": m("private_use_char_chunks") == 0,
        "table_false_positive_attention": few,
    }
    made = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(CHECKS[n][0]).alias("severity"), t.alias("passed"), F.lit(CHECKS[n][1]).alias("advice")) for n, t in tests.items()])
    rows = measures.withColumn("checks", made)
    failed = lambda s: F.size(F.filter("checks", lambda c: ~c["passed"] & (c["severity"] == s))).cast("long")
    rows = rows.withColumn("failed_errors", failed("error")).withColumn("failed_warnings", failed("warning"))
    counts = {
        "error_count": m("validation_error_count") + F.col("failed_errors"),
        "warning_count": F.greatest(F.lit(0), m("validation_warning_count") + F.col("failed_warnings") - m("page_warning_count")),
        "duplicate_ids": m("duplicate_chunk_id_count"),
        "empty_chunks": m("empty_chunk_count"),
        "missing_pages": m("missing_page_count"),
        "missing_metadata": m("chunks_missing_metadata"),
        "replacement_chars": m("replacement_char_chunks"),
        "mojibake": m("mojibake_chunks") + m("mojibake_removed_blocks"),
        "suspicious_metadata": m("suspicious_metadata"),
        "tables_without_cells": m("table_like_without_cell_rows"),
    }
    more = F.array(
        F.when(m("chunks_with_references") == 0, F.lit("No references were extracted; inspect the reference patterns.")),
        F.when((m("table_like_chunks") > 0) & (m("chunks_with_table_rows") == 0), F.lit("Tables need row extraction.")),
        F.when(m("table_review_required_chunks") > 0, F.lit("Table rows marked for review should be checked before they are cited.")),
        F.when(m("probable_table_extraction_failed_chunks") > 0, F.lit("Failed table extractions should become fixtures.")),
        F.when((m("regulation_node_count") > 0) & (m("chunks_with_regulation_metadata") == 0), F.lit("Regulations were found but did not reach the chunks.")),
    )
    advice = F.transform(F.filter("checks", lambda c: ~c["passed"]), lambda c: c["advice"])
    return rows.select(
        "*",
        (F.col("failed_errors") == 0).alias("passed"),
        score(counts).alias("score"),
        F.array_distinct(F.concat(advice, F.array_compact(more))).alias("recommendations"),
    )


def chunk_counts(chunks: DataFrame, nodes: DataFrame, issues: DataFrame) -> DataFrame:
    """Sizes, duplicate ids, empty chunks, pages without number, counts by type (maps) and issues by severity of each document."""
    empty = F.trim(F.coalesce("text", F.lit(""))) == ""
    declared = filled(F.col("source_page_unavailable_reason")) if "source_page_unavailable_reason" in chunks.columns else F.lit(False)
    by_chunk = chunks.groupBy("document_id").agg(
        F.count("*").alias("chunk_count"),
        (F.count("*") - F.count_distinct("chunk_id")).alias("duplicate_chunk_id_count"),
        F.count_if(empty).alias("empty_chunk_count"),
        F.count_if(F.col("source_page_start").isNull() & ~declared).alias("missing_page_count"),
    )

    def typed(df: DataFrame, kind: str, out: str) -> DataFrame:
        counts = df.groupBy("document_id", kind).agg(F.count("*").alias("n"))
        return counts.groupBy("document_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "n")))).alias(out), F.sum("n").alias(f"n_{out}"))

    by_issue = issues.groupBy("document_id").agg(
        F.count_if(F.col("severity") == "error").alias("validation_error_count"),
        F.count_if(F.col("severity") == "warning").alias("validation_warning_count"),
        F.count_if((F.col("severity") == "warning") & (F.col("issue") == "page_number_missing")).alias("page_warning_count"),
    )
    nodes_by_type = typed(nodes, "node_type", "node_type_counts").withColumnRenamed("n_node_type_counts", "node_count")
    chunks_by_type = typed(chunks, "chunk_type", "chunk_type_counts").drop("n_chunk_type_counts")
    return by_chunk.join(chunks_by_type, "document_id").join(nodes_by_type, "document_id", "full_outer").join(by_issue, "document_id", "left").fillna(0)


def evaluate(nodes: DataFrame, chunks: DataFrame, issues: DataFrame, sources: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """The whole gate: a row for each document of sources, with all measures, checks, score and recommendations."""
    out = sources.select("document_id")
    parts = [chunk_counts(chunks, nodes, issues), missing_metadata(chunks), metadata_coverage(chunks), table_metrics(chunks), structure_metrics(nodes, chunks), text_metrics(chunks), coverage_metrics(chunks, sources)]
    for part in parts:
        out = out.join(part, "document_id", "left")
    return judged(out, profile)


def validated(chunks: DataFrame, documents: DataFrame, max_chars: int = 1800) -> tuple[DataFrame, DataFrame]:
    """(issues, chunks): issues (document_id, chunk_id, severity, issue) and the chunks with their confidence lowered by them.

    A document without chunks has the issue no_chunks. Off for an empty chunk 0.4, a very long one 0.15, a missing page 0.1, each missing field 0.1."""
    kinds = dict(chunks.dtypes)
    length, text = F.length("text"), F.coalesce("text", F.lit(""))
    long = length > max_chars + 500
    structured = F.coalesce("table_like", F.lit(False)) & (F.coalesce(F.size("table_cell_rows"), F.lit(0)) > 0) if "table_like" in kinds else F.lit(False)
    declared = filled(F.col("source_page_unavailable_reason")) if "source_page_unavailable_reason" in kinds else F.lit(False)
    no_page = F.col("source_page_start").isNull()
    rules = [
        (F.trim(text) == "", "error", "empty_chunk", 0.4),
        (long & structured, "info", "long_structured_table_chunk", 0.0),
        (long & ~structured, "warning", "very_long_chunk", 0.15),
        (no_page & declared, "info", "source_page_unavailable", 0.0),
        (no_page & ~declared, "warning", "page_number_missing", 0.1),
        *[(~filled(F.col(c), kinds[c]) if c in kinds else F.lit(True), "warning", f"metadata_missing:{c}", 0.1) for c in REQUIRED],
    ]
    found = F.array_compact(F.array(*[F.when(t, F.struct(F.lit(s).alias("severity"), F.lit(i).alias("issue"), F.lit(off).alias("off"))) for t, s, i, off in rules]))
    rows = chunks.withColumn("found", found)
    issues = rows.select("document_id", "chunk_id", F.inline("found")).select("document_id", "chunk_id", "severity", "issue")
    none = documents.select("document_id").join(chunks, "document_id", "left_anti")
    issues = issues.unionByName(none.select("document_id", F.lit(None).cast("string").alias("chunk_id"), F.lit("error").alias("severity"), F.lit("no_chunks").alias("issue")))
    left = F.greatest(F.lit(0.0), 1 - F.aggregate("found", F.lit(0.0), lambda acc, x: acc + x["off"]))
    return issues, rows.withColumn("confidence", F.least("confidence", F.round(left, 6))).drop("found")
