"""The quality gate over generated chunks and nodes: every order is a chunk, every line item a node, customers' numbers make the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.operators import gate
from statuta.plans.fixtures import both

chunk_rows, CHUNKS = both(
    """SELECT concat('d', CAST(o_custkey % 40 AS STRING)) AS document_id, o_orderkey AS k, concat('c', CAST(o_orderkey - CASE WHEN o_orderkey % 96 = 1 THEN 1 ELSE 0 END AS STRING)) AS chunk_id,
    CASE o_orderkey % 4 WHEN 0 THEN 'article' WHEN 1 THEN 'appendix' WHEN 2 THEN 'table' ELSE 'form' END AS chunk_type,
    CASE WHEN o_orderkey % 89 = 0 THEN ' ' WHEN o_orderkey % 83 = 0 THEN 'bad � text' ELSE concat('line of order ', CAST(o_orderkey AS STRING), ' and | its number') END AS text,
    CASE WHEN o_orderkey % 79 = 0 THEN NULL ELSE CAST(o_orderkey % 9 + 1 AS INT) END AS source_page_start, CAST(o_orderkey % 9 + 1 + CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END AS INT) AS source_page_end,
    CASE WHEN o_orderkey % 73 = 0 THEN '' ELSE concat('book > 별표', CAST(o_orderkey % 5 AS STRING)) END AS hierarchy_path, 'book' AS document_name, 'book.hwpx' AS source_file,
    o_orderkey % 3 = 0 AS table_like, CASE o_orderkey % 10 WHEN 0 THEN 'probable_false_positive_list' WHEN 1 THEN 'probable_table_extraction_failed' ELSE 'table' END AS table_classification,
    CASE WHEN o_orderkey % 20 = 0 THEN 'stable' ELSE 'open' END AS table_false_positive_stability, CAST(o_orderkey % 5 AS INT) AS n_cells, CAST(o_orderkey % 4 AS INT) AS n_raw,
    CAST(o_orderkey % 8 AS INT) AS table_column_count, (o_orderkey % 100) / 100.0 AS confidence0, o_orderkey % 30 = 0 AS table_review_required,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE concat('r', CAST(o_orderkey % 6 AS STRING)) END AS regulation_no, o_orderkey % 50 = 0 AS structure_fallback, concat('n', CAST(o_orderkey AS STRING)) AS node0
    FROM {orders}""",
    "orders",
)
node_rows, NODES = both(
    """SELECT concat('d', CAST(o_custkey % 40 AS STRING)) AS document_id, concat('n', CAST(o_orderkey AS STRING)) AS node_id, o_orderkey AS k,
    CASE WHEN o_orderkey % 32 = 0 THEN 'regulation' WHEN o_orderkey % 4 = 0 THEN 'article' WHEN o_orderkey % 4 = 1 THEN 'appendix' WHEN o_orderkey % 4 = 2 THEN 'form' ELSE 'supplementary' END AS node_type,
    concat('r', CAST(o_orderkey % 11 AS STRING)) AS number, concat('제 ', CAST(o_orderkey % 2 AS STRING), '  규정') AS title, CASE WHEN o_orderkey % 32 = 0 THEN NULL ELSE concat('n', CAST(o_orderkey - o_orderkey % 32 AS STRING)) END AS parent_id FROM {orders}""",
    "orders",
)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunk_rows(spark, sf_dir)
    cell = lambda i: F.struct((i % 3 == 0).alias("review_required"), F.when(i % 2 == 0, F.array(F.lit("short"))).otherwise(F.array().cast("array<string>")).alias("row_quality_flags"))
    many = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(1), F.col(n))).otherwise(F.array().cast("array<int>"))
    text = F.col("text")
    return rows.select(
        "*", F.transform(many("n_cells"), cell).alias("table_cell_rows"), F.transform(many("n_raw"), lambda i: i.cast("string")).alias("table_rows"), F.col("confidence0").cast("double").alias("table_confidence"),
        F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("table_citation_label"), F.lit(None).cast("string").alias("table_appendix_no"), F.array("node0").alias("source_node_ids"),
        F.array().cast("array<string>").alias("warnings"), text.alias("normalized_text"), F.concat(F.lit("[문서명] book\n[본문]\n"), text).alias("retrieval_text"), F.col("k").alias("order_index"), (F.col("k") % 16 == 0).alias("table_promoted"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source of a document: lines of its chunks, each with one that no chunk has for every 60th."""
    lost = F.when(F.col("k") % 60 == 0, F.concat(F.lit("\nlost sentence of order "), F.col("k").cast("string"))).otherwise("")
    parts = F.array_sort(F.collect_list(F.struct("k", F.concat("text", lost).alias("t"))))
    return chunk_rows(spark, sf_dir).groupBy("document_id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias("source_text"))


def gate_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.table_metrics(chunks(spark, sf_dir))


GATE_TABLES_SQL = f"""
WITH c AS ({CHUNKS}), d AS (SELECT *, n_cells > 0 AS has, (SELECT count(*) FROM generate_series(1, n_cells) g(i) WHERE i % 3 = 0 OR i % 2 = 0) AS flagged, n_cells >= 3 AS review3 FROM c)
SELECT document_id, count(*) FILTER (table_like) AS table_like_chunks, count(*) FILTER (table_like AND has) AS chunks_with_table_cell_rows, count(*) FILTER (table_like AND has) AS chunks_with_table_rows,
 count(*) FILTER (table_like AND NOT has) AS table_like_without_cell_rows, sum(CASE WHEN table_like THEN n_cells ELSE 0 END)::BIGINT AS table_cell_row_count, sum(CASE WHEN table_like THEN n_cells ELSE 0 END)::BIGINT AS table_row_count,
 sum(CASE WHEN table_like THEN n_raw ELSE 0 END)::BIGINT AS table_raw_row_count, max(CASE WHEN table_like THEN table_column_count ELSE 0 END) AS max_table_column_count,
 round(avg(confidence0::DOUBLE) FILTER (table_like), 3) AS avg_table_confidence, count(*) FILTER (k % 10 = 0) AS probable_table_false_positive_chunks, count(*) FILTER (k % 20 = 0) AS stable_table_false_positive_chunks,
 count(*) FILTER (k % 20 = 10) AS table_false_positive_attention_chunks, count(*) FILTER (k % 10 = 1) AS probable_table_extraction_failed_chunks,
 count(*) FILTER (table_like AND (k % 30 = 0 OR review3)) AS table_review_required_chunks, sum(CASE WHEN table_like THEN flagged ELSE 0 END)::BIGINT AS table_review_required_row_count,
 count(*) FILTER (table_like AND has AND k % 73 <> 0) AS table_citation_ready_chunks, count(*) FILTER (table_like AND k % 6 = 0 AND k % 79 <> 0) AS multi_page_table_like_chunks,
 count(*) FILTER (table_like AND (k % 4 = 1 OR k % 73 <> 0)) AS appendix_table_like_chunks FROM d GROUP BY document_id"""


def gate_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.structure_metrics(node_rows(spark, sf_dir), chunks(spark, sf_dir))


GATE_STRUCTURE_SQL = f"""
WITH n AS ({NODES}), c AS ({CHUNKS}), regs AS (SELECT * FROM n WHERE node_type = 'regulation'), ids AS (SELECT document_id, number, title, count(*) AS n FROM regs GROUP BY ALL),
nums AS (SELECT document_id, number, count(*) AS titles, sum(n) AS n FROM ids GROUP BY ALL),
a AS (SELECT document_id, count(*) FILTER (node_type = 'regulation') AS regulation_node_count, count(*) FILTER (node_type = 'article') AS article_node_count, count(*) FILTER (node_type = 'appendix') AS appendix_node_count,
    count(*) FILTER (node_type = 'form') AS form_node_count, count(*) FILTER (node_type = 'supplementary') AS supplementary_node_count FROM n GROUP BY document_id),
b AS (SELECT document_id, count(*) AS unique_regulation_no_count, sum(titles)::BIGINT AS unique_regulation_identity_count, sum(n - titles)::BIGINT AS duplicate_regulation_node_count,
    sum(titles - 1)::BIGINT AS regulation_title_variant_count, 0::BIGINT AS same_regulation_multiple_parent_count FROM nums GROUP BY document_id),
s AS (SELECT document_id, count(*) AS silent FROM nums WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.document_id = nums.document_id AND c.regulation_no = nums.number) GROUP BY document_id),
e AS (SELECT document_id, count(*) FILTER (regulation_no IS NOT NULL) AS chunks_with_regulation_metadata, count(DISTINCT regulation_no) AS unique_chunk_regulation_no_count, count(*) FILTER (regulation_no IS NULL) AS chunks_missing_regulation_no,
    count(*) FILTER (regulation_no IS NULL AND k % 4 = 0) AS article_chunks_missing_regulation_no, count(*) FILTER (k % 50 = 0) AS structure_fallback_chunk_count, 0::BIGINT AS chunks_without_source_nodes FROM c GROUP BY document_id)
SELECT e.*, a.* EXCLUDE (document_id), coalesce(unique_regulation_no_count, 0) AS unique_regulation_no_count, coalesce(unique_regulation_identity_count, 0) AS unique_regulation_identity_count,
    coalesce(duplicate_regulation_node_count, 0) AS duplicate_regulation_node_count, coalesce(regulation_title_variant_count, 0) AS regulation_title_variant_count, 0::BIGINT AS same_regulation_multiple_parent_count,
    0::BIGINT AS zero_chunk_regulation_node_count, coalesce(silent, 0) AS detected_reg_no_without_chunk_metadata_count FROM e JOIN a USING (document_id) LEFT JOIN b USING (document_id) LEFT JOIN s USING (document_id)"""


def gate_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.coverage_metrics(chunks(spark, sf_dir), sources(spark, sf_dir))


GATE_COVERAGE_SQL = f"""
WITH c AS ({CHUNKS}), p AS (SELECT *, regexp_replace(text, '\\s+', '', 'g') AS t, CASE WHEN k % 60 = 0 THEN 'lostsentenceoforder' || k ELSE '' END AS lost FROM c),
q AS (SELECT *, length(t) AS n, length(replace(replace(t, '|', ''), '-', '')) AS m FROM p)
SELECT document_id, (sum(n) + sum(length(lost)))::BIGINT AS source_compact_chars, (sum(m) + sum(length(lost)))::BIGINT AS content_source_compact_chars,
 (count(*) FILTER (n >= 12) + count(*) FILTER (lost <> ''))::BIGINT AS source_lines_checked, count(*) FILTER (lost <> '')::BIGINT AS source_lines_missing_count, sum(n)::BIGINT AS chunk_compact_chars,
 sum(CASE WHEN k % 16 <> 0 THEN n ELSE 0 END)::BIGINT AS source_coverage_chunk_compact_chars, count(*) FILTER (k % 16 = 0) AS source_coverage_exempt_chunk_count, sum(m)::BIGINT AS content_chunk_compact_chars,
 round(sum(n) / (sum(n) + sum(length(lost))), 3) AS raw_chunk_to_source_char_ratio, round(sum(CASE WHEN k % 16 <> 0 THEN n ELSE 0 END) / (sum(n) + sum(length(lost))), 3) AS chunk_to_source_char_ratio,
 round(sum(m) / (sum(m) + sum(length(lost))), 3) AS content_to_source_char_ratio,
 round(count(*) FILTER (n >= 12) / (count(*) FILTER (n >= 12) + count(*) FILTER (lost <> '')), 3) AS source_line_coverage_ratio FROM q GROUP BY document_id"""


def gate_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir)
    issues, scored = gate.validated(rows, rows.select("document_id").distinct().union(spark.createDataFrame([("d-none",)], "document_id string")), 20)
    lowered = scored.groupBy("document_id").agg(F.round(F.sum(1 - F.col("confidence")), 2).alias("off"))
    counts = issues.groupBy("document_id", "severity", "issue").agg(F.count("*").alias("n"))
    return counts.join(lowered, "document_id", "left")


GATE_ISSUES_SQL = f"""
WITH c AS ({CHUNKS}), i AS (SELECT document_id, 'error' AS severity, 'empty_chunk' AS issue, 0.4 AS o FROM c WHERE k % 89 = 0
 UNION ALL SELECT document_id, 'warning', 'page_number_missing', 0.1 FROM c WHERE k % 79 = 0 UNION ALL SELECT document_id, 'warning', 'metadata_missing:hierarchy_path', 0.1 FROM c WHERE k % 73 = 0
 UNION ALL SELECT 'd-none', 'error', 'no_chunks', NULL), f AS (SELECT document_id, round(sum(o), 2)::DOUBLE AS o FROM i WHERE o IS NOT NULL GROUP BY document_id)
SELECT document_id, severity, issue, count(*) AS n, CASE WHEN document_id <> 'd-none' THEN any_value(f.o) END AS off FROM i LEFT JOIN f USING (document_id) GROUP BY document_id, severity, issue"""


def gate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole gate: which of the 17 checks fail for each document, its score and whether it passes."""
    rows = chunks(spark, sf_dir)
    issues, _ = gate.validated(rows, sources(spark, sf_dir))
    out = gate.evaluate(node_rows(spark, sf_dir), rows, issues, sources(spark, sf_dir))
    failed = F.array_join(F.array_sort(F.transform(F.filter("checks", lambda c: ~c["passed"]), lambda c: c["name"])), ",")
    return out.select("document_id", failed.alias("failed"), "passed", "score", "failed_errors", "failed_warnings")


GATE_VERDICTS_SQL = f"""
WITH t AS ({GATE_TABLES_SQL}), s AS ({GATE_STRUCTURE_SQL}), v AS ({GATE_COVERAGE_SQL}),
c AS (SELECT document_id, count(*) AS chunks, count(*) - count(DISTINCT chunk_id) AS twice, count(*) FILTER (k % 89 = 0) AS empty, count(*) FILTER (k % 79 = 0) AS no_page, count(*) FILTER (k % 73 = 0) AS no_meta,
    count(*) FILTER (k % 83 = 0 AND k % 89 <> 0) AS bad FROM ({CHUNKS}) GROUP BY document_id),
m AS (SELECT document_id, [x.n FOR x IN [{{'n': 'no_validation_errors', 'f': empty > 0}}, {{'n': 'unique_chunk_ids', 'f': twice > 0}}, {{'n': 'no_empty_chunks', 'f': empty > 0}}, {{'n': 'page_metadata_present', 'f': no_page > 0}},
    {{'n': 'required_metadata_present', 'f': no_meta > 0}}, {{'n': 'no_replacement_characters', 'f': bad > 0}}, {{'n': 'table_rows_when_table_like', 'f': table_like_without_cell_rows > 0}},
    {{'n': 'chunk_source_coverage', 'f': NOT (chunk_to_source_char_ratio BETWEEN 0.8 AND 1.3 OR (source_coverage_exempt_chunk_count > 0 AND chunk_to_source_char_ratio < 0.8 AND raw_chunk_to_source_char_ratio >= 0.8))}},
    {{'n': 'source_lines_reach_indexed_text', 'f': source_lines_missing_count > 0}}, {{'n': 'regulation_boundary_duplication', 'f': unique_regulation_no_count > 0 AND duplicate_regulation_node_count > unique_regulation_no_count * 0.5}},
    {{'n': 'article_regulation_metadata_present', 'f': article_chunks_missing_regulation_no > 0}}, {{'n': 'detected_regulations_reach_chunks', 'f': detected_reg_no_without_chunk_metadata_count > 0}},
    {{'n': 'table_false_positive_attention', 'f': NOT (table_false_positive_attention_chunks = 0 OR (table_false_positive_attention_chunks <= 6 AND table_false_positive_attention_chunks / chunks <= 0.15))}}] IF x.f] AS f, c.*,
    table_like_without_cell_rows AS bare FROM t JOIN s USING (document_id) JOIN v USING (document_id) JOIN c USING (document_id)),
w AS (SELECT *, len(list_filter(f, lambda x: x IN ('no_validation_errors', 'unique_chunk_ids', 'no_empty_chunks'))) AS e, len(list_filter(f, lambda x: x NOT IN ('no_validation_errors', 'unique_chunk_ids', 'no_empty_chunks', 'table_false_positive_attention'))) AS w FROM m)
SELECT document_id, array_to_string(list_sort(f), ',') AS failed, e = 0 AS passed, e AS failed_errors, w AS failed_warnings,
 round(greatest(0, 100.0 - least(60, 20 * (empty + e)) - least(25, 2 * (no_meta + w)) - least(40, 10 * twice) - least(40, 10 * empty) - least(20, 0.5 * no_page) - least(20, 0.5 * no_meta) - least(20, 2 * bad) - least(10, 0.02 * bare)), 1)::DOUBLE AS score FROM w"""

QUERIES = {
    "gate_tables": (gate_tables, GATE_TABLES_SQL),
    "gate_structure": (gate_structure, GATE_STRUCTURE_SQL),
    "gate_coverage": (gate_coverage, GATE_COVERAGE_SQL),
    "gate_issues": (gate_issues, GATE_ISSUES_SQL),
    "gate_verdicts": (gate_verdicts, GATE_VERDICTS_SQL),
}
