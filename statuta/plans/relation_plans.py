"""Relation edges of generated documents of eight chunks: names, contexts before and after, laws by another word, articles defined in passing, tables, terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.operators import relations
from statuta.session import table

CHUNK = "regulation string, article_no string, article_title string, chunk_type string, page int, text string, article_refs array<string>, regulation_refs array<string>, law_refs array<string>"
#: The eight chunks of a document.
CHUNKS = (
    ("인사규정", "제1조", "목적", "article", 1, "「보수규정」 제3조제1항에 따르고 근로기준법 제7조를 본다.", ["제3조제1항", "제7조", "제1조"], ["보수규정"], []),
    ("인사규정", "제2조", "범위", "article", 2, "제1조 제2항과 제9조", ["제1조 제2항", "제9조", "제1조"], None, None),
    ("인사규정", None, None, "form", 2, "「소득세법」 제5조와 제6조 및 「동법 시행령」 제8조", ["제5조", "제6조"], None, ["소득세법", "동법 시행령", "시행령"]),
    ("인사규정", None, None, "paragraph", 3, "제4조(정의) 뜻을 둔다. 제5조(기간) 날", ["제4조"], None, None),
    ("인사규정", "", None, "paragraph", 9, "제8조를 본다", ["제8조"], None, None),
    ("인사규정", None, None, "paragraph", 9, "「복무규정」 제2조", None, None, None),
    ("여비규정", None, None, "paragraph", 20, None, ["제8조", " "], None, None),
    (None, None, None, "paragraph", None, "", None, ["소득세법", ""], None),
)


def eights(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") - 1
    return table(spark, sf_dir, "part").select(F.floor(k / 8).alias("document_id"), F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("chunk_id"), F.col("p_partkey").alias("k"), (k % 8).cast("int").alias("chunk_order"))


def relation_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = spark.createDataFrame([(i, *c) for i, c in enumerate(CHUNKS)], f"chunk_order int, {CHUNK}")
    return eights(spark, sf_dir).join(F.broadcast(slots), "chunk_order").withColumns({"page_start": F.col("page"), "page_end": F.col("page")}).drop("page")


def relation_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, k = eights(spark, sf_dir).filter("chunk_order >= 6"), F.col("k").cast("string")
    whole = F.col("chunk_order") == 7
    line = F.array(F.struct(F.lit(0).alias("row_index"), F.array(F.lit("갑"), F.concat(k, F.lit("원")), F.lit(" ")).alias("cells")))
    return rows.select("chunk_id", F.concat(F.lit("T-"), k).alias("table_id"), F.when(whole, F.concat(F.lit("표 "), k)).alias("label"), F.lit(0.9).alias("table_confidence"), F.when(whole, F.array(F.lit("직급"), F.lit("금액"))).alias("header"), F.when(whole, line).alias("rows"), F.array(F.lit("한 줄"), F.lit("")).alias("raw_rows"))


def relation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = eights(spark, sf_dir).filter("chunk_order in (0, 5)").select("chunk_id", F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.lit(w).alias("weight")) for t, w in (("가나", 2), ("다라", 1))])).alias("t")).select("chunk_id", "t.*")
    return relations.relation_edges(relation_chunks(spark, sf_dir), relation_tables(spark, sf_dir), terms).select("edge_id", "relation_type", "source_label", "target_id", "target_label", "chunk_id", "page_start", "weight", "confidence")


EDGES_SQL = """
WITH p AS (SELECT p_partkey AS k, (p_partkey - 1) // 8 AS d, (p_partkey - 1) % 8 AS slot FROM part),
e AS (SELECT * FROM (VALUES
    (0, 'article_cites_regulation_article', 'article:{d}:인사규정:제1조', '인사규정 제1조 목적', 'regulation_article:보수규정:제3조제1항', '보수규정 제3조제1항', 'named_article_ref', '「보수규정」 제3조제1항', 0.9, 1),
    (0, 'article_cites_law_article', 'article:{d}:인사규정:제1조', '인사규정 제1조 목적', 'law_article:근로기준법:제7조', '근로기준법 제7조', 'contextual_law_article_ref', '제7조', 0.78, 1),
    (0, 'article_cites_own_article_clause', 'article:{d}:인사규정:제1조', '인사규정 제1조 목적', 'article:{d}:인사규정:제1조', '인사규정 제1조 목적', 'article_ref', '제1조', 0.85, 1),
    (0, 'article_cites_regulation', 'article:{d}:인사규정:제1조', '인사규정 제1조 목적', 'regulation:보수규정', '보수규정', 'internal_regulation_ref', '보수규정', 0.8, 1),
    (1, 'article_cites_article_clause', 'article:{d}:인사규정:제2조', '인사규정 제2조 범위', 'article:{d}:인사규정:제1조', '인사규정 제1조 목적', 'article_ref', '제1조 제2항', 0.85, 2),
    (1, 'article_cites_article', 'article:{d}:인사규정:제2조', '인사규정 제2조 범위', 'article:{d}:인사규정:제1조', '인사규정 제1조 목적', 'article_ref', '제1조', 0.85, 2),
    (1, 'article_cites_regulation_article', 'article:{d}:인사규정:제2조', '인사규정 제2조 범위', 'regulation_article:보수규정:제9조', '보수규정 제9조', 'contextual_article_ref', '제9조', 0.72, 2),
    (2, 'chunk_cites_law_article', 'regulation_context:{d}:인사규정:c{k}', '인사규정', 'law_article:소득세법:제5조', '소득세법 제5조', 'named_article_ref', '「소득세법」 제5조', 0.9, 2),
    (2, 'chunk_cites_law_article', 'regulation_context:{d}:인사규정:c{k}', '인사규정', 'law_article:소득세법시행령:제8조', '소득세법 시행령 제8조', 'named_article_ref', '「동법 시행령」 제8조', 0.9, 2),
    (2, 'chunk_cites_law_article', 'regulation_context:{d}:인사규정:c{k}', '인사규정', 'law_article:소득세법:제6조', '소득세법 제6조', 'contextual_law_article_ref', '제6조', 0.78, 2),
    (2, 'chunk_cites_law', 'regulation_context:{d}:인사규정:c{k}', '인사규정', 'law:소득세법', '소득세법', 'external_law_ref', '소득세법', 0.8, 2),
    (2, 'chunk_cites_law', 'regulation_context:{d}:인사규정:c{k}', '인사규정', 'law:소득세법시행령', '소득세법 시행령', 'external_law_ref', '소득세법 시행령', 0.8, 2),
    (3, 'chunk_defines_inline_article', 'regulation_context:{d}:인사규정:c{k}', '인사규정', 'article:{d}:인사규정:제4조', '인사규정 제4조', 'inline_article_heading', '제4조', 0.82, 3),
    (3, 'chunk_defines_inline_article', 'regulation_context:{d}:인사규정:c{k}', '인사규정', 'article:{d}:인사규정:제5조', '인사규정 제5조', 'inline_article_heading', '제5조', 0.82, 3),
    (4, 'chunk_cites_regulation_article', 'regulation_context:{d}:인사규정:c{k}', '인사규정', 'regulation_article:복무규정:제8조', '복무규정 제8조', 'contextual_article_ref', '제8조', 0.68, 9),
    (5, 'chunk_cites_regulation_article', 'regulation_context:{d}:인사규정:c{k}', '인사규정', 'regulation_article:복무규정:제2조', '복무규정 제2조', 'named_article_ref', '「복무규정」 제2조', 0.9, 9),
    (6, 'article_cites_article', 'regulation_context:{d}:여비규정:c{k}', '여비규정', 'article:{d}:여비규정:제8조', '여비규정 제8조', 'article_ref', '제8조', 0.6, 20),
    (6, 'chunk_has_table', 'regulation_context:{d}:여비규정:c{k}', '여비규정', 'table:T-{k}', 'T-{k}', 'table', 'T-{k}', 0.9, 20),
    (6, 'table_has_raw_row', 'table:T-{k}', 'T-{k}', 'table_row:t{k}:0', '한 줄', 'raw_table_row', '한 줄', 0.9, 20),
    (7, 'chunk_cites_law', 'chunk:c{k}', 'c{k}', 'law:소득세법', '소득세법', 'internal_regulation_ref', '소득세법', 0.72, NULL),
    (7, 'chunk_has_table', 'chunk:c{k}', 'c{k}', 'table:T-{k}', '표 {k}', 'table', '표 {k}', 0.9, NULL),
    (7, 'table_has_column', 'table:T-{k}', '표 {k}', 'table_field:t{k}:직급', '직급', 'table_header', '직급', 0.9, NULL), (7, 'table_has_column', 'table:T-{k}', '표 {k}', 'table_field:t{k}:금액', '금액', 'table_header', '금액', 0.9, NULL),
    (7, 'table_has_row', 'table:T-{k}', '표 {k}', 'table_row:t{k}:0', '갑 | {k}원 |  ', 'table_row', '갑 | {k}원 |  ', 0.9, NULL),
    (7, 'table_row_has_cell', 'table_row:t{k}:0', '갑 | {k}원 |  ', 'table_cell:t{k}:0:0', '갑', 'table_cell', '갑', 0.9, NULL), (7, 'table_row_has_cell', 'table_row:t{k}:0', '갑 | {k}원 |  ', 'table_cell:t{k}:0:1', '{k}원', 'table_cell', '{k}원', 0.9, NULL),
    (7, 'table_row_has_field', 'table_row:t{k}:0', '갑 | {k}원 |  ', 'table_field:t{k}:직급', '직급', 'table_field', '직급: 갑', 0.9, NULL), (7, 'table_row_has_field', 'table_row:t{k}:0', '갑 | {k}원 |  ', 'table_field:t{k}:금액', '금액', 'table_field', '금액: {k}원', 0.9, NULL),
    (7, 'table_row_has_value', 'table_row:t{k}:0', '갑 | {k}원 |  ', 'table_value:갑', '갑', 'table_value', '직급: 갑', 0.9, NULL), (7, 'table_row_has_value', 'table_row:t{k}:0', '갑 | {k}원 |  ', 'table_value:{k}원', '{k}원', 'table_value', '금액: {k}원', 0.9, NULL),
    (7, 'table_field_has_value', 'table_field:t{k}:직급', '직급', 'table_value:갑', '갑', 'table_field_value', '직급: 갑', 0.9, NULL), (7, 'table_field_has_value', 'table_field:t{k}:금액', '금액', 'table_value:{k}원', '{k}원', 'table_field_value', '금액: {k}원', 0.9, NULL)
    ) AS t(slot, relation_type, s, source_label, t, target_label, kind, said, confidence, page)),
f AS (SELECT relation_type, k, d, confidence, page, s, source_label, t, target_label, kind, said FROM p JOIN e USING (slot)),
g AS (SELECT relation_type, confidence::DOUBLE AS confidence, page::INT AS page_start, 'c' || k AS chunk_id, kind, replace(replace(s, '{k}', k::VARCHAR), '{d}', d::VARCHAR) AS s, replace(source_label, '{k}', k::VARCHAR) AS source_label,
    replace(replace(t, '{k}', k::VARCHAR), '{d}', d::VARCHAR) AS target_id, replace(target_label, '{k}', k::VARCHAR) AS target_label, replace(said, '{k}', k::VARCHAR) AS said, 1 AS weight FROM f
    UNION ALL SELECT 'term_cooccurs_with_term', 0.5, NULL, NULL, 'term_cooccurrence', 'term:가나', '가나', 'term:다라', '다라', '가나 다라', count(*) FROM p WHERE slot IN (0, 5))
SELECT 'edge_' || substr(sha1(relation_type || '|' || s || '|' || target_id || '|' || coalesce(chunk_id, '') || '|' || kind || '|' || said), 1, 16) AS edge_id, relation_type, source_label, target_id, target_label, chunk_id, page_start, weight, confidence FROM g"""

QUERIES = {"relation_edges": (relation_edges, EDGES_SQL)}
