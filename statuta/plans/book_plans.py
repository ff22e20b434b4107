"""Structure and chunk operators over a generated book of regulations for every part, with the tree written out as the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.operators import chunking, structure
from statuta.plans.fixtures import both, books


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = books(spark, sf_dir).select("document_id", F.col("raw_text").alias("text"), F.lit("text").alias("block_type"), F.lit(0).alias("block_index"))
    return structure.detected(rows, "document_id", "text", "block_type", "block_index")


def line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).groupBy("node_type").agg(F.count("*").alias("n"))


LINE_CLASSES_SQL = """
WITH b AS (SELECT count(*) FILTER (p_partkey % 7 <> 0) AS books, count(*) FILTER (p_partkey % 7 = 0) AS plain FROM part)
SELECT t.node_type, (t.n * books + CASE WHEN t.node_type = 'text' THEN 2 * plain ELSE 0 END)::BIGINT AS n FROM b, (VALUES ('regulation', 1), ('chapter', 1), ('article', 5), ('paragraph', 5),
    ('item', 2), ('subitem', 2), ('supplementary', 1), ('appendix', 2), ('form', 1), ('text', 8)) AS t(node_type, n)"""


def book_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = structure.nodes_of(lines(spark, sf_dir), "document_id").filter("node > 0")
    return nodes.select("document_id", F.col("node").cast("int").alias("node"), "node_type", "number", F.col("parent").cast("int").alias("parent"))


TREE = """(VALUES (1, 'regulation', '1-1-', NULL), (2, 'chapter', '제1장', 1), (3, 'article', '제1조', 2), (4, 'paragraph', '①', 3), (5, 'item', '1.', 4), (6, 'item', '2)', 4),
    (7, 'subitem', '가.', 6), (8, 'subitem', '(나)', 6), (9, 'paragraph', '㉑', 3), (10, 'paragraph', '□', 3), (11, 'article', '제2조', 2), (12, 'article', '제3조의2', 2),
    (13, 'paragraph', '제3항', 12), (14, 'paragraph', '제4항', 12), (15, 'supplementary', '부칙', 1), (16, 'article', '제1조', 15), (17, 'article', '제2조', 15),
    (18, 'appendix', '별표', 1), (19, 'appendix', '붙임2', 1), (20, 'form', '별지제3호서식', 1)) AS t(node, node_type, number, parent)"""
NODES_SQL = f"""SELECT p_partkey AS document_id, node, node_type, number || CASE node WHEN 1 THEN p_partkey::VARCHAR WHEN 18 THEN p_size::VARCHAR ELSE '' END AS number, parent
FROM part, {TREE} WHERE p_partkey % 7 <> 0"""


def book_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = structure.nodes_of(lines(spark, sf_dir), "document_id")
    out = chunking.build_chunks(nodes, books(spark, sf_dir), "document_id", "name")
    path = F.sha2("canonical_path", 256).alias("path_hash")
    return out.select("chunk_id", "document_id", "chunk_type", path, F.length("text").cast("int").alias("n_chars"), F.size("source_nodes").alias("n_nodes"), "part_count")


CHUNKS_SQL = """
WITH d AS (SELECT p_partkey AS k, '제' || substr(p_brand, 7, 2) || '규정' AS title, p_size AS s, p_name FROM part),
c AS (SELECT k, title, s, t.* FROM d, (VALUES
    (3, 'article', '제1조', ' > 제1장 총칙 > 제1조 목적', '제1조(목적) 이 규정은 기준을 정한다.|제5조에 따라 처리한다.|① 다음 각 호와 같다.|1. 첫째|2) 둘째|가. 세부 하나|(나) 세부 둘|각. 항목이 아니다|1.5배를 지급한다|㉑ 스물한째 항|□ 네모 항', 8),
    (11, 'article', '제2조', ' > 제1장 총칙 > 제2조 정의', '제2조 정의|2024. 1. 5. 개정한 날', 1),
    (12, 'article', '제3조의2', ' > 제1장 총칙 > 제3조의2 특례', '제3조의2【특례】|제3항 및|제4항|제4조 및 제5조를 준용한다|[별표 1]의 기준에 따른다', 3),
    (15, 'supplementary', '부칙', ' > 부칙', '부칙', 1),
    (16, 'article', '제1조', ' > 부칙 > 제1조 시행일', '제1조(시행일) 이 규정은 2024년 3월 1일부터 시행한다.', 1),
    (17, 'article', '제2조', ' > 부칙 > 제2조 다른 규정의 개정', '제2조(다른 규정의 개정) 인사규정 일부를 다음과 같이 개정한다.|제9조(휴가) 휴가는 다음과 같다.', 1),
    (18, 'appendix', '별표', ' > 별표', '[별표 ] 수당 기준표|구분 - 금액', 1),
    (19, 'appendix', '붙임2', ' > 붙임2 신청서 목록', '붙임 2 신청서 목록', 1),
    (20, 'form', '별지제3호서식', ' > 별지제3호서식 신청서', '[별지 제3호 서식] 신청서', 1)) AS t(node, kind, number, path, text, n) WHERE k % 7 <> 0),
e AS (SELECT k, kind, number || CASE WHEN node = 18 THEN s::VARCHAR ELSE '' END AS number, node, title || path || CASE WHEN node = 18 THEN s || ' 수당 기준표' ELSE '' END AS path,
    length(text) + CASE WHEN node = 18 THEN length(s::VARCHAR) ELSE 0 END AS n_chars, n FROM c)
SELECT k || '_' || kind || '_' || number || '_' || lpad((node + 1)::VARCHAR, 4, '0') || '_p0_001' AS chunk_id, k AS document_id, kind AS chunk_type, sha256(path) AS path_hash, n_chars::INT AS n_chars, n AS n_nodes, 1 AS part_count FROM e
UNION ALL SELECT k || '_document_fallback_001', k, 'document', sha256(p_name), (4 + length(p_name) + 1 + 60 * (length(p_name) + 2) - 1)::INT, 0, 1 FROM d WHERE k % 7 = 0"""


def book_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = chunking.child_units(structure.nodes_of(lines(spark, sf_dir), "document_id"), "document_id")
    return units.select("document_id", F.col("node").cast("int").alias("node"), "n_paragraphs", "n_items", "n_subitems", F.get("units", 0)["number"].alias("first_unit"))


CHILDREN_SQL = """SELECT p_partkey AS document_id, t.* FROM part, (VALUES (3, 3::BIGINT, 2::BIGINT, 2::BIGINT, '①'), (12, 2, 0, 0, '제3항')) AS t(node, n_paragraphs, n_items, n_subitems, first_unit) WHERE p_partkey % 7 <> 0"""

# Chunks of 50 regulations: each order is a chunk that cites another article and a regulation by number.
cited, CITED_SQL = both(
    """SELECT CAST(o_custkey % 50 AS INT) AS document_id, o_orderkey AS k, concat('c', CAST(o_orderkey AS STRING)) AS chunk_id, concat('1-', CAST(o_custkey % 3 AS STRING)) AS regulation_no,
    concat('규정', CAST(o_custkey % 3 AS STRING)) AS regulation_title, concat('제', CAST(o_orderkey % 11 AS STRING), '조') AS article_no,
    CASE WHEN o_orderkey % 2 = 0 THEN 'article' ELSE 'item' END AS chunk_type, CAST(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 13 END AS INT) AS source_page_start,
    concat('제 ', CAST(o_orderkey % 17 AS STRING), ' 조') AS article_ref, concat('1-', CAST(o_orderkey % 4 AS STRING)) AS regulation_ref FROM {orders}""",
    "orders",
)


def book_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cited(spark, sf_dir).withColumn("articles", F.array("article_ref")).withColumn("regulations", F.array("regulation_ref"))
    return chunking.reference_edges(rows, "document_id", "regulations", "articles")


REFERENCES_SQL = f"""
WITH c AS ({CITED_SQL}), r AS (SELECT *, CASE chunk_type WHEN 'article' THEN 1 ELSE 3 END AS kind_rank, coalesce(source_page_start, 999999) AS page FROM c),
by_no AS (SELECT document_id, regulation_no, chunk_id AS target FROM r QUALIFY row_number() OVER (PARTITION BY document_id, regulation_no ORDER BY kind_rank, page, chunk_id) = 1),
by_article AS (SELECT document_id, regulation_no, article_no, chunk_id AS target FROM r QUALIFY row_number() OVER (PARTITION BY document_id, regulation_no, article_no ORDER BY kind_rank, page, chunk_id) = 1)
SELECT r.chunk_id, 'regulation' AS kind, regulation_ref AS reference, target FROM r LEFT JOIN by_no n ON n.document_id = r.document_id AND n.regulation_no = regulation_ref
UNION ALL SELECT r.chunk_id, 'article', article_ref, CASE WHEN target <> r.chunk_id THEN target END FROM r
LEFT JOIN by_article n ON n.document_id = r.document_id AND n.regulation_no = r.regulation_no AND n.article_no = replace(article_ref, ' ', '')"""

QUERIES = {
    "line_classes": (line_classes, LINE_CLASSES_SQL),
    "book_nodes": (book_nodes, NODES_SQL),
    "book_chunks": (book_chunks, CHUNKS_SQL),
    "book_children": (book_children, CHILDREN_SQL),
    "book_references": (book_references, REFERENCES_SQL),
}
