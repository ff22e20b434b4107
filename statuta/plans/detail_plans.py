"""Queries of operators that work on a part of a record: references, dates, admission, reports, splitting, tables, export shapes, readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.functions import dates
from statuta.operators import catalog, chunking, metadata, search, structure, tables
from statuta.plans.fixtures import both
from statuta.plans.search_plans import RECORDS, records
from statuta.session import shared_folder, table
from statuta.sources import readers, writers

text_rows, TEXTS = both(
    """SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN concat('인사규정 제', o_orderkey % 30 + 1, '조에 따른다') WHEN 1 THEN '「근로기준법」 제5조제2항' WHEN 2 THEN '이 규정 제7조의2 및 제8조'
    WHEN 3 THEN '여비규정 제3조, 제4조제1항제2호를 준용한다' ELSE concat('제', o_orderkey % 40 + 1, '조') END AS text FROM {orders}""",
    "orders",
)


def article_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every article reference with its scope and the name that it takes from the words before it."""
    return text_rows(spark, sf_dir).select("k", F.posexplode(metadata.references("text")).alias("place", "r")).select("k", "place", "r.*")


SCOPES_SQL = f"""
SELECT k, 0 AS place, CASE k % 5 WHEN 0 THEN '제' || (k % 30 + 1) || '조' WHEN 1 THEN '제5조제2항' WHEN 2 THEN '제7조의2' WHEN 3 THEN '제3조' ELSE '제' || (k % 40 + 1) || '조' END AS article,
    CASE k % 5 WHEN 0 THEN 'regulation' WHEN 1 THEN 'law' WHEN 3 THEN 'regulation' ELSE 'own' END AS scope, CASE k % 5 WHEN 0 THEN '인사규정' WHEN 1 THEN '근로기준법' WHEN 3 THEN '여비규정' END AS name FROM ({TEXTS})
UNION ALL SELECT k, 1, CASE k % 5 WHEN 2 THEN '제8조' ELSE '제4조제1항제2호' END, CASE k % 5 WHEN 2 THEN 'own' ELSE 'regulation' END, CASE k % 5 WHEN 3 THEN '여비규정' END FROM ({TEXTS}) WHERE k % 5 IN (2, 3)"""


def attachment_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.expr("concat('별표 ', o_orderkey % 9, ' 및 별지 제', o_orderkey % 7, '-1호 서식, 별표 ', o_orderkey % 9)").alias("text"))
    return rows.select("k", F.array_join(metadata.attachment_references(F.col("text")), ",").alias("names"))


ATTACHMENTS_SQL = "SELECT o_orderkey AS k, '별표' || o_orderkey % 9 || ',별지제' || o_orderkey % 7 || '-1호서식' AS names FROM orders"


def starting_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = "o_orderkey % 28 + 1"
    text = F.expr(f"CASE o_orderkey % 4 WHEN 0 THEN concat('이 규정은 2024. 3. ', {day}, '.부터 시행한다.') WHEN 1 THEN concat('시행일: 2023년 5월 ', {day}, '일') WHEN 2 THEN '이 규정은 공포한 날부터 시행한다.' ELSE '2020. 1. 1. 제정' END")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), dates.effective_date(text).alias("starts"))


STARTS_SQL = """SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN '2024-03-' || lpad((o_orderkey % 28 + 1)::VARCHAR, 2, '0') WHEN 1 THEN '2023-05-' || lpad((o_orderkey % 28 + 1)::VARCHAR, 2, '0')
    WHEN 2 THEN 'promulgation_date' END AS starts FROM orders"""


def admitted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as uploads of five kinds; half of those called PDF are."""
    docs = table(spark, sf_dir, "documents")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("txt", "PDF", "docx", "exe", "hwp")]), (F.col("doc_id") % 5 + 1).cast("int"))
    content = F.encode(F.concat(F.when(F.col("doc_id") % 10 == 1, "%PDF-1.7").otherwise(""), F.coalesce("text", F.lit(""))), "UTF-8")
    files = docs.select(F.concat(F.lit("in/f"), "doc_id", F.lit("."), kind).alias("path"), content.alias("content")).withColumn("length", F.octet_length("content").cast("long"))
    return catalog.admitted(files, 5000)


ADMITTED_SQL = """
WITH f AS (SELECT doc_id % 5 AS c, 'in/f' || doc_id || '.' || ['txt', 'PDF', 'docx', 'exe', 'hwp'][doc_id % 5 + 1] AS path, CASE WHEN doc_id % 10 = 1 THEN '%PDF-1.7' ELSE '' END || coalesce(text, '') AS body, doc_id FROM documents)
SELECT path, strlen(body)::BIGINT AS length, ['txt', 'pdf', 'docx', 'exe', 'hwp'][c + 1] AS kind, sha256(body) AS sha256, CASE WHEN c = 3 THEN 'unknown kind' WHEN strlen(body) = 0 THEN 'empty' WHEN strlen(body) > 5000 THEN 'too large'
    WHEN c IN (2, 4) OR (c = 1 AND doc_id % 10 <> 1) THEN 'other bytes than its kind' END AS error FROM f"""


def usable_batch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey") % 4 == 0).alias("ocr_required"), F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "done").alias("status"))
    return catalog.usable_rows(rows).select("o_orderkey")


USABLE_SQL = "SELECT o_orderkey FROM orders WHERE (o_orderkey % 7 = 0 OR o_orderkey % 4 <> 0) AND o_orderstatus <> 'F'"


def canonical_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of every nation in an order that does not depend on how they came."""
    rows = table(spark, sf_dir, "customer").select(
        F.upper("c_mktsegment").alias("profile_id"), F.expr("CASE WHEN c_custkey % 3 > 0 THEN concat('R', c_custkey % 3) END").alias("regulation_id"), F.lit("1").alias("version"), F.lit(None).cast("string").alias("hierarchy_path"),
        F.lit("").alias("article_no"), F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("id"), "c_nationkey",
    )
    order = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(catalog.canonical_order())])
    return rows.groupBy("c_nationkey").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["o5"]), ","), 256).alias("order_sha256"))


CANONICAL_SQL = """
SELECT c_nationkey, sha256(string_agg(lpad(c_custkey::VARCHAR, 9, '0'), ',' ORDER BY lower(c_mktsegment), CASE WHEN c_custkey % 3 > 0 THEN 'r' || c_custkey % 3 ELSE '' END, c_custkey)) AS order_sha256 FROM customer GROUP BY 1"""


def boundary_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    warning = F.when(F.col("l_linenumber") == 7, F.array(F.lit("other"), F.lit("ambiguous_combined_book_boundary_requires_reparse")))
    chunks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.when(F.col("l_linenumber") > 1, F.col("l_quantity") == 50).alias("ambiguous_boundary"), warning.alias("warnings"))
    return catalog.boundary_errors(chunks)


BOUNDARY_SQL = "SELECT l_orderkey AS document_id, count(*) AS n FROM lineitem WHERE (l_linenumber > 1 AND l_quantity = 50) OR l_linenumber = 7 GROUP BY 1"


def backfill_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") == 1, F.col("l_shipdate").cast("date").cast("string")).alias("effective_from"), F.when(F.col("l_quantity") > 25, "2024-01-01").alias("effective_to"))
    after = metadata.inherited(lines, "l_orderkey", "effective_from").drop("effective_from_status")
    return catalog.backfill_report(lines, after, ["effective_from", "effective_to"])


BACKFILL_SQL = """
WITH l AS (SELECT l_orderkey, CASE WHEN l_linenumber = 1 THEN l_shipdate::DATE END AS f, CASE WHEN l_quantity > 25 THEN 1 END AS t FROM lineitem),
a AS (SELECT coalesce(f, CASE WHEN min(f) OVER w = max(f) OVER w THEN min(f) OVER w END) AS f FROM l WINDOW w AS (PARTITION BY l_orderkey))
SELECT 'effective_from' AS field, (SELECT count(f) FROM l) AS filled_before, (SELECT count(f) FROM a) AS filled_after, (SELECT count(f) FROM a) - (SELECT count(f) FROM l) AS gained
UNION ALL SELECT 'effective_to', count(t), count(t), 0 FROM l"""


def attention_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons = F.array_compact(F.array(F.when(F.col("l_discount") > 0.05, "low_confidence"), F.when(F.col("l_quantity") > 40, "long_text"), F.when(F.col("l_tax") == 0, "no_metadata"), F.when(F.col("l_quantity") > 45, "long_text")))
    chunks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("chunk_id"), reasons.alias("reasons"))
    return catalog.attention_report(chunks, "reasons")


ATTENTION_SQL = """
SELECT 'low_confidence' AS reason, count(*) AS chunks, count(DISTINCT l_orderkey) AS documents FROM lineitem WHERE l_discount > 0.05 UNION ALL
SELECT 'long_text', count(*), count(DISTINCT l_orderkey) FROM lineitem WHERE l_quantity > 40 UNION ALL SELECT 'no_metadata', count(*), count(DISTINCT l_orderkey) FROM lineitem WHERE l_tax = 0"""


def sentence_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of 1 to 300 sentences of nine characters in windows of 500 with 20 before, and texts whose paragraph marks cut them."""
    n = (F.col("o_orderkey") % 300 + 1).cast("int")
    marked = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.concat(F.substring(F.lit("①②③④⑤⑥⑦⑧"), i, F.lit(1)), F.repeat(F.lit(" 항의 내용"), (F.col("o_orderkey") % 60 + 1).cast("int")))), "\n")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.expr("repeat('abcdefgh. ', cast(o_orderkey % 300 + 1 as int))")).otherwise(marked)
    parts = chunking.split_parts(F.col("text"), F.lit(20), 500)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", n.alias("n"), text.alias("text")).select("o_orderkey", parts.alias("parts"))
    return rows.select("o_orderkey", F.size("parts").alias("n_parts"), F.length(F.get("parts", 0)).alias("first_length"), F.length(F.element_at("parts", -1)).alias("last_length"))


#: A window holds 50 sentences (499 characters); with 20 characters before them (19 without the blank), the next hold 48.
PARTS_SQL = """
WITH o AS (SELECT o_orderkey, o_orderkey % 2 AS odd, o_orderkey % 300 + 1 AS n, (o_orderkey % 60 + 1) * 6 + 1 AS p FROM orders),
w AS (SELECT *, CASE WHEN n <= 50 THEN 1 ELSE 1 + ceil((n - 50) / 48.0) END AS k FROM o)
SELECT o_orderkey, CASE WHEN odd = 0 THEN k WHEN p * 8 + 7 <= 500 THEN 1 ELSE 8 END::INT AS n_parts, CASE WHEN odd = 0 THEN least(n, 50) * 10 - 1 WHEN p * 8 + 7 <= 500 THEN p * 8 + 7 ELSE p END::INT AS first_length,
    CASE WHEN odd = 0 THEN CASE WHEN k = 1 THEN n * 10 - 1 ELSE 20 + (n - 50 - (k - 2) * 48) * 10 - 1 END WHEN p * 8 + 7 <= 500 THEN p * 8 + 7 ELSE p END::INT AS last_length FROM w"""


def wrapped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table per part whose third row goes on in the fourth."""
    cells = F.array(*[F.array(*[F.lit(c) if c != "{k}" else F.col("p_partkey").cast("string") for c in r]) for r in (("구분", "금액표"), ("기본급 항목", "{k}"), ("수당의 종류", "직책에 따른"), ("", "수당"), ("합계 금액", "900"))])
    rows = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(cells).alias("row_no", "cells"))
    return tables.merged_wraps(rows, "p_partkey").select("p_partkey", "row_no", F.array_join("cells", "|").alias("cells"), F.array_join("flags", ",").alias("flags"))


WRAPPED_SQL = """SELECT p_partkey, r.n::INT AS row_no, CASE r.n WHEN 0 THEN '구분|금액표' WHEN 1 THEN '기본급 항목|' || p_partkey WHEN 2 THEN '수당의 종류|직책에 따른 수당' ELSE '합계 금액|900' END AS cells,
    CASE r.n WHEN 2 THEN 'wrapped_cell_merge' ELSE '' END AS flags FROM part CROSS JOIN (VALUES (0), (1), (2), (4)) AS r(n)"""


def header_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.array(F.array(F.lit("a"), F.col("s_name"), F.lit("z")), F.array(F.lit("b"))).alias("cells"), F.array(F.lit("이름"), F.lit("값"), F.lit("값")).alias("header"))
    made = rows.select("s_suppkey", F.posexplode(tables.records_of(F.col("cells"), F.col("header"))).alias("row_no", "r"))
    return made.select("s_suppkey", "row_no", F.array_join(F.array_sort(F.transform(F.map_entries("r"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("record"))


HEADER_SQL = """SELECT s_suppkey, 0 AS row_no, '값 (2)=z;값=' || s_name || ';이름=a' AS record FROM supplier UNION ALL SELECT s_suppkey, 1, '값 (2)=;값=;이름=b' FROM supplier"""


def promoted_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that take the rows of their table where the match is sure, and structured tables that no chunk took."""
    part = table(spark, sf_dir, "part")
    chunks = part.select(F.concat(F.lit("c"), "p_partkey").alias("chunk_id"), F.col("p_name").alias("text"))
    side = part.select(F.col("p_partkey").alias("table_id"), F.concat(F.lit("표 "), "p_type").alias("sample"), F.when(F.col("p_size") % 3 == 0, "structured_table_candidate").otherwise("needs_ai_review").alias("label"))
    matches = part.filter("p_partkey % 2 = 0").select(F.concat(F.lit("c"), "p_partkey").alias("chunk_id"), F.col("p_partkey").alias("table_id"), F.col("p_size").cast("double").alias("score"), F.when(F.col("p_size") % 3 == 0, "structured_table_candidate").otherwise("needs_ai_review").alias("label"))
    return tables.promoted_tables(chunks, side, matches, 25.0)


PROMOTED_SQL = """
SELECT 'c' || p_partkey AS chunk_id, CASE WHEN ok THEN p_partkey END AS table_id, CASE WHEN ok THEN '표 ' || p_type ELSE p_name END AS text, ok AS promoted FROM (SELECT *, p_partkey % 2 = 0 AND p_size >= 25 AND p_size % 3 = 0 AS ok FROM part)
UNION ALL SELECT 'table_' || p_partkey, p_partkey, '표 ' || p_type, true FROM part WHERE p_size % 3 = 0 AND NOT (p_partkey % 2 = 0 AND p_size >= 25)"""


def node_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the lines of each node say of its pages, captions and counts."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", (F.col("l_linenumber") % 2).alias("node"), (F.col("l_quantity") / 10).cast("int").alias("page_no"), F.col("l_linenumber").cast("long").alias("cell_count"),
        F.when(F.col("l_returnflag") == "R", "본문").otherwise("| 칸 | 칸 |").alias("line"), F.array("l_returnflag").alias("source_flags"),
    )
    made = structure.merged_metadata(lines, "l_orderkey")
    return made.select("l_orderkey", "node", "page_start", "page_end", F.array_join("source_pages", ",").alias("pages"), "cell_count", F.array_join(F.array_sort("source_flags"), ",").alias("flags"), "caption_count")


SOURCES_SQL = """
WITH l AS (SELECT *, l_linenumber % 2 AS node, trunc(l_quantity / 10)::INT AS page FROM lineitem)
SELECT l_orderkey, node, min(page) AS page_start, max(page) AS page_end, string_agg(DISTINCT page::VARCHAR, ',' ORDER BY page::VARCHAR) AS pages, sum(l_linenumber)::BIGINT AS cell_count, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags, 0::BIGINT AS caption_count
FROM l GROUP BY 1, 2"""


def vector_store_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers in the row shapes of three vector stores."""
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.array(F.lit(1.0), F.col("s_nationkey").cast("double")).alias("v"), "s_name", "s_nationkey")
    meta = F.struct("s_nationkey")
    shapes = {"points": writers.qdrant_point(F.col("id"), F.col("v"), meta), "rows": writers.chroma_row(F.col("id"), F.col("v"), F.col("s_name"), meta), "table": writers.pgvector_row(F.col("id"), F.col("v"), F.col("s_name"))}
    return rows.select("id", F.explode(F.create_map(*[x for n, c in shapes.items() for x in (F.lit(n), c)])).alias("kind", "line"))


SHAPES_SQL = """
WITH s AS (SELECT 's' || s_suppkey AS id, '[1.0,' || s_nationkey || '.0]' AS v, s_name, s_nationkey FROM supplier)
SELECT id, 'points' AS kind, '{"id":"' || id || '","vector":' || v || ',"payload":{"s_nationkey":' || s_nationkey || '}}' AS line FROM s
UNION ALL SELECT id, 'rows', '{"id":"' || id || '","embedding":' || v || ',"document":"' || s_name || '","metadata":{"s_nationkey":' || s_nationkey || '}}' FROM s
UNION ALL SELECT id, 'table', '{"id":"' || id || '","content":"' || s_name || '","embedding":"' || v || '"}' FROM s"""


def document_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as markdown and as rows for CSV, lists as JSON."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.max("role").alias("role"), F.max(F.coalesce("text", F.lit(""))).alias("text"))
    sheets = writers.to_markdown(turns, "conv_id", "turn", "role", "text").withColumn("kinds", F.array(F.lit("md"), F.col("conv_id").cast("string")))
    return writers.to_csv_rows(sheets)


SHEETS_SQL = """
WITH t AS (SELECT conv_id, turn, max(role) AS role, max(coalesce(text, '')) AS text FROM conversations GROUP BY 1, 2)
SELECT conv_id, string_agg('## ' || coalesce(role, '') || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn NULLS FIRST) AS markdown, '["md","' || conv_id || '"]' AS kinds FROM t GROUP BY conv_id"""


def record_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record lines, some of them broken or without an id, written and read with their errors."""
    line = F.when(F.col("s_suppkey") % 9 == 0, '{"id": broken').when(F.col("s_suppkey") % 7 == 0, F.to_json(F.struct("s_name"))).otherwise(F.to_json(F.struct(F.col("s_suppkey").alias("id"), "s_name")))
    path = f"{shared_folder(spark)}/lines"
    table(spark, sf_dir, "supplier").select(line).write.text(path)
    rows = readers.read_records(spark, path, "id long, s_name string", ["id"])
    return rows.groupBy("line_error").agg(F.count("*").alias("n"), F.count("s_name").alias("named"), F.sum("id").alias("ids"))


LINES_SQL = """
SELECT CASE WHEN s_suppkey % 9 = 0 THEN 'malformed' WHEN s_suppkey % 7 = 0 THEN 'missing id' END AS line_error, count(*) AS n, count(CASE WHEN s_suppkey % 9 <> 0 THEN 1 END) AS named,
    sum(CASE WHEN s_suppkey % 9 <> 0 AND s_suppkey % 7 <> 0 THEN s_suppkey END)::BIGINT AS ids FROM supplier GROUP BY 1"""


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of text files found below a folder; files of a kind without a reader give a row with the error."""
    base = shared_folder(spark)
    rows = table(spark, sf_dir, "part")
    for year in (2023, 2024):
        rows.filter(F.col("p_partkey") % 2 == year % 2).select(F.concat("p_name", F.lit("\n"), "p_type", F.lit("\n\n"))).coalesce(3).write.text(f"{base}/rules/{year}")
    found = readers.read_documents(spark, f"{base}/rules", "*.txt")
    return found.groupBy("block_type", "text", "error").agg(F.count("*").alias("n"))


FILES_SQL = "SELECT 'text' AS block_type, p_name || chr(10) || p_type AS text, NULL::VARCHAR AS error, count(*) AS n FROM part GROUP BY 2"


def cold_compounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A compound that no record has: its parts are found among the index's terms."""
    folder = shared_folder(spark)
    search.build_index(records(spark, sf_dir), folder)
    index = search.Index.open(spark, folder)
    return index.score(index.cold_terms("휴직자출장비")).select("id", F.round("score", 6).alias("score"))


COLD_CTE = f"""
r AS (SELECT *, 5 * (k % 6 = 1)::INT AS a, 5 * (k % 6 = 3)::INT AS b, 34 + (k % 3 = 0)::INT AS n FROM ({RECORDS})),
s AS (SELECT count(*) AS docs, round(avg(n), 6) AS mean, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM r),
f AS (SELECT r.*, round(ln(1 + (docs - da + 0.5) / (da + 0.5)) * a * 2.5 / (a + 1.5 * (0.25 + 0.75 * n / mean)) + ln(1 + (docs - db + 0.5) / (db + 0.5)) * b * 2.5 / (b + 1.5 * (0.25 + 0.75 * n / mean)), 8) AS score FROM r, s)"""
COLD_SQL = f"WITH {COLD_CTE} SELECT id, round(score, 6) AS score FROM f WHERE a + b > 0"


def reranked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by their own score and the known parts of a compound."""
    rows, folder = records(spark, sf_dir), shared_folder(spark)
    search.build_index(rows, folder)
    scored = rows.filter("k % 4 = 1").withColumn("score", (F.col("k") % 3).cast("double"))
    return search.reranked(scored, search.Index.open(spark, folder), "휴직자출장비").select("id", F.round("score", 6).alias("score"))


RERANKED_SQL = f"""WITH {COLD_CTE} SELECT id, round(score + k % 3, 6) AS score FROM f WHERE k % 4 = 1"""

QUERIES = {
    "article_scopes": (article_scopes, SCOPES_SQL),
    "attachment_names": (attachment_names, ATTACHMENTS_SQL),
    "starting_dates": (starting_dates, STARTS_SQL),
    "admitted_files": (admitted_files, ADMITTED_SQL),
    "usable_batch_rows": (usable_batch_rows, USABLE_SQL),
    "canonical_records": (canonical_records, CANONICAL_SQL),
    "boundary_refusals": (boundary_refusals, BOUNDARY_SQL),
    "backfill_counts": (backfill_counts, BACKFILL_SQL),
    "attention_counts": (attention_counts, ATTENTION_SQL),
    "sentence_parts": (sentence_parts, PARTS_SQL),
    "wrapped_rows": (wrapped_rows, WRAPPED_SQL),
    "header_records": (header_records, HEADER_SQL),
    "promoted_sidecars": (promoted_sidecars, PROMOTED_SQL),
    "node_sources": (node_sources, SOURCES_SQL),
    "vector_store_rows": (vector_store_rows, SHAPES_SQL),
    "document_sheets": (document_sheets, SHEETS_SQL),
    "record_lines": (record_lines, LINES_SQL),
    "text_files": (text_files, FILES_SQL),
    "cold_compounds": (cold_compounds, COLD_SQL),
    "reranked_candidates": (reranked_candidates, RERANKED_SQL),
}
