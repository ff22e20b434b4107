"""Reference graph, tables and dates over generated records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.functions import dates, text
from statuta.operators import graph, references, tables
from statuta.plans.fixtures import both
from statuta.session import table

record_rows, RECORDS = both(
    """SELECT concat('t', CAST(o_custkey % 2 AS STRING)) AS tenant, o_orderkey AS record_id, o_orderkey AS k, o_orderkey % 16 <> 0 AS approved, CAST(o_orderkey % 40 AS INT) AS unit_id, concat('n', CAST(o_orderkey % 40 AS STRING)) AS number,
    concat('title', CAST(o_orderkey % 20 AS STRING)) AS title, concat('제 ', CAST(o_orderkey % 9 + 1 AS STRING), ' 조', CASE WHEN o_orderkey % 5 = 0 THEN '의 2 제3항' ELSE '' END) AS article_no,
    concat(CASE WHEN o_orderkey % 3 = 0 THEN 'N' ELSE 'Title' END, CAST(o_orderkey % 44 AS STRING)) AS ref0, CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN '제0조' WHEN 2 THEN '제99조' WHEN 3 THEN '제1조 제9항' ELSE concat('제', CAST(o_orderkey % 9 + 1 AS STRING), '조') END AS place0 FROM {orders}""",
    "orders",
)


def locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey")
    n = F.col("p_partkey")
    raw = F.when(n % 5 == 0, F.concat(F.lit("제 0"), n.cast("string"), F.lit(" 조 의 "), (n % 7).cast("string"))).when(n % 5 == 1, F.concat(F.lit("제"), n.cast("string"), F.lit("조 제2항 제 3 호 가목"))).when(n % 5 == 2, F.concat(F.lit("제"), n.cast("string"), F.lit("조제4항 5목"))).when(n % 5 == 3, F.concat(F.lit("제"), n.cast("string"), F.lit("조에 따라"))).otherwise(F.concat(F.lit("제"), n.cast("string"), F.lit("조")))
    return p.select("p_partkey", references.locator(raw).alias("p")).select("p_partkey", "p.article", "p.locator")


LOCATORS_SQL = """
WITH p AS (SELECT p_partkey AS n, p_partkey % 5 AS m, p_partkey % 7 AS s FROM part)
SELECT n AS p_partkey, CASE WHEN m = 3 OR (m = 0 AND s = 0) THEN NULL WHEN m = 0 THEN '제' || n || '조의' || s ELSE '제' || n || '조' END AS article,
 CASE WHEN m = 3 OR (m = 0 AND s = 0) THEN NULL WHEN m = 0 THEN '제' || n || '조의' || s WHEN m = 1 THEN '제' || n || '조제2항제3호가목' WHEN m = 2 THEN '제' || n || '조제4항5목' ELSE '제' || n || '조' END AS locator FROM p"""


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_of(spark, sf_dir)[1]


def graph_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = record_rows(spark, sf_dir)
    rows = rows.withColumn("article_refs", F.when(F.col("k") % 4 != 3, F.array(F.struct(F.col("ref0").alias("regulation"), F.col("place0").alias("article")))).otherwise(F.array().cast("array<struct<regulation:string,article:string>>")))
    return references.reference_graph(rows.withColumn("regulation_refs", F.array("ref0")), ["tenant"])


def reference_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph_edges(spark, sf_dir)
    return edges.groupBy("tenant", "kind", "status", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("edges"), F.sum("mentions").alias("mentions"), F.min("evidence").alias("evidence"))


EDGES_CTE = f"""
r AS (SELECT * FROM ({RECORDS}) WHERE approved), units AS (SELECT DISTINCT tenant, unit_id, number, title FROM r),
names AS (SELECT tenant, number AS ref, 0 AS rank, unit_id FROM units UNION SELECT tenant, title, 1, unit_id FROM units), best AS (SELECT tenant, ref, count(*) AS n, min(unit_id) AS target FROM names GROUP BY tenant, ref, rank QUALIFY row_number() OVER (PARTITION BY tenant, ref ORDER BY rank) = 1),
places AS (SELECT DISTINCT tenant, unit_id, unnest(['제' || (k % 9 + 1) || '조' || CASE WHEN k % 5 = 0 THEN '의2' ELSE '' END, '제' || (k % 9 + 1) || '조' || CASE WHEN k % 5 = 0 THEN '의2제3항' ELSE '' END]) AS p FROM r),
a AS (SELECT tenant, record_id, unit_id AS source, '제' || (k % 9 + 1) || '조' || CASE WHEN k % 5 = 0 THEN '의2제3항' ELSE '' END AS source_article, lower(ref0) AS ref, CASE WHEN k % 4 = 3 THEN 'unit' ELSE 'article' END AS kind,
    CASE WHEN k % 4 = 3 THEN NULL ELSE place0 END AS place FROM r),
s AS (SELECT a.*, CASE WHEN n = 1 THEN target END AS target, coalesce(n, 0) AS n, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS st FROM a LEFT JOIN best USING (tenant, ref)),
w AS (SELECT s.*, CASE WHEN st <> 'resolved' THEN st WHEN kind = 'article' AND place = '' THEN 'article_locator_missing' WHEN kind = 'article' AND place = '제0조' THEN 'invalid_article_locator'
    WHEN kind = 'article' AND NOT EXISTS (SELECT 1 FROM places p WHERE p.tenant = s.tenant AND p.unit_id = s.target AND p.p = replace(place, ' ', '')) THEN 'target_article_not_found' END AS reason FROM s),
e AS (SELECT tenant, source, source_article, kind, CASE WHEN target IS NULL THEN ref END AS ref, target, CASE WHEN place IN ('', '제0조') THEN place ELSE replace(place, ' ', '') END AS place,
    CASE WHEN st = 'resolved' AND reason IS NOT NULL THEN 'unresolved' ELSE st END AS status, reason, n, count(*) AS mentions, min(record_id) AS evidence FROM w GROUP BY ALL)"""
STATUS_SQL = f"""WITH {EDGES_CTE} SELECT tenant, kind, status, coalesce(reason, '') AS reason, count(*) AS edges, sum(mentions)::BIGINT AS mentions, min(evidence) AS evidence FROM e GROUP BY ALL"""


def visible_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved references of unit 8 in both directions, for a caller who may see units that leave no remainder by 4."""
    units, edges = graph_of(spark, sf_dir)
    out = references.references_of(edges.filter("tenant = 't0'"), units.filter("tenant = 't0' and unit_id % 4 = 0"), "8", status="resolved")
    return out.select("source", "target", "kind", F.coalesce("place", F.lit("")).alias("place"), F.coalesce("source_article", F.lit("")).alias("source_article"), "mentions")


VISIBLE_SQL = f"""WITH {EDGES_CTE} SELECT source, target, kind, coalesce(place, '') AS place, source_article, mentions FROM e WHERE tenant = 't0' AND status = 'resolved' AND (source = 8 OR target = 8) AND source % 4 = 0 AND target % 4 = 0"""


def arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    return rows.select(F.col("o_orderkey").cast("long").alias("a"), (F.col("o_custkey") * 7 + F.col("o_orderkey") % 3).cast("long").alias("b"))


def reference_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An arc from every order, as a unit, to the one that its customer's number gives: strongly connected units."""
    return graph.cycles(arcs(spark, sf_dir), "a", "b")


CYCLES_SQL = """
WITH RECURSIVE arcs AS (SELECT DISTINCT o_orderkey::BIGINT AS a, o_custkey::BIGINT * 7 + o_orderkey % 3 AS b FROM orders),
reach(s, d) AS (SELECT a, b FROM arcs UNION SELECT s, b FROM reach JOIN arcs ON d = a), mutual AS (SELECT x.s, x.d FROM reach x JOIN reach y ON x.s = y.d AND x.d = y.s), c AS (SELECT s AS node, min(d) AS cycle_id FROM mutual GROUP BY s)
SELECT node, cycle_id, (count(*) OVER (PARTITION BY cycle_id))::BIGINT AS size FROM c"""


def visible_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles whose units the caller may all see, in pages of 100."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s"))
    ring = rows.select(F.col("s").alias("a"), F.when(F.col("s") % 3 == 2, F.col("s") - 2).otherwise(F.col("s") + 1).alias("b"))
    members = graph.cycles(ring, "a", "b")
    out = references.cycles_of(members, rows.filter("s % 10 <> 7").select(F.col("s").alias("unit_id")), 1, 500)
    return out.select("cycle_id", "size", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


VISIBLE_CYCLES_SQL = """
WITH g AS (SELECT s_suppkey // 3 AS g, min(s_suppkey) AS cycle_id, count(*) AS n, bool_and(s_suppkey % 10 <> 7) AS ok, string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_suppkey) AS members FROM supplier GROUP BY 1)
SELECT cycle_id, n AS size, members FROM g WHERE ok AND n = 3 ORDER BY cycle_id LIMIT 100"""


def article_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = record_rows(spark, sf_dir)
    out = references.article_status(rows.select("unit_id", "record_id", F.concat(F.lit("제"), (F.col("k") % 10 + 1).cast("string"), F.lit("조의2"), F.when(F.col("k") % 2 == 0, "제3항").otherwise("")).alias("place")), rows.select("unit_id", "article_no", F.col("record_id").alias("id"), F.col("k").alias("order_index")), ["unit_id"])
    return out.groupBy("status").agg(F.count("*").alias("n"), F.sum(F.coalesce("target", F.lit(0))).alias("targets"))


RESOLUTION_SQL = f"""
WITH r AS (SELECT * FROM ({RECORDS})), a AS (SELECT unit_id, '제' || (k % 9 + 1) || '조' || CASE WHEN k % 5 = 0 THEN '의2' ELSE '' END AS base, '제' || (k % 9 + 1) || '조' || CASE WHEN k % 5 = 0 THEN '의2제3항' ELSE '' END AS whole, k FROM r),
w AS (SELECT unit_id, whole AS p, min(k) AS k FROM a GROUP BY ALL), b AS (SELECT unit_id, base AS p, min(k) AS k FROM a GROUP BY ALL),
c AS (SELECT unit_id, '제' || (k % 10 + 1) || '조의2' AS base, '제' || (k % 10 + 1) || '조의2' || CASE WHEN k % 2 = 0 THEN '제3항' ELSE '' END AS whole FROM r),
s AS (SELECT CASE WHEN w.k IS NOT NULL THEN 'exact' WHEN b.k IS NOT NULL THEN 'base' ELSE 'missing' END AS status, coalesce(w.k, b.k, 0) AS t FROM c LEFT JOIN w ON w.unit_id = c.unit_id AND w.p = whole LEFT JOIN b ON b.unit_id = c.unit_id AND b.p = base)
SELECT status, count(*) AS n, sum(t)::BIGINT AS targets FROM s GROUP BY status"""


def row_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each form of a table row."""
    k = F.col("p_partkey")
    n = k.cast("string")
    forms = [
        F.concat(F.lit("| 구분 | "), n, F.lit(" | 비고 |")), F.concat(F.lit("직급  "), n, F.lit("   수당")), F.concat(F.lit("대상: 직원 "), n, F.lit("명")), F.concat(F.lit("A-"), n, F.lit(" 인사 기록")), F.concat(F.lit("인사 기록 카드 "), (k % 900 + 100).cast("string"), F.lit("년")),
        F.concat(F.lit("1급 갑 "), n, F.lit("원 20% 3,000원")), F.concat(F.lit("제"), n, F.lit("조 구분 금액")), F.concat(F.lit("09:00 ~ 12:00 오전 근무 "), n), F.concat(F.lit("구분 금액 비고 "), n), F.concat(F.lit("수당을 "), n, F.lit("원  지급한다.")),
    ]
    row = F.get(F.array(*forms), (k % 10).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(tables.cells_of_row(row), "/").alias("cells"))


ROW_CELLS_SQL = """
SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN '구분/' || p_partkey || '/비고' WHEN 1 THEN '직급/' || p_partkey || '/수당' WHEN 2 THEN '대상/직원 ' || p_partkey || '명' WHEN 3 THEN 'A-' || p_partkey || '/인사 기록' WHEN 4 THEN '인사 기록 카드/' || (p_partkey % 900 + 100) || '년'
 WHEN 5 THEN '1급 갑 ' || p_partkey || '원 20% 3,000원' WHEN 6 THEN '제' || p_partkey || '조 구분 금액' WHEN 7 THEN '09:00 ~ 12:00/오전 근무 ' || p_partkey WHEN 8 THEN '구분/금액/비고/' || p_partkey ELSE '수당을 ' || p_partkey || '원  지급한다.' END AS cells FROM part"""


def table_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likelihood and classification of generated attachments, prose and lists."""
    k = F.col("p_partkey")
    grid = F.concat_ws("\n", F.lit("구분 | 금액 | 비고"), F.lit("---|---|---"), *[F.concat(F.lit(f"{i}급 | "), (k * i).cast("string"), F.lit("원 | -")) for i in (1, 2, 3)])
    prose = F.concat_ws("\n", *[F.concat(F.lit(f"직원은 규정 {i}에 따라 "), k.cast("string"), F.lit("일 이내에 신청한다.")) for i in range(4)])
    revised = F.concat_ws("\n", *[F.concat(F.lit(f"제{i}조 구분 항목  개정 2024. 1. "), (k % 28 + 1).cast("string"), F.lit(".")) for i in (1, 2, 3)])
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 3 == 0, grid).when(k % 3 == 1, prose).otherwise(revised).alias("t"), F.when(k % 2 == 0, "appendix").otherwise("article").alias("kind"))
    out = tables.analysed(rows, "t", "kind")
    return out.select("p_partkey", "table_like", "classification", "confidence", F.size("cell_rows").cast("long").alias("n_cells"), F.array_join("review_flags", ",").alias("flags"))


TABLE_CLASSES_SQL = """
SELECT p_partkey, p_partkey % 3 = 0 AS table_like, CASE p_partkey % 3 WHEN 0 THEN 'structured_table' WHEN 1 THEN 'not_table_like' ELSE 'probable_false_positive_prose_revision' END AS classification,
 CASE WHEN p_partkey % 3 <> 1 THEN 1.0 WHEN p_partkey % 2 = 0 THEN 0.31 ELSE 0.16 END::DOUBLE AS confidence, CASE WHEN p_partkey % 3 = 0 THEN 4 ELSE 0 END::BIGINT AS n_cells, '' AS flags FROM part"""


def table_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sidecar tables triaged and matched to the chunk of their document that is most like them."""
    p = table(spark, sf_dir, "part")
    doc, k = (F.col("p_partkey") / 3).cast("int").alias("document_id"), F.col("p_partkey")
    cells = F.array(F.array(F.lit("구분"), F.lit("금액")), F.array(F.col("p_name"), F.concat((k * 7).cast("string"), F.lit("원"))), F.array(F.col("p_brand"), F.lit("x")))
    sidecar = tables.triaged(p.select(doc, k.alias("table_id"), F.when(k % 4 == 0, F.array(F.array(F.lit("총칙 ........ 3")))).otherwise(cells).alias("cells"), F.lit(1).alias("page")))
    chunks = p.select(doc, k.alias("chunk_id"), F.concat_ws(" ", F.lit("구분 금액"), "p_name", F.concat((k * 7).cast("string"), F.lit("원")), "p_brand", F.lit("x")).alias("text"), F.lit(1).alias("page"))
    best = tables.best_tables(chunks.filter("chunk_id % 4 <> 0"), sidecar.filter("table_id % 4 <> 0"), "document_id")
    own = best.groupBy("match").agg(F.count("*").alias("n"))
    return own.unionByName(sidecar.groupBy(F.col("label").alias("match")).agg(F.count("*").alias("n")))


MATCHES_SQL = """
WITH p AS (SELECT * FROM part)
SELECT 'strong_review_match' AS match, count(*) AS n FROM p WHERE p_partkey % 4 <> 0
UNION ALL SELECT CASE WHEN p_partkey % 4 = 0 THEN 'probable_toc_table' ELSE 'structured_table_candidate' END, count(*) FROM p GROUP BY 1"""


def uncovered_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of 10 by 10 on each page, the first covered by a chunk of 10 by 9, the second by one of 10 by 7."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("document_id"))
    box = lambda i, y, h: s.select("document_id", F.lit(1).alias("page"), F.lit(i).alias("region_id"), F.lit(0.0).alias("x0"), F.lit(float(y)).alias("y0"), F.lit(10.0).alias("x1"), F.lit(float(y + h)).alias("y1"))
    return tables.open_regions(box(1, 0, 10).unionByName(box(2, 20, 10)), box(1, 0, 9).unionByName(box(2, 23, 7)).drop("region_id")).select("document_id", "region_id")


REGIONS_SQL = "SELECT s_suppkey AS document_id, 2 AS region_id FROM supplier"


def date_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates near marks, of a history, and the windows they make, of texts written from order dates."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    put = lambda n: F.date_format(F.date_add("d", n), "yyyy. M. d.")
    body = F.concat(F.lit("인사규정\n제정 "), put(0), F.lit("\n일부개정 "), put(10), F.lit(" 시행 "), put(20), F.lit("\n본문 "), F.repeat(F.lit("가"), 200), F.lit("\n부칙 제3조의 개정규정은 "), F.date_format(F.date_add("d", 30), "yyyy년 M월 d일"), F.lit("부터 시행한다."))
    rows = o.withColumn("t", body).withColumn("h", dates.leading_history(F.col("t")))
    windows = dates.validity_windows(F.date_add("d", 5), dates.article_overrides(F.col("t")), F.col("h.in_force"))
    return rows.select("o_orderkey", F.array_join(F.transform("h.revised", lambda x: x.cast("string")), ",").alias("revised"), F.get(dates.near_dates(F.col("t"), ("시행",)), 0).cast("string").alias("near"), F.array_join(F.transform(windows, lambda w: F.concat_ws("=", w["article"], w["valid_from"])), ",").alias("windows"))


WINDOWS_SQL = """SELECT o_orderkey, o_orderdate::DATE || ',' || (o_orderdate::DATE + 10) || ',' || (o_orderdate::DATE + 30) AS revised, (o_orderdate::DATE + 20)::VARCHAR AS near,
 '*=' || (o_orderdate::DATE + 5) || ',제3조=' || (o_orderdate::DATE + 30) || ',*=' || (o_orderdate::DATE + 30) AS windows FROM orders"""


def supplementary_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy. M. d.").alias("d"))
    k = F.col("o_orderkey") % 3
    body = F.when(k == 0, F.concat(F.lit("부칙 <"), "d", F.lit(">\n제1조(시행일) 이 규정은 "), "d", F.lit("부터 시행한다."))).when(k == 1, F.concat(F.lit("부칙\n이 규정은 "), "d", F.lit("부터 시행한다. 다만, 제5조는 예외로 한다."))).otherwise(F.lit("제5조 내용"))
    return o.select("o_orderkey", dates.supplementary(body).alias("s")).select("o_orderkey", "s.is_supplementary", F.col("s.identifier_date").cast("string").alias("identifier_date"), "s.boilerplate")


SUPPLEMENTARY_SQL = """SELECT o_orderkey, o_orderkey % 3 < 2 AS is_supplementary, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate::DATE::VARCHAR END AS identifier_date, o_orderkey % 3 = 0 AS boilerplate FROM orders"""


def answer_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned sentences, and retrieval texts with canonical header lines."""
    k = F.col("s_suppkey")
    raw = F.when(k % 2 == 0, F.concat(F.lit(" ①직원은   "), k.cast("string"), F.lit("일이내  에 경 우 <개정 2024>;"))).otherwise(F.lit("1-2. 인사규정 12"))
    held = F.concat(F.lit("머리\n[문서명] old\n[위치] old > 1\n[본문]\n[문서명] "), k.cast("string"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.answer_text(raw).alias("answer"), text.canonical_headers(held, F.lit("새 규정"), F.lit("새 규정 > 제1조")).alias("held"))


ANSWERS_SQL = """SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '① 직원은 ' || s_suppkey || '일 이내에 경우' ELSE '' END AS answer,
 '머리' || chr(10) || '[문서명] 새 규정' || chr(10) || '[위치] 새 규정 > 제1조' || chr(10) || '[본문]' || chr(10) || '[문서명] ' || s_suppkey AS held FROM supplier"""

QUERIES = {
    "article_locators": (locators, LOCATORS_SQL),
    "reference_status": (reference_status, STATUS_SQL),
    "visible_references": (visible_references, VISIBLE_SQL),
    "reference_cycles": (reference_cycles, CYCLES_SQL),
    "visible_cycles": (visible_cycles, VISIBLE_CYCLES_SQL),
    "article_resolution": (article_resolution, RESOLUTION_SQL),
    "row_cells": (row_cells, ROW_CELLS_SQL),
    "table_classes": (table_classes, TABLE_CLASSES_SQL),
    "table_matches": (table_matches, MATCHES_SQL),
    "uncovered_regions": (uncovered_regions, REGIONS_SQL),
    "date_windows": (date_windows, WINDOWS_SQL),
    "supplementary_flags": (supplementary_flags, SUPPLEMENTARY_SQL),
    "answer_texts": (answer_texts, ANSWERS_SQL),
}
