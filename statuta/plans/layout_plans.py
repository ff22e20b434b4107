"""Reading order, ruled regions and notes of generated pages: every part is a page of placed characters, every supplier one with a drawn table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.operators import layout
from statuta.plans.fixtures import both
from statuta.session import table

#: Eight lines on the left; on the right too but for k % 3 = 0; across the middle: above for k % 5 = 0, below for k % 4 = 0, between for k % 7 = 0. A gap after the third sign of a side.
GLYPHS = """
SELECT k AS document_id, 1 AS page, CAST(x + 7 * i + CASE WHEN wide = 0 AND i > 3 THEN 5 ELSE 0 END AS DOUBLE) AS x0, CAST(y AS DOUBLE) AS y0, CAST(x + 7 * i + CASE WHEN wide = 0 AND i > 3 THEN 11 ELSE 6 END AS DOUBLE) AS x1,
    CAST(y + 10 AS DOUBLE) AS y1, substr(t, i, 1) AS text, CAST(10 AS DOUBLE) AS size
FROM (SELECT p_partkey AS k, j, s, CASE s WHEN 1 THEN 350 ELSE 50 END AS x, 100 + 14 * j AS y, 0 AS wide, concat(CASE s WHEN 1 THEN 'R' ELSE 'L' END, CAST(j AS VARCHAR(9)), 'p', right(concat('00000', CAST(p_partkey AS VARCHAR(9))), 6)) AS t
    FROM {part} CROSS JOIN (VALUES (1), (2), (3), (4), (5), (6), (7), (8)) AS a(j) CROSS JOIN (VALUES (0), (1)) AS b(s) WHERE s = 0 OR p_partkey % 3 <> 0
    UNION ALL SELECT p_partkey, j, 0, 200, y, 1, t FROM {part} CROSS JOIN (VALUES (0, 60, 'abcdefghijklmnopqrstuvwxyz0123'), (9, 300, 'footofthepageacrossthemiddle12'), (10, 163, 'betweenthelinesofbothcolumns12')) AS c(j, y, t)
    WHERE (j = 0 AND p_partkey % 5 = 0) OR (j = 9 AND p_partkey % 4 = 0) OR (j = 10 AND p_partkey % 7 = 0)) AS l
CROSS JOIN (VALUES (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11), (12), (13), (14), (15), (16), (17), (18), (19), (20), (21), (22), (23), (24), (25), (26), (27), (28), (29), (30)) AS n(i) WHERE i <= length(t)"""
glyph_rows, _ = both(GLYPHS, "part")


def page_rows(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    return table(spark, sf_dir, name).select(F.col(key).alias("document_id"), F.lit(1).alias("page"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"), F.lit(0).alias("n_drawings"))


def page_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = layout.read_pages(glyph_rows(spark, sf_dir), page_rows(spark, sf_dir, "part", "p_partkey"))
    return read.select("document_id", "place", "text", F.coalesce("band", F.lit("")).alias("band"), F.coalesce("column", F.lit(-1)).alias("column"), "review")


ORDER_SQL = """
WITH p AS (SELECT p_partkey AS k, p_partkey % 3 <> 0 AS two, p_partkey % 3 <> 0 AND p_partkey % 7 = 0 AS review FROM part),
s AS (SELECT k, two, review, j, s, 100 + 14 * j AS y, chr(CASE s WHEN 1 THEN 82 ELSE 76 END) || j || 'p ' || right('00000' || k, 6) AS text FROM p, range(1, 9) AS a(j), range(2) AS b(s) WHERE s = 0 OR two
    UNION ALL SELECT k, two, review, j, -1, y, t FROM p, (VALUES (0, 60, 'abcdefghijklmnopqrstuvwxyz0123', 5), (9, 300, 'footofthepageacrossthemiddle12', 4), (10, 163, 'betweenthelinesofbothcolumns12', 7)) AS c(j, y, t, m) WHERE k % m = 0),
b AS (SELECT *, CASE WHEN NOT two OR review THEN '' WHEN j = 0 THEN 'header' WHEN j = 9 THEN 'footer' ELSE 'body' END AS band, two AND NOT review AS cut FROM s)
SELECT k AS document_id, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN cut THEN CASE band WHEN 'header' THEN 0 WHEN 'body' THEN 1 + s ELSE 3 END END, y, s)::INT AS place, text, band,
    CASE WHEN NOT cut THEN -1 WHEN band = 'body' THEN s + 1 ELSE 0 END::INT AS column, review FROM b"""

#: k % 4 + 3 upright and k % 3 + 2 level lines, each drawn twice half a point apart; k % 6 = 0: two upright ones only, of which one is a short one; k % 10 = 0: a single rectangle. One slanting line.
DRAWINGS = """
SELECT s_suppkey AS document_id, 1 AS page, CASE WHEN v = 2 THEN 'rect' ELSE 'line' END AS kind, CAST(CASE v WHEN 1 THEN 100 + 80 * i + d / 2 ELSE 100 END AS DOUBLE) AS x0, CAST(CASE v WHEN 0 THEN 200 + 40 * i + d / 2 ELSE 200 END AS DOUBLE) AS y0,
    CAST(CASE v WHEN 1 THEN 100 + 80 * i + d / 2 WHEN 0 THEN 100 + 80 * (s_suppkey % 4 + 2) ELSE 500 END AS DOUBLE) AS x1, CAST(CASE v WHEN 0 THEN 200 + 40 * i + d / 2 WHEN 1 THEN CASE WHEN s_suppkey % 6 = 0 AND i > 1 THEN 220 ELSE 240 + 40 * (s_suppkey % 3) END ELSE 300 END AS DOUBLE) AS y1
FROM {supplier} CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) AS a(i) CROSS JOIN (VALUES (CAST(0 AS DOUBLE)), (CAST(1 AS DOUBLE))) AS b(d) CROSS JOIN (VALUES (0), (1), (2), (3)) AS c(v)
WHERE (v = 0 AND i < s_suppkey % 3 + 2 AND s_suppkey % 10 <> 0) OR (v = 1 AND i < s_suppkey % 4 + 3 AND s_suppkey % 10 <> 0 AND (s_suppkey % 6 <> 0 OR d = 0)) OR (v = 2 AND i = 0 AND d = 0 AND s_suppkey % 10 = 0) OR (v = 3 AND i = 0 AND d = 0)"""
drawing_rows, _ = both(DRAWINGS, "supplier")


def ruled_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("document_id"), F.lit(1).alias("page"),
        F.explode(F.array(*[F.struct(F.lit(p).alias("place"), F.lit(x).alias("x0"), F.lit(y).alias("y0"), F.lit(x + 60).alias("x1"), F.lit(y + 10.0).alias("y1"), t.alias("text"), F.lit(z).alias("size")) for p, x, y, t, z in (
            (1, 110.0, 150.0, F.concat(F.lit("표 "), "s_name"), 14.0), (2, 110.0, 180.0, F.lit("(단위: 원)"), 9.0), (3, 300.0, 100.0, F.lit("멀다"), 30.0), (4, 110.0, 205.0, F.lit("구분"), 10.0), (5, 110.0, 225.0, F.col("s_name"), 10.0), (6, 110.0, 185.0, F.lit("[참고]"), 40.0))])).alias("s"),
    ).select("document_id", "page", "s.*")
    made = layout.region_texts(layout.ruled_regions(drawing_rows(spark, sf_dir), page_rows(spark, sf_dir, "supplier", "s_suppkey")), parts)
    return made.select("document_id", "x0", "y0", "x1", "y1", "n_columns", "n_rows", F.array_join(F.transform("column_lines", lambda x: F.format_number(x, 2)), ",").alias("column_lines"), "title", "text")


RULED_SQL = """
SELECT s_suppkey AS document_id, 100.25::DOUBLE AS x0, 200.25::DOUBLE AS y0, (100.25 + 80 * (s_suppkey % 4 + 2))::DOUBLE AS x1, (200.25 + 40 * (s_suppkey % 3 + 1))::DOUBLE AS y1, (s_suppkey % 4 + 2)::INT AS n_columns, (s_suppkey % 3 + 1)::INT AS n_rows,
    list_aggregate(list_transform(range(s_suppkey % 4 + 3), lambda i: (100 + 80 * i)::INT || '.25'), 'string_agg', ',') AS column_lines, '표 ' || s_name AS title, '구분' || chr(10) || s_name AS text
FROM supplier WHERE s_suppkey % 6 <> 0 AND s_suppkey % 10 <> 0"""


def page_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of order lines, an order being a page, that stand again at its foot."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.lit(1).alias("page"), F.col("l_returnflag").alias("marker"), F.col("l_quantity").cast("double").alias("x0"), (F.col("l_linenumber") * 120.0).alias("y0"))
    return layout.note_links(lines, page_rows(spark, sf_dir, "orders", "o_orderkey"))


NOTES_SQL = """
WITH m AS (SELECT l_orderkey AS d, l_returnflag AS marker, l_quantity::DOUBLE AS x, (l_linenumber * 120)::DOUBLE AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
f AS (SELECT *, row_number() OVER (PARTITION BY d, marker ORDER BY x, y) AS n FROM m WHERE y >= 688), b AS (SELECT *, row_number() OVER (PARTITION BY d, marker ORDER BY y, x) AS n FROM m WHERE y < 688)
SELECT f.d AS document_id, 1 AS page, f.marker, coalesce(b.x, f.x) AS mark_x0, coalesce(b.y, f.y) AS mark_y0, f.x AS note_x0, f.y AS note_y0 FROM f LEFT JOIN b ON f.d = b.d AND f.marker = b.marker AND b.n = 1 WHERE f.n = 1"""

QUERIES = {"page_order": (page_order, ORDER_SQL), "ruled_tables": (ruled_tables, RULED_SQL), "page_notes": (page_notes, NOTES_SQL)}
