"""Grids of generated tables with merged cells: every part is a table of three columns, some of which overlap or leave gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.operators import grids
from statuta.plans.fixtures import both
from statuta.session import table

#: (row, col, rows, columns, text): a heading over two columns, a cell over two rows; a blank column; k % 5 = 0: a cell too many; k % 7 = 0: one too few; k % 11 = 0: no place.
CELLS = """SELECT concat('d', k % 10) AS document_id, k AS table_id, CASE WHEN k % 11 = 0 AND c = 1 THEN -1 ELSE r END AS row, col, row_span, col_span, CASE WHEN c = 6 THEN concat('v', k) ELSE text END AS text
    FROM (SELECT p_partkey AS k FROM {part}) AS p CROSS JOIN (VALUES (1, 0, 0, 1, 1, '구분'), (2, 0, 1, 1, 2, '금액'), (3, 0, 3, 3, 1, ' '), (4, 1, 0, 2, 1, '직급'), (5, 1, 1, 1, 1, '갑'), (6, 1, 2, 1, 1, ''), (7, 2, 1, 1, 1, '을'), (8, 2, 2, 1, 1, '병'), (9, 2, 0, 1, 2, '겹침')) AS t(c, r, col, row_span, col_span, text)
    WHERE (c < 9 OR k % 5 = 0) AND (c <> 8 OR k % 7 <> 0)"""
cell_rows, _ = both(CELLS, "part")


def span_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.grid_rows(cell_rows(spark, sf_dir)).select("document_id", "table_id", "row", F.array_join("cells", "|").alias("cells"))


GRIDS_SQL = """
SELECT 'd' || p_partkey % 10 AS document_id, p_partkey AS table_id, r AS row, CASE r WHEN 0 THEN '구분|금액|금액' WHEN 1 THEN '직급|갑|v' || p_partkey ELSE '직급|을|병' END AS cells
FROM part CROSS JOIN (VALUES (0), (1), (2)) AS t(r) WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 11 <> 0"""


def span_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.grid_errors(cell_rows(spark, sf_dir))


ERRORS_SQL = """
WITH p AS (SELECT 'd' || p_partkey % 10 AS document_id, p_partkey AS table_id, p_partkey % 5 = 0 AS over_, p_partkey % 7 = 0 AS less, p_partkey % 11 = 0 AS none FROM part)
SELECT document_id, table_id, 'impossible cell' AS error, 1 AS places FROM p WHERE none UNION ALL SELECT document_id, table_id, 'overlapping cells', 2 FROM p WHERE over_
UNION ALL SELECT document_id, table_id, 'ragged rows', less::INT + none::INT FROM p WHERE less OR none"""


def inventory_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of JSON inventories, whose cells have spans but no columns."""
    payload = F.format_string(
        '{"tables":[{"title":"표 %d","page":%d,"rows":[{"cells":[{"text":"이름","rowSpan":2},{"text":"금액","colSpan":2}]},{"cells":[{"text":"기본"},{"text":"수당"}]},{"cells":[{"text":"%s"},{"text":"1"},{"text":"2"}]}]}]}',
        "s_suppkey", "s_nationkey", "s_name",
    )
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("document_id"), F.when(F.col("s_suppkey") % 9 == 0, "{broken").otherwise(payload).alias("payload"))
    cells, tables = grids.inventory_cells(rows)
    made = grids.grid_rows(grids.located(cells)).join(tables, ["document_id", "table_id"], "right")
    return made.select("document_id", "title", "page", "row", F.array_join("cells", "|").alias("cells"), "error")


INVENTORY_SQL = """
SELECT s_suppkey::VARCHAR AS document_id, '표 ' || s_suppkey AS title, s_nationkey AS page, r AS row, CASE r WHEN 0 THEN '이름|금액|금액' WHEN 1 THEN '이름|기본|수당' ELSE s_name || '|1|2' END AS cells, NULL::VARCHAR AS error
FROM supplier CROSS JOIN (VALUES (0), (1), (2)) AS t(r) WHERE s_suppkey % 9 <> 0 UNION ALL SELECT s_suppkey::VARCHAR, NULL, NULL, NULL, NULL, 'no tables' FROM supplier WHERE s_suppkey % 9 = 0"""


def caption_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions and notes of every order's lines with the nearest line that is a table."""
    kind = F.when(F.col("l_quantity") % 4 == 0, "table").when(F.col("l_quantity") % 4 == 1, "caption").when(F.col("l_quantity") % 4 == 2, "note").otherwise("text")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"))
    blocks = lines.select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("block_index"), kind.alias("kind"), F.lit("t").alias("text"))
    return grids.bound_notes(blocks).drop("text")


CAPTIONS_SQL = """
WITH l AS (SELECT l_orderkey, l_linenumber, max(l_quantity)::INT % 4 AS q FROM lineitem GROUP BY 1, 2),
m AS (SELECT a.l_orderkey, a.l_linenumber, a.q, b.l_linenumber AS t, row_number() OVER (PARTITION BY a.l_orderkey, a.l_linenumber ORDER BY abs(a.l_linenumber - b.l_linenumber), CASE WHEN a.q = 1 THEN -b.l_linenumber ELSE b.l_linenumber END) AS place
    FROM l a LEFT JOIN l b ON a.l_orderkey = b.l_orderkey AND b.q = 0 WHERE a.q IN (1, 2))
SELECT l_orderkey AS document_id, l_linenumber AS block_index, CASE q WHEN 1 THEN 'caption' ELSE 'note' END AS kind, t AS table_block FROM m WHERE place = 1"""

QUERIES = {"span_grids": (span_grids, GRIDS_SQL), "span_errors": (span_errors, ERRORS_SQL), "inventory_grids": (inventory_grids, INVENTORY_SQL), "caption_tables": (caption_tables, CAPTIONS_SQL)}
