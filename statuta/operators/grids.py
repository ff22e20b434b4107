"""Tables with merged cells as full grids, and captions and notes with the table they belong to.

cells: document_id, table_id, row and col (from 0; a null col is found by reading order), row_span, col_span, text. A merged cell's text stands in every place that it covers. A
table whose cells overlap, leave gaps or have no possible place gives error rows instead of a guess.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statuta.operators.structure import markdown_row

MOST_PLACES = 10_000  # of one cell; a span that covers more is an error
TABLE = ["document_id", "table_id"]
CELL = "document_id string, table_id long, row int, col int, row_span int, col_span int, text string"
INVENTORY = "tables array<struct<title string, page int, rows array<struct<cells array<struct<text string, rowSpan int, colSpan int>>>>>>"


def fill_columns(rows: list[int], spans: list[tuple[int, int]]) -> list[int]:
    """Columns of cells in reading order: each takes the first places in its row that no cell from above reaches into."""
    taken: dict[int, int] = {}  # column: the first row that is free below
    out, row, at = [], None, 0
    for r, (down, across) in zip(rows, spans, strict=True):
        at = 0 if r != row else at
        row = r
        while any(taken.get(c, 0) > r for c in range(at, at + across)):
            at += 1
        for c in range(at, at + across):
            taken[c] = r + down
        out.append(at)
        at += across
    return out


def located(cells: DataFrame, order: str = "place") -> DataFrame:
    """cells with every col known. `order`: the reading order. Only tables without columns are filled, one table at a time."""

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", order])
        spans = [(max(1, int(a)), min(MOST_PLACES, max(1, int(b)))) for a, b in zip(pdf["row_span"], pdf["col_span"], strict=True)]
        return pdf.assign(col=fill_columns(pdf["row"].tolist(), spans))[[c.split()[0] for c in CELL.split(", ")]]

    rows = cells.withColumns({c: F.coalesce(F.col(c), F.lit(1)).cast("int") for c in ("row_span", "col_span")}).withColumn("row", F.col("row").cast("int")).withColumn("col", F.col("col").cast("int"))
    names = [c.split()[0] for c in CELL.split(", ")]
    loose = rows.filter("col is null and row is not null").select(*TABLE).distinct()
    filled = rows.filter("row is not null").join(loose, TABLE, "left_semi").select(*names, order).groupBy(*TABLE).applyInPandas(fill, CELL)
    return rows.join(loose, TABLE, "left_anti").select(*names).unionByName(filled)


def possible() -> Column:
    """A cell has a place and spans that can be."""
    spans = F.col("row_span").cast("long") * F.col("col_span")
    return F.coalesce((F.col("row") >= 0) & (F.col("col") >= 0) & (F.col("row_span") >= 1) & (F.col("col_span") >= 1) & (spans <= MOST_PLACES), F.lit(False))


def places(cells: DataFrame) -> DataFrame:
    """(document_id, table_id, row, col, text, n): every place that a cell covers and how many do."""
    reach = lambda start, span: F.explode(F.sequence(F.col(start), F.col(start) + F.col(span) - 1))
    wide = cells.filter(possible()).select(*TABLE, "col", "col_span", F.coalesce("text", F.lit("")).alias("text"), reach("row", "row_span").alias("row"))
    each = wide.select(*TABLE, "row", "text", reach("col", "col_span").alias("col"))
    return each.groupBy(*TABLE, "row", "col").agg(F.min("text").alias("text"), F.count("*").alias("n"))


def grid_errors(cells: DataFrame) -> DataFrame:
    """(document_id, table_id, error, places): cells without a possible place, places that several cells cover, places that none covers."""
    odd = cells.filter(~possible()).groupBy(*TABLE).agg(F.count("*").alias("places")).withColumn("error", F.lit("impossible cell"))
    sums = places(cells).groupBy(*TABLE).agg(F.count_if(F.col("n") > 1).alias("twice"), F.count("*").alias("n"), F.max("row").alias("r"), F.max("col").alias("c"))
    size = (F.col("r") + 1).cast("long") * (F.col("c") + 1)
    both = sums.filter("twice > 0").select(*TABLE, F.col("twice").alias("places"), F.lit("overlapping cells").alias("error"))
    gaps = sums.filter(size > F.col("n")).select(*TABLE, (size - F.col("n")).alias("places"), F.lit("ragged rows").alias("error"))
    return odd.unionByName(both).unionByName(gaps).select(*TABLE, "error", "places")


def grid_rows(cells: DataFrame) -> DataFrame:
    """(document_id, table_id, row, cells, markdown): the rows of tables without errors, all of one width; columns that are blank throughout are left out."""
    grid = places(cells).join(grid_errors(cells).select(*TABLE).distinct(), TABLE, "left_anti")
    said = grid.groupBy(*TABLE, "col").agg(F.max(F.trim("text") != "").alias("said")).filter("said").drop("said")
    rows = grid.join(said, [*TABLE, "col"], "left_semi").groupBy(*TABLE, "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda x: x["text"]).alias("cells"))
    return rows.select(*TABLE, "row", "cells", markdown_row(F.col("cells")).alias("markdown"))


def merged_counts(cells: DataFrame) -> DataFrame:
    """(document_id, table_id, n_rows, n_columns, n_cells, n_merged)."""
    merged = (F.col("row_span") > 1) | (F.col("col_span") > 1)
    return cells.filter(possible()).groupBy(*TABLE).agg(
        F.max(F.col("row") + F.col("row_span")).alias("n_rows"), F.max(F.col("col") + F.col("col_span")).alias("n_columns"), F.count("*").alias("n_cells"), F.count_if(merged).alias("n_merged")
    )


def inventory_cells(inventories: DataFrame, document: str = "document_id", payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(cells with `place`, tables: document_id, table_id, title, page, error) of JSON inventories of tables; one that cannot be read gives a row with the error."""
    read = F.from_json(payload, INVENTORY, {"mode": "PERMISSIVE"})
    rows = inventories.select(F.col(document).cast("string").alias("document_id"), read["tables"].alias("tables"))
    each = rows.select("document_id", F.posexplode_outer("tables").alias("table_id", "t"))
    tables = each.select("document_id", F.col("table_id").cast("long").alias("table_id"), "t.title", "t.page", F.when(F.col("t").isNull(), "no tables").alias("error"))
    lines = each.filter("t is not null").select("document_id", F.col("table_id").cast("long").alias("table_id"), F.posexplode("t.rows").alias("row", "r"))
    cells = lines.select("document_id", "table_id", "row", F.posexplode("r.cells").alias("place", "c"))
    return cells.select("document_id", "table_id", "row", F.lit(None).cast("int").alias("col"), F.col("c.rowSpan").alias("row_span"), F.col("c.colSpan").alias("col_span"), "c.text", "place"), tables


def bound_notes(blocks: DataFrame) -> DataFrame:
    """(document_id, block_index, kind, text, table_block): captions and notes with the nearest table of their document; at one distance a caption goes with the table below it, a note
    with the one above. blocks: document_id, block_index, kind ('table', 'caption', 'note' or another), text."""
    by = Window.partitionBy("document_id").orderBy("block_index")
    table = F.when(F.col("kind") == "table", F.col("block_index"))
    above = F.last(table, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    below = F.first(table, ignorenulls=True).over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    near = blocks.withColumns({"above": above, "below": below}).filter("kind in ('caption', 'note')")
    up, down = F.col("block_index") - F.col("above"), F.col("below") - F.col("block_index")
    first_up = F.when(F.col("kind") == "note", up <= down).otherwise(up < down)
    return near.select("document_id", "block_index", "kind", "text", F.when(F.coalesce(first_up, F.col("below").isNull()), F.col("above")).otherwise(F.col("below")).alias("table_block"))
