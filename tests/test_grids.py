"""Grids of merged cells against a drawing of them, HWPX tables, captions and notes."""

import io
import random
import zipfile

from pyspark.sql import functions as F

from statuta.operators import grids
from statuta.sources import readers

HP = "http://www.hancom.co.kr/hwpml/2011/paragraph"


def test_columns_by_reading_order():
    r = random.Random(3)
    for _ in range(300):  # cut a grid into cells; their columns must be found again
        height, width = r.randrange(1, 6), r.randrange(1, 6)
        owner, cells = {}, []
        for y in range(height):
            for x in range(width):
                if (y, x) in owner:
                    continue
                down, across = r.randrange(1, height - y + 1), 1
                while x + across < width and (y, x + across) not in owner and r.random() < 0.4:
                    across += 1
                for a in range(y, y + down):
                    for b in range(x, x + across):
                        owner[a, b] = len(cells)
                cells.append((y, x, down, across))
        assert grids.fill_columns([c[0] for c in cells], [c[2:] for c in cells]) == [c[1] for c in cells]


def cell(row, col, text, down=1, across=1, inner=""):
    return f'<hp:tc><hp:subList><hp:p><hp:run><hp:t>{text}</hp:t>{inner}</hp:run></hp:p></hp:subList><hp:cellAddr colAddr="{col}" rowAddr="{row}"/><hp:cellSpan colSpan="{across}" rowSpan="{down}"/></hp:tc>'


def hwpx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("Contents/section0.xml", f'<hp:sec xmlns:hp="{HP}">{body}</hp:sec>')
    return out.getvalue()


def test_hwpx_tables_captions_and_notes(spark, tmp_path):
    nested = "<hp:tbl><hp:tr>" + cell(0, 0, "속") + "</hp:tr></hp:tbl>"
    table = "<hp:tbl><hp:caption><hp:subList><hp:p><hp:run><hp:t>표 1 수당</hp:t></hp:run></hp:p></hp:subList></hp:caption>"
    table += "<hp:tr>" + cell(0, 0, "직급", 2) + cell(0, 1, "금액", 1, 2) + "</hp:tr><hp:tr>" + cell(1, 1, "기본", inner="<hp:footNote><hp:subList><hp:p><hp:run><hp:t>주 1</hp:t></hp:run></hp:p></hp:subList></hp:footNote>") + cell(1, 2, "가족", inner=nested) + "</hp:tr></hp:tbl>"
    (tmp_path / "a.hwpx").write_bytes(hwpx(f"<hp:p><hp:run><hp:t>글</hp:t>{table}</hp:run></hp:p>"))
    (tmp_path / "b.hwpx").write_bytes(b"no archive")
    rows = readers.read_tables(spark, f"file://{tmp_path}")
    assert [r["error"][:10] for r in rows.filter("error is not null").collect()] == ["BadZipFile"]
    parts = rows.filter("error is null").orderBy("place").collect()
    assert [(r["kind"], r["table_id"], r["text"]) for r in parts if r["kind"] != "cell"] == [("caption", 0, "표 1 수당"), ("note", 0, "주 1")]
    cells = grids.located(rows.filter("kind = 'cell'").drop("kind", "error"))
    found = {(r["table_id"], r["row"]): r["cells"] for r in grids.grid_rows(cells).collect()}
    assert found == {(0, 0): ["직급", "금액", "금액"], (0, 1): ["직급", "기본", "가족"], (1, 0): ["속"]}
    counts = {r["table_id"]: (r["n_rows"], r["n_columns"], r["n_cells"], r["n_merged"]) for r in grids.merged_counts(cells).collect()}
    assert counts == {0: (2, 3, 4, 2), 1: (1, 1, 1, 0)}


def test_odd_cells(spark):
    rows = [("d", 1, 0, None, None, None, "a", 0), ("d", 1, 0, None, 2, 1, "b", 1), ("d", 1, 1, None, 1, 1, "c", 0), ("d", 2, 0, 0, 20_000, 1, "huge", 0), ("d", 3, 0, 0, 1, 1, None, 0), ("d", 4, None, 0, 1, 1, "no row", 0)]
    cells = spark.createDataFrame(rows, "document_id string, table_id long, row int, col int, row_span int, col_span int, text string, place int")
    at = grids.located(cells)
    assert {(r["table_id"], r["row"]): r["cells"] for r in grids.grid_rows(at).collect()} == {(1, 0): ["a", "b"], (1, 1): ["c", "b"]}
    assert {(r["table_id"], r["error"]) for r in grids.grid_errors(at).collect()} == {(2, "impossible cell"), (4, "impossible cell")}
    assert grids.grid_rows(at.limit(0)).count() == 0


def test_captions_without_a_table(spark):
    blocks = spark.createDataFrame([("d", 0, "caption", "x"), ("d", 1, "text", ""), ("e", 0, "table", ""), ("e", 3, "caption", "far"), ("e", 4, "note", "n")], "document_id string, block_index int, kind string, text string")
    assert {(r["document_id"], r["block_index"]): r["table_block"] for r in grids.bound_notes(blocks).collect()} == {("d", 0): None, ("e", 3): 0, ("e", 4): 0}
