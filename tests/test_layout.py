"""Placed characters and drawn lines: segments, columns, order, ruled regions, notes."""

from statuta.operators import layout

GLYPH = "document_id string, page int, x0 double, y0 double, x1 double, y1 double, text string, size double"
PAGES = "document_id string, page int, width double, height double, n_drawings int"
DRAWN = "document_id string, page int, kind string, x0 double, y0 double, x1 double, y1 double"


def typed(doc, x, y, text, size=10.0, step=7.0):
    return [(doc, 1, x + step * i, float(y), x + step * i + 6, y + 10.0, c, size) for i, c in enumerate(text) if c != " "]


def test_segments_and_blanks(spark):
    rows = typed("a", 50, 100, "short  x") + typed("b", 50, 100, "( 1 2 ) ab, c d") + typed("c", 50, 100, "leftpart") + typed("c", 400, 101, "rightpart") + typed("c", 50, 120, "leftpart") + typed("c", 400, 120, "few")
    rows += [("a", 1, None, 1.0, 2.0, 3.0, "z", 10.0), ("a", 1, 1.0, 1.0, 2.0, 3.0, " ", 10.0), ("a", 1, 1.0, 1.0, 2.0, 3.0, None, None)]
    pages = spark.createDataFrame([(d, 1, 600.0, 800.0, None) for d in "abc"], PAGES)
    glyphs = spark.createDataFrame(rows, GLYPH)
    found = layout.segments(layout.visual_lines(glyphs), pages)
    assert sorted((r["document_id"], r["line"], r["segment"], r["text"]) for r in found.collect()) == [
        ("a", 1, 1, "short x"), ("b", 1, 1, "(12) ab, c d"), ("c", 1, 1, "leftpart"), ("c", 1, 2, "rightpart"), ("c", 2, 1, "leftpart few"),
    ]
    assert layout.read_pages(glyphs.limit(0), pages).count() == 0


def two_columns(doc, lines=8):
    return [g for j in range(lines) for g in typed(doc, 50, 100 + 14 * j, f"leftside{j}") + typed(doc, 350, 100 + 14 * j, f"rightside{j}")]


def test_column_test(spark):
    rows = two_columns("two") + two_columns("drawn") + two_columns("few", 5)
    rows += [g for j in range(8) for g in typed("apart", 50, 100 + 14 * j, f"leftside{j}") + typed("apart", 350, 400 + 14 * j, f"rightside{j}")]
    pages = spark.createDataFrame([(d, 1, 600.0, 800.0, 16 if d == "drawn" else 15) for d in ("two", "drawn", "few", "apart")], PAGES)
    glyphs = spark.createDataFrame(rows, GLYPH)
    tests = layout.column_tests(layout.segments(layout.visual_lines(glyphs), pages), pages)
    assert {r["document_id"]: r["boundary"] for r in tests.collect()} == {"two": 300.0, "drawn": None, "few": None, "apart": None}


def test_cut_at_the_boundary(spark):
    """A gap too narrow for a segment is cut where it lies over the boundary of a page known to have two columns."""
    rows = two_columns("d") + typed("d", 243, 240, "leftside") + typed("d", 312, 240, "rightside")
    pages = spark.createDataFrame([("d", 1, 600.0, 800.0, 0)], PAGES)
    read = layout.read_pages(spark.createDataFrame(rows, GLYPH), pages).orderBy("place").collect()
    assert [r["text"] for r in read] == [f"leftside{j}" for j in range(8)] + ["leftside"] + [f"rightside{j}" for j in range(8)] + ["rightside"]
    assert {r["review"] for r in read} == {False}


def test_crossing_text_is_in_doubt(spark):
    rows = two_columns("d") + typed("d", 200, 149, "acrossthemiddleofthepage")
    pages = spark.createDataFrame([("d", 1, 600.0, 800.0, 0)], PAGES)
    read = layout.read_pages(spark.createDataFrame(rows, GLYPH), pages).orderBy("place").collect()
    assert {(r["review"], r["band"], r["column"]) for r in read} == {(True, None, None)}
    assert [r["text"] for r in read][6:9] == ["leftside3", "rightside3", "acrossthemiddleofthepage"]


def test_regions(spark):
    drawn = [("a", 1, "rect", 100.0, 100.0, 400.0, 200.0), ("a", 1, "line", 250.4, 200.0, 250.0, 100.0), ("a", 1, "line", 101.0, 100.0, 399.0, 100.5), ("b", 1, "rect", 100.0, 100.0, 400.0, 200.0), ("c", 1, "curve", 1.0, 1.0, 2.0, 2.0)]
    drawn += [("n", 1, "line", x, 100.0, x, 200.0) for x in (100.0, 140.0, 180.0)] + [("n", 1, "line", 100.0, y, 400.0, y) for y in (100.0, 200.0)]
    pages = spark.createDataFrame([(d, 1, 600.0, 800.0, 0) for d in "abcn"], PAGES)
    found = layout.ruled_regions(spark.createDataFrame(drawn, DRAWN), pages)
    assert [(r["document_id"], r["n_columns"], r["n_rows"], r["column_lines"], r["y0"]) for r in found.collect()] == [("a", 2, 1, [100.0, 250.2, 400.0], 100.0)]
    none = layout.region_texts(found, spark.createDataFrame([], "document_id string, page int, place int, x0 double, y0 double, x1 double, y1 double, text string, size double")).collect()
    assert [(r["text"], r["title"]) for r in none] == [("", None)]


def test_grid_lines(spark):
    places = spark.createDataFrame([("a", x) for x in (10.0, 12.0, 14.0, 30.0, 30.0, 33.0)], "k string, at double")
    assert layout.grid_lines(places, ["k"]).first()["lines"] == [12.0, 30.0, 33.0]


def test_notes(spark):
    marks = [("d", 1, "i", 50.0, 700.0), ("d", 1, "i", 80.0, 300.0), ("d", 1, "i", 20.0, 400.0), ("d", 1, "ii", 60.0, 720.0), ("d", 1, "iii", 60.0, 100.0)]
    pages = spark.createDataFrame([("d", 1, 600.0, 800.0, 0)], PAGES)
    found = layout.note_links(spark.createDataFrame(marks, "document_id string, page int, marker string, x0 double, y0 double"), pages)
    assert {(r["marker"], r["mark_x0"], r["mark_y0"], r["note_y0"]) for r in found.collect()} == {("i", 80.0, 300.0, 700.0), ("ii", 60.0, 720.0, 720.0)}
