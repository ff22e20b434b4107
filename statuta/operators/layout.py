"""Pages of placed characters and drawn lines: visual lines, segments, two columns, reading order, ruled tables, their titles and notes.

glyphs: document_id, page, x0, y0, x1, y1, text (one character), size (may be null). pages: document_id, page, width, height, n_drawings. drawings: document_id, page, kind ('line' or
'rect'), x0, y0, x1, y1. No reader of page files is needed: any source of placed characters will do. Glyphs that are blank or have no box are left out; a page without glyphs gives no
rows. Lines and grid lines are found by gaps between sorted places (neighbours within the tolerance belong together), all else by sums and windows of one page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["document_id", "page"]
LINE = [*PAGE, "line"]
# Tolerances in points, shares of the page's width or height, and least counts.
LINE_GAP, LINE_SHARE, DEFAULT_SIZE = 2.2, 0.32, 10.0
SEGMENT_GAP, SEGMENT_WIDTHS, SEGMENT_PAGE, SEGMENT_LETTERS, LEAST_GLYPHS = 24.0, 8.0, 0.09, 6, 8
COLUMN_GAP, COLUMN_WIDTHS, GUTTER = 8.0, 1.5, 0.015
LEAST_SIDE, LEAST_SPLITS, SIDE_COVERAGE, SIDE_OVERLAP, MOST_DRAWINGS = 6, 2, 0.7, 0.6, 16
BLANK_GAP, BLANK_WIDTHS = 2.8, 0.35
RULE_SHARE, RULE_HEIGHT, GRID_GAP, REGION_HEIGHT, TITLE_REACH, NOTES_FROM = 0.25, 28.0, 2.0, 25.0, 90.0, 0.86
OPENING, CLOSING = r"[(\[<]", r"[)\]}>.,:;]"


def visual_lines(glyphs: DataFrame) -> DataFrame:
    """glyphs with `line`, from 1 down the page: a glyph begins a line where it lies lower than the one before it by more than the tolerance of its size."""
    whole = glyphs.filter("trim(text) != '' and x0 is not null and y0 is not null and x1 is not null and y1 is not null")
    down = Window.partitionBy(*PAGE).orderBy("y0", "x0")
    tolerance = F.greatest(F.lit(LINE_GAP), F.coalesce(F.nullif("size", F.lit(0.0)), F.lit(DEFAULT_SIZE)) * LINE_SHARE)
    begins = F.coalesce(F.col("y0") - F.lag("y0").over(down) > tolerance, F.lit(True)).cast("int")
    marked = whole.withColumn("begins", begins)
    return marked.withColumn("line", F.sum("begins").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("begins")


def segments(lines: DataFrame, pages: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """(document_id, page, line, segment, n_segments, x0, y0, x1, y1, text, size) of `visual_lines`. With `columns` (column_tests) a line of a page with two is cut at the gap over the boundary."""
    known = lines.join(pages.select(*PAGE, "width"), PAGE)
    known = known.withColumn("boundary", F.lit(None).cast("double")) if columns is None else known.join(columns.select(*PAGE, "boundary"), PAGE, "left")
    line, along = Window.partitionBy(*LINE), Window.partitionBy(*LINE).orderBy("x0", "x1")
    box = F.greatest(F.lit(0.1), F.col("x1") - F.col("x0"))
    known = known.withColumns({"box": box, "gap": F.col("x0") - F.lag("x1").over(along), "n": F.count("*").over(line)}).withColumn("usual", F.median("box").over(line))
    many = F.col("n") >= LEAST_GLYPHS
    over = (F.lag("x1").over(along) <= F.col("boundary")) & (F.col("boundary") <= F.col("x0")) & (F.col("gap") >= F.greatest(F.lit(COLUMN_GAP), F.col("usual") * COLUMN_WIDTHS, F.col("width") * GUTTER))
    wide = F.col("gap") > F.greatest(F.lit(SEGMENT_GAP), F.col("usual") * SEGMENT_WIDTHS, F.col("width") * SEGMENT_PAGE)
    known = known.withColumn("middle", F.coalesce(many & over, F.lit(False)).cast("int")).withColumn("wide", F.coalesce(many & wide, F.lit(False)).cast("int"))
    # only the first gap over the boundary counts
    known = known.withColumn("centred", F.max("middle").over(line)).withColumn("halves", F.max("middle").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    known = known.withColumn("pieces", F.sum("wide").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    known = known.withColumn("letters", F.count("*").over(Window.partitionBy(*LINE, "pieces"))).withColumn("fewest", F.min("letters").over(line))
    part = F.when(F.col("centred") == 1, F.col("halves")).when(F.col("fewest") >= SEGMENT_LETTERS, F.col("pieces")).otherwise(0)
    known = known.withColumn("segment", (part + 1).cast("int")).withColumn("n_segments", F.max("segment").over(line))
    inside = Window.partitionBy(*LINE, "segment")
    back = inside.orderBy("x0", "x1")
    known = known.withColumns({"usual": F.median("box").over(inside), "before": F.lag("text").over(back), "apart": F.col("x0") - F.lag("x1").over(back)})
    joins = F.col("before").rlike(OPENING) | F.col("text").rlike(CLOSING) | (F.col("before").rlike(r"^\d$") & F.col("text").rlike(r"^\d$"))
    blank = F.when((F.col("apart") > F.greatest(F.lit(BLANK_GAP), F.col("usual") * BLANK_WIDTHS)) & ~joins, " ").otherwise("")
    known = known.withColumn("piece", F.concat(blank, "text"))
    made = known.groupBy(*LINE, "segment", "n_segments").agg(
        *[F.min(c).alias(c) for c in ("x0", "y0")], *[F.max(c).alias(c) for c in ("x1", "y1")],
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("x0").alias("a"), F.col("x1").alias("b"), "piece"))), lambda p: p["piece"]), "").alias("text"),
        F.round(F.median(F.nullif("size", F.lit(0.0))), 3).alias("size"),
    )
    return made


def column_tests(parts: DataFrame, pages: DataFrame) -> DataFrame:
    """(document_id, page, n_left, n_right, boundary): half the width where a page has two columns, else null. parts: `segments` cut without a boundary.

    Two columns: enough segments on either side, lines cut in two or most lines on one side, sides that overlap in height, few drawings."""
    known = parts.join(pages.select(*PAGE, "width", "n_drawings"), PAGE)
    half, margin = F.col("width") / 2, F.col("width") * GUTTER
    left = F.coalesce(F.col("x1") <= half + margin, F.lit(False))
    right = ~left & F.coalesce(F.col("x0") >= half - margin, F.lit(False))
    side = lambda f, c, test: f(F.when(test, F.col(c)))
    sums = known.groupBy(*PAGE, "width", "n_drawings").agg(
        F.count_if(left).alias("n_left"), F.count_if(right).alias("n_right"), F.count_distinct("line").alias("lines"), F.count_distinct(F.when(F.col("n_segments") > 1, F.col("line"))).alias("cut"),
        side(F.min, "y0", left).alias("left0"), side(F.max, "y1", left).alias("left1"), side(F.min, "y0", right).alias("right0"), side(F.max, "y1", right).alias("right1"),
    )
    shared = F.greatest(F.lit(0.0), F.least("left1", "right1") - F.greatest("left0", "right0"))
    shorter = F.greatest(F.lit(1.0), F.least(F.col("left1") - F.col("left0"), F.col("right1") - F.col("right0")))
    sided = (F.col("cut") >= LEAST_SPLITS) | ((F.col("n_left") + F.col("n_right")) / F.col("lines") >= SIDE_COVERAGE)
    two = (F.coalesce("n_drawings", F.lit(0)) < MOST_DRAWINGS) & (F.col("n_left") >= LEAST_SIDE) & (F.col("n_right") >= LEAST_SIDE) & sided & (shared / shorter >= SIDE_OVERLAP)
    return sums.select(*PAGE, "n_left", "n_right", F.when(two, half).alias("boundary"))


def reading_order(parts: DataFrame, pages: DataFrame, columns: DataFrame) -> DataFrame:
    """parts (`segments` cut at the boundaries) with place (from 1 on each page), band, column and review.

    A page with two columns is read header, left, right, footer: the first line with text on both sides ends the header, and what crosses the middle below the columns is the footer. What
    crosses it between them leaves the order in doubt: then, and where no line has two sides, lines are read as they stand and review is true. Other pages have neither band nor column."""
    known = parts.join(pages.select(*PAGE, "width"), PAGE).join(columns.select(*PAGE, "boundary"), PAGE, "left")
    gutter = F.greatest(F.lit(4.0), F.col("width") * GUTTER)
    crosses = (F.col("x0") < F.col("boundary") - gutter) & (F.col("x1") > F.col("boundary") + gutter)
    known = known.withColumn("crosses", F.coalesce(crosses, F.lit(False))).withColumn("side", F.when((F.col("x0") + F.col("x1")) / 2 <= F.col("boundary"), 1).otherwise(2))
    page, line = Window.partitionBy(*PAGE), Window.partitionBy(*LINE)
    on = lambda s: F.max((~F.col("crosses") & (F.col("side") == s)).cast("int")).over(line)
    known = known.withColumn("first", F.when((on(1) == 1) & (on(2) == 1), F.col("line"))).withColumn("first", F.min("first").over(page))
    known = known.withColumn("bottom", F.max(F.when(~F.col("crosses") & (F.col("line") >= F.col("first")), F.col("y1"))).over(page))
    band = F.when(F.col("line") < F.col("first"), "header").when(F.col("crosses") & (F.col("y0") >= F.col("bottom")), "footer").otherwise("body")
    known = known.withColumn("band", band)
    doubt = F.col("first").isNull() | F.col("crosses") & (F.col("band") == "body")
    two = F.col("boundary").isNotNull()
    known = known.withColumn("review", two & (F.max(doubt.cast("int")).over(page) == 1)).withColumn("cut", two & ~F.col("review"))
    rank = F.when(F.col("band") == "header", 0).when(F.col("band") == "body", 1).otherwise(2)
    known = known.withColumns({"column": F.when(F.col("cut"), F.when(F.col("band") == "body", F.col("side")).otherwise(0)), "band": F.when(F.col("cut"), F.col("band")), "rank": F.when(F.col("cut"), rank)})
    order = page.orderBy("rank", "column", F.when(F.col("cut"), F.col("y0")), F.when(F.col("cut"), F.col("x0")), "line", "segment")
    return known.select(*parts.columns, F.row_number().over(order).alias("place"), "band", "column", "review")


def read_pages(glyphs: DataFrame, pages: DataFrame) -> DataFrame:
    """`reading_order` of glyphs: lines, the column test on segments cut by wide gaps, segments cut at the boundary, order."""
    lines = visual_lines(glyphs)
    columns = column_tests(segments(lines, pages), pages)
    return reading_order(segments(lines, pages, columns), pages, columns)


def ruling_lines(drawings: DataFrame) -> DataFrame:
    """(document_id, page, flat, x0, y0, x1, y1): level and upright lines; a rectangle gives its four sides, slanting lines none."""
    sides = lambda a, b, c, d: F.struct(F.least(a, c).alias("x0"), F.least(b, d).alias("y0"), F.greatest(a, c).alias("x1"), F.greatest(b, d).alias("y1"))
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    drawn = F.when(F.col("kind") == "rect", F.array(sides(x0, y0, x1, y0), sides(x0, y1, x1, y1), sides(x0, y0, x0, y1), sides(x1, y0, x1, y1))).when(F.col("kind") == "line", F.array(sides(x0, y0, x1, y1)))
    each = drawings.select(*PAGE, F.explode(drawn).alias("s")).select(*PAGE, "s.*")
    flat = F.when(F.col("y1") - F.col("y0") < 1, True).when(F.col("x1") - F.col("x0") < 1, False)
    return each.withColumn("flat", flat).filter("flat is not null")


def grid_lines(places: DataFrame, keys: list[str], place: str = "at") -> DataFrame:
    """(keys, lines): middles of the groups of places that lie within the tolerance of their neighbours, ascending."""
    along = Window.partitionBy(*keys).orderBy(place)
    begins = F.coalesce(F.col(place) - F.lag(place).over(along) > GRID_GAP, F.lit(True)).cast("int")
    grouped = places.select(*keys, place, begins.alias("begins")).withColumn("island", F.sum("begins").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    middles = grouped.groupBy(*keys, "island").agg(F.round(F.median(place), 3).alias("middle"))
    return middles.groupBy(*keys).agg(F.sort_array(F.collect_list("middle")).alias("lines"))


def ruled_regions(drawings: DataFrame, pages: DataFrame) -> DataFrame:
    """(document_id, page, x0, y0, x1, y1, column_lines, row_lines, n_columns, n_rows) of pages with a ruled table: two long level lines and three long upright ones that make
    a grid wide and high enough. A page has one region, around all its grid lines."""
    rules = ruling_lines(drawings).join(pages.select(*PAGE, "width"), PAGE)
    long = F.when(F.col("flat"), F.col("x1") - F.col("x0") >= F.col("width") * RULE_SHARE).otherwise(F.col("y1") - F.col("y0") >= RULE_HEIGHT)
    rules = rules.filter(long)
    enough = rules.groupBy(*PAGE, "width").agg(F.count_if("flat").alias("level"), F.count_if(~F.col("flat")).alias("upright")).filter("level >= 2 and upright >= 3")
    ends = F.when(F.col("flat"), F.array("y0", "y1")).otherwise(F.array("x0", "x1"))
    grids = grid_lines(rules.join(enough.drop("width"), PAGE, "left_semi").select(*PAGE, "flat", F.explode(ends).alias("at")), [*PAGE, "flat"])
    both = grids.groupBy(*PAGE).agg(F.first(F.when(~F.col("flat"), F.col("lines")), True).alias("column_lines"), F.first(F.when(F.col("flat"), F.col("lines")), True).alias("row_lines"))
    ends = {"x0": F.get("column_lines", 0), "x1": F.element_at("column_lines", -1), "y0": F.get("row_lines", 0), "y1": F.element_at("row_lines", -1)}
    made = both.join(enough.select(*PAGE, "width"), PAGE).filter("size(column_lines) >= 3 and size(row_lines) >= 2").withColumns(ends)
    made = made.filter((F.col("x1") - F.col("x0") >= F.col("width") * RULE_SHARE) & (F.col("y1") - F.col("y0") >= REGION_HEIGHT))
    return made.select(*PAGE, "x0", "y0", "x1", "y1", "column_lines", "row_lines", (F.size("column_lines") - 1).alias("n_columns"), (F.size("row_lines") - 1).alias("n_rows"))


def region_texts(regions: DataFrame, parts: DataFrame) -> DataFrame:
    """regions with text (the segments within them, in order of place) and title (the segment above that is nearest to the middle, larger type counting in its favour)."""
    box = regions.select(*PAGE, *[F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")])
    near = parts.join(box, PAGE).withColumn("text", F.trim("text")).filter("text != ''")
    inside = (F.col("x0") >= F.col("r_x0") - 2) & (F.col("x1") <= F.col("r_x1") + 2) & (F.col("y0") >= F.col("r_y0") - 2) & (F.col("y1") <= F.col("r_y1") + 2)
    above = (F.col("y1") < F.col("r_y0")) & (F.col("r_y0") - F.col("y1") <= TITLE_REACH) & ~F.col("text").startswith("[")
    off = F.abs((F.col("x0") + F.col("x1")) / 2 - (F.col("r_x0") + F.col("r_x1")) / 2) - F.coalesce("size", F.lit(0.0)) * 3
    texts = near.groupBy(*PAGE).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(inside, F.struct("place", "text")))), lambda s: s["text"]), "\n").alias("text"),
        F.min(F.when(above, F.struct(off.alias("off"), (-F.col("y0")).alias("up"), "text"))).alias("title"),
    )
    return regions.join(texts.select(*PAGE, "text", F.col("title.text").alias("title")), PAGE, "left").withColumn("text", F.coalesce("text", F.lit("")))


def note_links(markers: DataFrame, pages: DataFrame) -> DataFrame:
    """(document_id, page, marker, mark_x0, mark_y0, note_x0, note_y0): each mark at the foot of a page with the first equal mark in its body, else with itself. markers: document_id, page,
    marker, x0, y0."""
    known = markers.join(pages.select(*PAGE, "height"), PAGE)
    foot: Column = F.col("y0") >= F.col("height") * NOTES_FROM
    first = known.groupBy(*PAGE, "marker").agg(F.min(F.when(foot, F.struct("x0", "y0"))).alias("note"), F.min(F.when(~foot, F.struct("y0", "x0"))).alias("mark")).filter("note is not null")
    return first.select(*PAGE, "marker", F.coalesce("mark.x0", "note.x0").alias("mark_x0"), F.coalesce("mark.y0", "note.y0").alias("mark_y0"), F.col("note.x0").alias("note_x0"), F.col("note.y0").alias("note_y0"))
