"""Tables in text: rows to cells, likelihood and classification, wrapped rows, review flags, sidecar tables and their matching to chunks.

The splitters of single institutions' layouts are not rebuilt; a row of an unknown form stays whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words of table headers, points of the likelihood and their caps, the threshold, and marks of prose.
HEADERS = ("구분", "항목", "내용", "기준", "금액", "비고", "번호", "직급", "등급", "비율", "기간", "대상", "명칭", "단위", "부서", "보존")
POINTS = {"header": (0.18, 4), "numeric": (0.12, 4), "delimited": (0.12, 4), "structured": (0.08, 4), "short": (0.04, 5)}
ATTACHED, THRESHOLD = 0.15, 0.55
NUMERIC = r"\d[\d,.]*\s*(?:%|퍼센트|원|만원|천원|명|점|일|년|개월)?\s*$"
SENTENCE = r"(?:한다|된다|있다|없다|아니한다|하여야\s*한다)\.?\s*$"
REVISION = r"(?:개정|신설|삭제|시행)\s*\d{4}|<\s*(?:개정|신설|삭제)|^제\s*\d+\s*조"
LEADERS = r"\.{4,}|…{2,}"


def extract_rows(text: Column) -> Column:
    """Lines of a text that are not blank, without rules of a drawn table."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.rtrim(x)), lambda x: (F.trim(x) != "") & ~x.rlike(r"^[\s|+\-─-╿=:]+$"))


def cells_of_row(row: Column) -> Column:
    """Cells of a row by the first form that fits: a whole sentence or article, pipes, tabs or runs of blanks, times of a schedule, 'label: value', a code and its
    words, a term with a period, words before trailing numbers; else the row."""
    flat = F.trim(row)
    trimmed = lambda parts: F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")
    piped = F.transform(F.split(F.regexp_replace(flat, r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    spaced = trimmed(F.split(flat, r"\t|\s{2,}"))
    colon = F.array(F.trim(F.regexp_extract(flat, r"^([^:：]{1,30})[:：]\s*(\S.*)$", 1)), F.trim(F.regexp_extract(flat, r"^([^:：]{1,30})[:：]\s*(\S.*)$", 2)))
    code = F.array(F.regexp_extract(flat, r"^([A-Z]{1,4}[-.]?\d[\dA-Z.\-]*)\s+(\S.*)$", 1), F.regexp_extract(flat, r"^([A-Z]{1,4}[-.]?\d[\dA-Z.\-]*)\s+(\S.*)$", 2))
    period = F.array(F.trim(F.regexp_extract(flat, r"^(.+?)\s+(영구|준영구|\d{1,3}\s*(?:년|개월|일))$", 1)), F.regexp_extract(flat, r"^(.+?)\s+(영구|준영구|\d{1,3}\s*(?:년|개월|일))$", 2))
    tail = r"^(\D*?[^\d\s]\D*?)((?:\s+\d[\d,.]*\s*(?:%|원|명|점)?){2,})$"
    numbers = F.concat(F.array(F.trim(F.regexp_extract(flat, tail, 1))), trimmed(F.split(F.trim(F.regexp_extract(flat, tail, 2)), r"\s+(?=\d)")))
    hits = F.size(F.filter(F.array(*[F.lit(h) for h in HEADERS]), lambda h: flat.contains(h)))
    words = F.split(flat, r"\s+")
    return (
        F.when(flat.rlike(r"^제\s*\d+\s*조") | (flat.rlike(SENTENCE) & ~flat.contains("|")) | flat.rlike(r"^[※○●□▪•-]\s"), F.array(flat))
        .when(flat.contains("|"), piped)
        .when(F.size(spaced) >= 2, spaced)
        .when(flat.rlike(r"^\d{1,2}:\d{2}\s*[~-]\s*\d{1,2}:\d{2}\s"), F.array(F.regexp_extract(flat, r"^(\S+\s*[~-]\s*\S+)\s+(.*)$", 1), F.regexp_extract(flat, r"^(\S+\s*[~-]\s*\S+)\s+(.*)$", 2)))
        .when(flat.rlike(r"^[^:：]{1,30}[:：]\s*\S"), colon)
        .when(flat.rlike(r"^[A-Z]{1,4}[-.]?\d[\dA-Z.\-]*\s+\S"), code)
        .when(flat.rlike(r"^.+?\s+(?:영구|준영구|\d{1,3}\s*(?:년|개월|일))$"), period)
        .when(flat.rlike(tail), numbers)
        .when((hits >= 2) & F.size(words).between(2, 20), words)
        .otherwise(F.array(flat))
    )


def merged_wraps(rows: DataFrame, key: str) -> DataFrame:
    """(key, row_no, cells, flags): a row that goes on in the next one (as many cells, none with a number, the first blank or every cell short) is joined with
    it and flagged. rows: key, row_no, cells. A window over the rows of a table; each row goes on at most once."""
    order = Window.partitionBy(key).orderBy("row_no")
    after = F.lead("cells").over(order)
    digit = lambda cells: F.exists(cells, lambda x: x.rlike(r"\d"))
    wraps = (F.size(after) == F.size("cells")) & (F.size("cells") >= 2) & ~digit(after) & ((F.get(after, 0) == "") | F.forall(after, lambda x: F.length(x) <= 4)) & (F.get("cells", 0) != "")
    rows = rows.withColumn("next", after).withColumn("wraps", F.coalesce(wraps, F.lit(False)))
    taken = F.coalesce(F.lag("wraps").over(order), F.lit(False))
    run = F.row_number().over(order) - F.coalesce(F.max(F.when(~F.col("wraps"), F.col("place"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("run", run).withColumn("taken", taken)
    starts = F.col("wraps") & (F.col("run") % 2 == 1)  # in a run of rows that all wrap, every other one is the first of a pair
    rows = rows.withColumn("starts", starts).withColumn("gone", F.coalesce(F.lag("starts").over(order), F.lit(False)))
    joined = F.zip_with("cells", "next", lambda a, b: F.trim(F.concat_ws(" ", F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))))
    none = F.array().cast("array<string>")
    return rows.filter(~F.col("gone")).select(key, "row_no", F.when(F.col("starts"), joined).otherwise(F.col("cells")).alias("cells"), F.when(F.col("starts"), F.array(F.lit("wrapped_cell_merge"))).otherwise(none).alias("flags"))


def analysed(texts: DataFrame, text: str, context: str) -> DataFrame:
    """texts with rows, cell_rows (of two cells or more), the counts behind the likelihood, confidence, table_like, classification, stability and review_flags.

    context: the kind of chunk. An article needs two delimited rows; three numeric rows count in attachments, two structured ones in attachments and small units."""
    rows = texts.withColumn("rows", extract_rows(F.col(text)))
    rows = rows.withColumn("cell_rows", F.filter(F.transform("rows", cells_of_row), lambda c: F.size(c) >= 2))
    r = F.col("rows")
    n = lambda test: F.size(F.filter(r, test))
    hits = lambda x: F.size(F.filter(F.array(*[F.lit(h) for h in HEADERS]), lambda h: x.contains(h)))
    kind = F.col(context)
    attached = F.coalesce(kind.isin("appendix", "form", "table"), F.lit(False))
    counts = {
        "header": F.coalesce(F.array_max(F.transform(r, hits)), F.lit(0)),
        "numeric": n(lambda x: x.rlike(NUMERIC)),
        "delimited": n(lambda x: x.contains("|") | x.rlike(r"\S(?:\t|\s{2,})\S")),
        "structured": F.size("cell_rows"),
        "short": n(lambda x: F.size(F.split(F.trim(x), r"\s+")).between(2, 12)),
    }
    score = F.when(attached, ATTACHED).otherwise(0.0)
    for name, (each, most) in POINTS.items():
        rows = rows.withColumn(f"n_{name}", counts[name])
        score = score + each * F.least(F.col(f"n_{name}"), F.lit(most))
    rows = rows.withColumn("confidence", F.when(F.size(r) >= 3, F.round(F.least(F.lit(1.0), score), 3)).otherwise(0.0))
    small = F.coalesce(kind.isin("item", "paragraph", "subitem"), F.lit(False))
    signal = (F.col("n_header") >= 2) | (F.col("n_delimited") >= 2) | (attached & (F.col("n_numeric") >= 3)) | ((attached | small) & (F.col("n_structured") >= 2))
    like = (F.col("confidence") >= THRESHOLD) & F.when(kind == "article", F.col("n_delimited") >= 2).otherwise(signal)
    rows = rows.withColumn("likely", F.coalesce(like, F.lit(False)))
    prose, revised, bullets = n(lambda x: x.rlike(SENTENCE)), n(lambda x: x.rlike(REVISION)), n(lambda x: x.rlike(r"^\s*[※○●□▪•-]\s"))
    bare = F.size("cell_rows") == 0
    label = (
        F.when(~F.col("likely"), F.when(attached & (revised >= 3), "probable_false_positive_prose_revision").otherwise("not_table_like"))
        .when(small & (F.size("cell_rows") == 1), "probable_false_positive_single_row")
        .when(~bare, "structured_table")
        .when(revised >= 3, "probable_false_positive_prose_revision")
        .when(prose >= 4, "probable_false_positive_prose_list")
        .when(attached & (bullets >= 4), "probable_false_positive_prose_list")
        .when(attached & (prose >= 3), "probable_false_positive_article_prose")
        .otherwise("probable_table_extraction_failed")
    )
    rows = rows.withColumn("classification", label)
    wrong = F.col("classification").startswith("probable_false_positive")
    rows = rows.withColumn("table_like", F.col("likely") & ~wrong).withColumn("stability", F.when(wrong, "stable").otherwise("attention"))
    return rows.withColumn("review_flags", review_flags()).drop("likely")


def review_flags() -> Column:
    """Why an analysed table needs a look: extraction that failed, no cells, few rows with cells, columns that vary by three or more."""
    widths = F.transform("cell_rows", lambda c: F.size(c))
    flags = F.array(
        F.when(F.col("classification") == "probable_table_extraction_failed", "probable_extraction_failed"),
        F.when(F.size("cell_rows") == 0, "table_like_without_cell_rows"),
        F.when((F.size("rows") >= 8) & (F.size("cell_rows") < 2), "appendix_table_low_structured_row_count"),
        F.when(F.array_max(widths) - F.array_min(widths) >= 3, "unstable_column_count"),
    )
    return F.when(F.col("table_like"), F.array_sort(F.array_compact(flags))).otherwise(F.array().cast("array<string>"))


def citation_label(number: Column, title: Column) -> Column:
    return F.nullif(F.trim(F.concat_ws(" ", number, title)), F.lit(""))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value made once; inside a lambda it would be made for every element."""
    return F.get(F.transform(F.array(value), use), 0)


def match_terms(text: Column) -> Column:
    """Words of two letters or more and, of six signs or more in all, every run of three."""
    runs = lambda bare: F.when(F.length(bare) >= 6, F.transform(F.sequence(F.lit(1), F.length(bare) - 2), lambda i: F.substring(bare, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))
    words = lambda low: F.concat(F.regexp_extract_all(low, F.lit("[0-9a-z가-힣]+"), 0), bound(F.regexp_replace(low, "[^0-9a-z가-힣]+", ""), runs))
    low = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")
    return F.array_distinct(F.filter(bound(low, words), lambda t: F.length(t) >= 2))


def match_numbers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\d+(?:\.\d+)?"), 0))


def term_score(x: Column, y: Column, p: Column, q: Column, same_page: Column) -> Column:
    """0 to 100, of the terms and numbers of two texts: cosine of the terms, up to .2 for shared numbers and .1 for the page."""
    cosine = F.size(F.array_intersect(x, y)) / F.sqrt(F.size(x) * F.size(y))
    bonus = F.when((F.size(p) > 0) & (F.size(q) > 0), F.least(F.lit(0.2), F.size(F.array_intersect(p, q)) / F.greatest(F.size(p), F.size(q)))).otherwise(0.0)
    page = F.when(F.coalesce(same_page, F.lit(False)), 0.1).otherwise(0.0)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.round(F.least(F.lit(1.0), cosine + bonus + page) * 100, 2)).otherwise(0.0)


def match_score(a: Column, b: Column, same_page: Column) -> Column:
    """The score of two texts."""
    return term_score(match_terms(a), match_terms(b), match_numbers(a), match_numbers(b), same_page)


def triaged(tables: DataFrame) -> DataFrame:
    """Sidecar tables (cells: array of rows of cells) with sample and label: contents, a weak signal, prose, structured, possible, attachment or to be reviewed."""
    rows = F.filter("cells", lambda r: F.array_join(r, "") != "")
    sample = F.array_join(F.transform(F.slice(rows, 1, 6), lambda r: F.array_join(r, " | ")), " / ")
    n, width = F.size("cells"), F.coalesce(F.array_max(F.transform("cells", lambda r: F.size(r))), F.lit(0))
    total = F.greatest(F.aggregate("cells", F.lit(0), lambda s, r: s + F.size(r)), F.lit(1))
    out = tables.withColumn("sample", sample)
    mean = F.length("sample") / total
    article = F.col("sample").rlike(r"제\s*\d+\s*조")
    heads = F.size(F.filter(F.coalesce(F.get(rows, 0), F.array().cast("array<string>")), lambda c: (F.length(F.regexp_replace(c, r"\s+", "")) <= 20) & c.rlike("|".join(HEADERS))))
    label = (
        F.when(F.col("sample").rlike(LEADERS), "probable_toc_table")
        .when((n <= 1) & (width <= 1), "weak_single_cell_signal")
        .when(article & ((mean >= 45) | (n <= 5)), "probable_prose_false_positive")
        .when((width >= 2) & (n >= 2) & (heads >= 1), "structured_table_candidate")
        .when((width >= 4) & (n >= 2) & (mean < 35) & ~article, "possible_table_candidate")
        .when((width >= 2) & (n >= 3) & (mean < 60), "possible_table_candidate")
        .when(F.lower("sample").rlike("appendix|form"), "attachment_candidate")
        .otherwise("needs_ai_review")
    )
    return out.withColumn("label", label)


def best_tables(chunks: DataFrame, tables: DataFrame, scope: str, most: int = 64) -> DataFrame:
    """(chunk_id, table_id, score, match): the sidecar table of the same document that is most like each chunk, of those that share a term with it; chunks:
    chunk_id, text, page; tables: table_id, sample, label, page.

    In a document of few pairs, `most` for each chunk and table or fewer, all meet; in others chunks and tables meet on a shared term, so their pairs are not all made.
    All joins are by shuffle: what a small file explodes into is not small."""
    of_chunk = [match_terms(F.col("text")).alias("x"), match_numbers(F.col("text")).alias("p")]
    of_table = [match_terms(F.col("sample")).alias("y"), match_numbers(F.col("sample")).alias("q")]
    count = lambda df, n: df.groupBy(scope).agg(F.count("*").alias(n))
    sizes = count(chunks, "n_c").join(count(tables, "n_t").hint("merge"), scope)
    few = F.col("n_c") * F.col("n_t") <= (F.col("n_c") + F.col("n_t")) * most

    def sides(test: Column) -> tuple[DataFrame, DataFrame]:
        """Terms of the chunks and tables of these documents, made where a document's rows already are together."""
        own = sizes.filter(test).select(scope).hint("merge")
        return chunks.join(own, scope).select(scope, "chunk_id", F.col("page").alias("pa"), *of_chunk), tables.join(own, scope).select(scope, "table_id", "label", F.col("page").alias("pb"), *of_table)

    c, t = sides(few)
    met = c.join(t.hint("merge"), scope).filter(F.arrays_overlap("x", "y"))
    c, t = sides(~few)
    pairs = c.select(scope, "chunk_id", F.explode("x").alias("term")).join(t.select(scope, "table_id", F.explode("y").alias("term")).hint("merge"), [scope, "term"])
    pairs = pairs.select(scope, "chunk_id", "table_id").distinct()
    met = met.unionByName(pairs.join(c.hint("merge"), [scope, "chunk_id"]).join(t.hint("merge"), [scope, "table_id"]))
    scored = met.select(scope, "chunk_id", "table_id", "label", term_score(F.col("x"), F.col("y"), F.col("p"), F.col("q"), F.col("pa") == F.col("pb")).alias("score"))
    best = scored.groupBy(scope, "chunk_id").agg(F.max(F.struct("score", F.struct("table_id", "label"))).alias("b"))
    match = F.when((F.col("score") >= 45) & (F.col("label") == "structured_table_candidate"), "strong_review_match").when(F.col("score") >= 30, "medium_review_match").when(F.col("score") >= 18, "weak_review_match").otherwise("no_confident_match")
    return best.select(scope, "chunk_id", F.col("b.col2.table_id").alias("table_id"), F.col("b.score").alias("score"), F.col("b.col2.label").alias("label")).withColumn("match", match)


def promoted_tables(chunks: DataFrame, tables: DataFrame, matches: DataFrame, least: float = 45.0) -> DataFrame:
    """(chunk_id, table_id, text, promoted): chunks whose best table is structured and scores `least` take its rows for text; structured tables that no chunk took
    become chunks of their own."""
    taken = matches.filter((F.col("score") >= least) & (F.col("label") == "structured_table_candidate")).select("chunk_id", "table_id")
    taken = taken.join(tables.select("table_id", F.col("sample").alias("rows")), "table_id")
    own = chunks.join(taken, "chunk_id", "left").select("chunk_id", "table_id", F.coalesce("rows", "text").alias("text"), F.col("table_id").isNotNull().alias("promoted"))
    rest = tables.filter("label = 'structured_table_candidate'").join(taken.select("table_id").distinct(), "table_id", "left_anti")
    return own.unionByName(rest.select(F.concat(F.lit("table_"), F.col("table_id").cast("string")).alias("chunk_id"), "table_id", F.col("sample").alias("text"), F.lit(True).alias("promoted")))


def open_regions(regions: DataFrame, boxes: DataFrame, most: float = 0.8) -> DataFrame:
    """Table regions (document_id, page, region_id, x0, y0, x1, y1) of which less than `most` is covered by any one chunk box of the page."""
    b = boxes.select("document_id", "page", *[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")])
    met = regions.join(b, ["document_id", "page"])
    width = F.greatest(F.lit(0.0), F.least("x1", "b_x1") - F.greatest("x0", "b_x0"))
    height = F.greatest(F.lit(0.0), F.least("y1", "b_y1") - F.greatest("y0", "b_y0"))
    area = F.greatest(F.lit(1e-9), (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    held = met.filter(width * height / area >= most).select("document_id", "page", "region_id").distinct()
    return regions.join(held, ["document_id", "page", "region_id"], "left_anti")


def records_of(cell_rows: Column, header: Column) -> Column:
    """A map of header to cell for each row; a repeated header has ' (k)' after its name, so no value is lost."""
    from statuta.operators.structure import unique_headers

    names = unique_headers(header)
    pad = lambda r: F.transform(F.sequence(F.lit(0), F.size(names) - 1), lambda i: F.coalesce(F.get(r, i), F.lit("")))
    return F.transform(cell_rows, lambda r: F.map_from_arrays(names, pad(r)))
