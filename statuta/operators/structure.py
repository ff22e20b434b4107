"""Structure of a text: lines, their classes, the tree of parts, articles and items, and chunks of it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Line patterns in the order they are tried, with their level in the tree. Group 1 is the number, group 2 the title.
CIRCLED = "①-⑳㉑-㉚"
SYLLABLES = "가나다라마바사아자차카타파하"
ATTACHMENT_NUMBER = r"\d+(?:\s*(?:의|-)\s*\d+)?"
LINE_CLASSES = [
    ("appendix", 1, rf"^\s*[\[【<]?\s*((?:별\s*표\s*(?:{ATTACHMENT_NUMBER})?|(?:붙\s*임|첨\s*부)\s*제?\s*{ATTACHMENT_NUMBER}|부\s*록\s*(?:제?\s*{ATTACHMENT_NUMBER})?))\s*[\]】>]?\s*(.*)$"),
    ("form", 1, rf"^\s*[\[【<]?\s*(별\s*지\s*제?\s*(?:{ATTACHMENT_NUMBER})?\s*호?\s*서식)\s*[\]】>]?\s*(.*)$"),
    ("supplementary", 1, r"^\s*(부\s*칙)\s*(.*)$"),
    ("part", 1, r"^\s*(제\s*\d+\s*편)\s+(.+)$"),
    ("chapter", 2, r"^\s*(제\s*\d+\s*장)\s+(.+)$"),
    ("section", 3, r"^\s*(제\s*\d+\s*절)\s+(.+)$"),
    ("subsection", 4, r"^\s*(제\s*\d+\s*관)\s+(.+)$"),
    ("regulation", 0, r"^\s*(\d+-\d+-\d+)\.\s+(.+)$"),
    ("article", 5, r"^\s*(제\s*\d+\s*조(?:의\s*\d+)?)(?=\s*(?:\(|\[|【|<|삭제|$|\s))\s*(.*)$"),
    ("paragraph", 6, rf"^\s*([{CIRCLED}])\s*(.*)$"),
    ("paragraph", 6, r"^\s*(제\s*\d+\s*항)(?=\s|$)\s*(.*)$"),
    ("paragraph", 6, r"^\s*(\(\d+\))\s*(.*)$"),
    ("paragraph", 6, r"^\s*(□)\s+(.+)$"),
    ("item", 7, r"^\s*(\d{1,2}(?:\.\d{1,2})+\.)(?=[^\s\d.])(.+)$"),
    ("item", 7, r"^\s*(\d+(?:\.\d+)+\.)\s+(.+)$"),
    ("item", 7, r"^\s*(\d{1,2}\.)(?=[^\s\d.])(.+)$"),
    ("item", 7, r"^\s*(\d+\.)\s+(.+)$"),
    ("item", 7, r"^\s*(\d{1,2}\))(?=[^\s\d)])(.+)$"),
    ("item", 7, r"^\s*(\d+\))\s+(.+)$"),
    ("item", 7, r"^\s*(제\s*\d+\s*호)(?=\s|$)\s*(.*)$"),
    ("subitem", 8, rf"^\s*([{SYLLABLES}][.)])\s*(.+)$"),
    ("subitem", 8, rf"^\s*(\([{SYLLABLES}]\))\s*(.+)$"),
]
# What any of them begins with; most lines of a text fail this one test.
HEADING_START = rf"^\s*[\[【<]?\s*(?:제\s*\d|부\s*[칙록]|별\s*[표지]|붙\s*임|첨\s*부|[{CIRCLED}□(]|\d|[{SYLLABLES}][.)])"
DATE_FRAGMENT = r"^\s*(?:18|19|20|21)\d{2}\s*[.\-]\s*\d{1,2}\s*[.\-]\s*\d{1,2}(?:\s*\.|\b)"
ARTICLE_TITLE = r"^(?:\(([^)\n]+)\)|\[([^\]\n]+)\]|【([^】\n]+)】)"
REFERENCE_TAIL = r"^(?:제\s*\d+\s*(?:항|호)|및|내지|부터|까지|관련|중(?![가-힣]))"
PREDICATE_END = r"(?:한다|된다|있다|없다|같다|따른다|본다|말한다|하여야\s*한다|할\s*수\s*있다)$"
PARTICLE = r"(?:은|는|이|가|을|를|에|에서|으로|로)\s"
ATTACHMENT_PARTICLE = "(?:의|을|를|은|는|과|와|중|에|에서|으로|로)"
CAPTION = r"^\s*(?:(?:[\[【<〈(]\s*)?(?:표|그림)\s*\d+\s*(?:[.\-):：\]】>〉]|$)|(?:각주|미주|캡션|caption)\b)"


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no from 0, line) of every line that is not blank."""
    return docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line_no", "line")).filter(F.trim("line") != "")


def split_inline(line: Column) -> Column:
    """A line cut before the markers inside it (①, (1), 1., 1), 가., 제N조(…), 제N항, 제N호): an array of parts.

    Captions and attachment headings stay whole. Numbers of a date are no markers, nor are numbers of a regulation ('규정 제5호'), nor circled
    ones inside a line that opens with □ or (1)."""
    marker = (
        rf"(?:[{CIRCLED}]|□(?=\s)|\(\d{{1,2}}\)(?=\s)|\d{{1,2}}\)(?=\s)|\d{{1,2}}(?:\.\d{{1,2}})*\.(?=\s)|\d{{1,2}}\.(?=[^\s\d.])|\([{SYLLABLES}]\)(?=\s)|[{SYLLABLES}][.)](?=\s)"
        r"|제\s*\d+\s*조(?:의\s*\d+)?(?=\s*[(\[【])|제\s*\d+\s*항(?=\s|$)|(?<!(?:규정|내규|정관|세칙|규칙|기준|요령|지침|편람) {0,3})제\s*\d+\s*호(?!\s*(?:서식|전문개정|일부개정|개정|시행|삭제|신설|변경))(?=\s|$))"
    )
    no_date = r"(?<!\d{4}[.\-] {0,3})(?<!\d{4}[.\-] {0,3}\d{1,2}[.\-] {0,3})"
    plain = marker.replace(f"[{CIRCLED}]|", "", 1)
    whole = line.rlike(CAPTION) | line.rlike(LINE_CLASSES[0][2]) | line.rlike(LINE_CLASSES[1][2])
    cut = lambda m: F.split(F.regexp_replace(line, rf"(?<=\S)\s+{no_date}(?={m})", "\n"), "\n")
    parts = F.when(whole, F.array(line)).when(line.rlike(r"^\s*(?:□|\(\d+\))"), cut(plain)).otherwise(cut(marker))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def source_lines(blocks: DataFrame, key: str, text: str, block_type: str, block_index: str) -> DataFrame:
    """(key, line_no, line, block_type): lines of text blocks, cut before inline markers; a table block is one line."""
    whole = F.col(block_type) == "table"
    lines = F.when(whole, F.array(F.col(text))).otherwise(F.flatten(F.transform(F.split(F.col(text), "\n"), split_inline)))
    rows = blocks.select(key, block_index, F.col(block_type).alias("block_type"), F.posexplode(lines).alias("part", "line")).filter(F.trim("line") != "")
    place = F.row_number().over(Window.partitionBy(key).orderBy(block_index, "part")) - 1
    return rows.select(key, place.alias("line_no"), "line", "block_type")


def is_attachment_reference(line: Column, tail: Column) -> Column:
    """An attachment named in a sentence, not begun here."""
    bare = F.regexp_replace(line, r"\s+", "")
    tail = F.trim(tail)
    return (
        bare.rlike(rf"[\]】]{ATTACHMENT_PARTICLE}")
        | bare.rlike(r"[\]】].{0,20}(?:하여야한다|작성하여|제출하여|참조하여|따른다)")
        | tail.rlike(rf"^{ATTACHMENT_PARTICLE}(?![가-힣])")
        | tail.rlike(rf"^[-–]\s*\d+\s*{ATTACHMENT_PARTICLE}(?![가-힣])")
        | tail.rlike(r"^(?:참조|참고)(?:[^가-힣]|$)")
        | tail.rlike(r"(?:같이|다음과|개정|삭제|신설|이동).{0,20}한다")
    )


def plain_title(tail: Column) -> Column:
    """An article's title without brackets: a short phrase, no sentence."""
    phrase = tail.rlike(r"^[가-힣A-Za-z0-9ㆍ·&/\-\s]{1,80}$") & ~tail.rlike(PREDICATE_END) & ~tail.rlike(PARTICLE)
    return F.when(phrase, tail)


def classified(lines: DataFrame) -> DataFrame:
    """lines with node_type (text if none fits), level, number, title and lead (an article's text after its title).

    A table line (block_type, if there) is a table. References are no headings: '제5조에 따라', '[별표 1]의', '제3조 및'; a date is no item."""
    line = F.col("line")
    dated = line.rlike(DATE_FRAGMENT)
    tests = []
    for i, (name, _, pattern) in enumerate(LINE_CLASSES):
        test = line.rlike(pattern)
        if name in ("appendix", "form"):
            test = F.when(test & is_attachment_reference(line, F.regexp_extract(line, pattern, 2)), -1).when(test, i)
        elif name == "article":
            tail = F.regexp_extract(line, pattern, 2)
            test = F.when(test & ~tail.rlike(ARTICLE_TITLE) & ~tail.rlike(r"^<?\s*(?:생략|삭제)") & tail.rlike(REFERENCE_TAIL), -1).when(test, i)
        else:
            test = F.when(test & ~dated if name == "item" else test, i)
        tests.append(test)
    rule = F.when(line.rlike(HEADING_START), F.coalesce(*tests))
    if "block_type" in lines.columns:
        rule = F.when(F.col("block_type") == "table", len(LINE_CLASSES)).otherwise(rule)
    rows = lines.withColumn("rule", F.coalesce(rule, F.lit(-1)))

    def by_rule(of, otherwise: Column) -> Column:
        out = F.when(F.lit(False), otherwise)
        for i, entry in enumerate(LINE_CLASSES):
            out = out.when(F.col("rule") == i, of(*entry))
        return out.otherwise(otherwise)

    kinds = F.array(*[F.lit(n) for n, _, _ in LINE_CLASSES], F.lit("table"))
    levels = F.array(*[F.lit(n) for _, n, _ in LINE_CLASSES], F.lit(9))
    rows = rows.withColumn("number", by_rule(lambda n, _, p: F.regexp_replace(F.regexp_extract(line, p, 1), r"\s+", ""), F.lit("")))
    rows = rows.withColumn("tail", by_rule(lambda n, _, p: F.trim(F.regexp_extract(line, p, 2)), F.lit("")))
    tail, article = F.col("tail"), F.get(kinds, F.col("rule")) == "article"
    bracketed = F.coalesce(*[F.nullif(F.trim(F.regexp_extract(tail, ARTICLE_TITLE, k)), F.lit("")) for k in (1, 2, 3)])
    lifecycle = F.nullif(F.regexp_extract(tail, r"^<?\s*(생략|삭제)", 1), F.lit(""))
    rest = F.trim(F.regexp_replace(tail, ARTICLE_TITLE, ""))
    plain = F.when(bracketed.isNull() & lifecycle.isNull(), plain_title(tail))
    title = F.when(article, F.coalesce(bracketed, lifecycle, plain, F.lit(""))).otherwise(tail)
    lead = F.when(article & bracketed.isNotNull(), rest).when(article & plain.isNull(), tail).otherwise("")
    names = [c for c in lines.columns]
    return rows.select(
        *names, F.coalesce(F.get(kinds, F.when(F.col("rule") >= 0, F.col("rule"))), F.lit("text")).alias("node_type"),
        F.coalesce(F.get(levels, F.when(F.col("rule") >= 0, F.col("rule"))), F.lit(9)).alias("level"), "number", title.alias("title"), lead.alias("lead"),
    )


def fact(name: str, level: int, number: Column, title: Column) -> Column:
    return F.struct(F.lit(name).alias("node_type"), F.lit(level).alias("level"), number.alias("number"), title.alias("title"))


def classified_by(lines: DataFrame, classes: list[tuple[str, int, str]], given: Column) -> DataFrame:
    """lines as classified() gives them, by an institution's own classes (name, level, pattern with the number and what follows it): the first that fits, without
    the rules for references and dates. given: the fact() that a line's reader knows, else null; it stands before all classes."""
    line = F.col("line")
    found = [F.when(line.rlike(p), fact(n, k, F.regexp_replace(F.regexp_extract(line, p, 1), r"\s+", ""), F.trim(F.regexp_extract(line, p, 2)))) for n, k, p in classes]
    return lines.withColumn("fact", F.coalesce(given, *found, fact("text", 9, F.lit(""), F.lit("")))).select(*lines.columns, "fact.*", F.lit("").alias("lead"))


def demoted(lines: DataFrame, key: str) -> DataFrame:
    """Classified lines in which headings that only look like ones are text again.

    Numbered lines before any article or paragraph that list revisions or contents ('1. 규정 제5호 개정', '1. 총칙 ..... 3'); and articles quoted inside
    a supplementary provision that amends other regulations. A window over each document's lines."""
    order = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    line, kind = F.col("line"), F.col("node_type")
    listing = (
        line.rlike(r"^\s*\d{1,3}[.)]\s*(?:규정|내규|정관|세칙|기준|요령|지침|편람|규칙)\s*제\s*\d+\s*호\s*(?:일부|전부|전문)?(?:개정|제정|폐지)(?:$|\s|[<(])")
        | (line.rlike(r"^\s*\d{1,3}[.)]\s+") & line.rlike(r"(?:개정|시행|삭제|신설|변경)") & line.rlike(r"\d{4}\s*[.\-]\s*\d{1,2}\s*[.\-]\s*\d{1,2}"))
        | line.rlike(r"^\s*\d{1,2}\.\s+.{1,80}\.{3,}\s*\d{1,4}$")
    )
    reset = kind.isin("regulation", "part", "chapter", "section", "subsection", "appendix", "form", "supplementary")
    anchor = kind.isin("article", "paragraph", "subitem") | ((kind == "item") & ~listing)
    last = lambda test: F.coalesce(F.max(F.when(test, F.col("line_no"))).over(order), F.lit(-1))
    amends = line.rlike(r"다른\s*(?:규정|법령)의\s*개정|관련\s*규정의\s*개정|개정한다|다음과 같이 한다")
    own = F.col("title").rlike(r"시행일|적용례|경과|특례|다른 규정의 개정|다른 법령의 개정")
    rows = lines.withColumn("anchored", last(anchor) > last(reset)).withColumn("since", last(reset & (kind == "supplementary")))
    rows = rows.withColumn("supplement", (F.col("since") >= 0) & (F.col("since") == last(reset)))
    # inside a supplement the container is the last article of its own; what amends stands in it or after it
    rows = rows.withColumn("container", last((kind == "article") & own)).withColumn("amending", last(amends))
    quoted = (kind == "article") & F.col("supplement") & (F.col("container") > F.col("since")) & (F.col("amending") >= F.col("container")) & ~own
    out = (quoted | ((kind == "item") & listing & ~F.col("anchored")))
    text = lambda c, v: F.when(out, F.lit(v)).otherwise(F.col(c)).alias(c)
    changed = {"node_type": text("node_type", "text"), "level": text("level", 9), "number": text("number", ""), "title": text("title", ""), "lead": text("lead", "")}
    return rows.select(*[changed.get(c, F.col(c)) for c in lines.columns])


def without_contents(lines: DataFrame, key: str) -> DataFrame:
    """Classified lines without a table of contents: from a line '목차' (차례, contents), or dot leaders, to the last numbered regulation before the
    first article, where those regulations come again later. Kept whole where no body repeats them."""
    whole = Window.partitionBy(key)
    after = whole.orderBy("line_no").rowsBetween(1, Window.unboundedFollowing)
    first_article = F.min(F.when(F.col("node_type") == "article", F.col("line_no"))).over(whole)
    heading = F.lower(F.regexp_replace("line", r"\s+", "")).isin("목차", "차례", "contents")
    leader = F.col("line").rlike(r"\.{3,}\s*\d{1,4}\s*$|…+\s*\d{1,4}\s*$")
    rows = lines.withColumn("begin", F.max(F.when(heading & (F.col("line_no") < first_article), F.col("line_no"))).over(whole)).withColumn("leader", leader)
    key_of = F.regexp_replace(F.regexp_replace("title", r"[.…]{2,}\s*\d*\s*$|\s+\d{1,4}$", ""), r"\s+", "")
    rows = rows.withColumn("name", F.when(F.col("node_type") == "regulation", F.concat_ws("|", "number", key_of))).withColumn("first_article", first_article)
    twice = F.count("*").over(Window.partitionBy(key, "name").orderBy("line_no").rowsBetween(1, Window.unboundedFollowing)) > 0
    entry = F.col("name").isNotNull() & (F.col("line_no") < F.col("first_article")) & twice & (F.col("leader") | (F.col("line_no") > F.col("begin")))
    rows = rows.withColumn("entry", F.coalesce(entry, F.lit(False)))
    rows = rows.withColumn("end", F.max(F.when(F.col("entry"), F.col("line_no"))).over(whole))
    inside = F.coalesce(F.col("line_no").between(F.col("begin"), F.col("end")), F.lit(False)) | F.col("entry")
    return rows.filter(~inside).select(*lines.columns)


# What the title of a regulation ends with.
TITLE_END = r"(?:정관|규정|규칙|지침|요령|규약|내규|준칙|기준|세칙|편람|강령|예규|직제|규율)(?:[(（](?:안|개정안)[)）])?$"


def titled_regulations(lines: DataFrame, key: str, ahead: int = 12) -> DataFrame:
    """Classified lines in which an unnumbered title line opens a regulation of a combined book: it ends like a title, is short, no sentence, and
    article 1 follows within `ahead` lines before any other title. boundary says 'explicit' or 'implicit'; a title straight after an attachment
    without article 1 is 'ambiguous' and stays text."""
    order = Window.partitionBy(key).orderBy("line_no")
    name = F.trim("line")
    title = (F.col("node_type") == "text") & (F.length(name) <= 60) & name.rlike(TITLE_END) & ~name.rlike(r"[.!?。,]") & ~name.rlike(PARTICLE)
    near = order.rowsBetween(1, ahead)
    first = F.regexp_replace("number", r"\s+", "").rlike(r"^제1조$") & (F.col("node_type") == "article")
    rows = lines.withColumn("is_title", title).withColumn("at_one", F.min(F.when(first, F.col("line_no"))).over(near)).withColumn("at_other", F.min(F.when(title | (F.col("node_type") == "regulation"), F.col("line_no"))).over(near))
    opens = F.col("is_title") & F.col("at_one").isNotNull() & (F.col("at_other").isNull() | (F.col("at_one") < F.col("at_other")))
    attached = F.last(F.when(F.col("level") <= 5, F.col("node_type")), True).over(order.rowsBetween(Window.unboundedPreceding, -1)).isin("appendix", "form")
    boundary = F.when(F.col("node_type") == "regulation", "explicit").when(opens, "implicit").when(F.col("is_title") & attached, "ambiguous")
    rows = rows.withColumn("boundary", boundary).withColumn("opens", opens)
    changed = {"node_type": F.when(F.col("opens"), "regulation").otherwise(F.col("node_type")), "level": F.when(F.col("opens"), 0).otherwise(F.col("level")), "title": F.when(F.col("opens"), F.trim("line")).otherwise(F.col("title"))}
    return rows.select(*[changed.get(c, F.col(c)).alias(c) for c in lines.columns], "boundary")


def detected(blocks: DataFrame, key: str, text: str, block_type: str, block_index: str) -> DataFrame:
    """The classified lines of parsed blocks after every rule: inline markers, references, contents, title-only regulations, repeated headers, demotions."""
    lines = classified(source_lines(blocks, key, text, block_type, block_index))
    lines = titled_regulations(without_contents(lines, key), key)
    place = F.row_number().over(Window.partitionBy(key, "node_type", "number", F.regexp_replace("title", r"\s+", "")).orderBy("line_no"))
    lines = lines.withColumn("place", place).filter((F.col("node_type") != "regulation") | (F.col("place") == 1)).drop("place")
    return demoted(lines, key)


def nodes_of(lines: DataFrame, key: str) -> DataFrame:
    """One row per node: a heading line with the text lines after it. above: the nodes open above it (node, node_type, number, title), parent the nearest.

    Lines before the first heading are node 0 of type text."""
    order = Window.partitionBy(key).orderBy("line_no")
    rows = lines.withColumn("node", F.sum((F.col("node_type") != "text").cast("int")).over(order))
    nodes = rows.groupBy(key, "node").agg(
        F.min_by(F.struct("node_type", "level", "number", "title", "line_no"), "line_no").alias("head"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"),
    )
    nodes = nodes.select(key, "node", "head.*", "text").withColumnRenamed("line_no", "start_line")
    # The last node of every level so far; it is still open if no smaller level was opened after it.
    seen = Window.partitionBy(key).orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    fact = F.struct("node", "node_type", "number", "title")
    last = [F.when(F.col("level") > rank, F.max(F.when(F.col("level") == rank, fact)).over(seen)) for rank in range(9)]
    nodes = nodes.withColumn("last", F.array(*last))
    before = lambda i: F.coalesce(F.array_max(F.transform(F.slice("last", F.lit(1), i), lambda x: x["node"])), F.lit(-1))
    above = F.filter("last", lambda x, i: F.coalesce(x["node"] > before(i), F.lit(False)))
    return nodes.withColumn("above", above).withColumn("parent", F.get("above", F.size("above") - 1)["node"]).drop("last")


def ancestors(nodes: DataFrame, key: str) -> DataFrame:
    """(key, node, ancestor, distance): every node with all open above it."""
    steps = nodes.select(key, "node", F.size("above").alias("n"), F.posexplode("above").alias("at", "up"))
    return steps.select(key, "node", F.col("up.node").alias("ancestor"), (F.col("n") - F.col("at")).alias("distance"))


def first_headers(lines: DataFrame, key: str, kind: str = "article") -> DataFrame:
    """lines without headings of a kind whose number came before in the document."""
    place = F.row_number().over(Window.partitionBy(key, "node_type", "number").orderBy("line_no"))
    return lines.withColumn("place", place).filter((F.col("node_type") != kind) | (F.col("place") == 1)).drop("place")


def sequence_gaps(nodes: DataFrame, scope: list[str], number: str, order: str) -> DataFrame:
    """Rows whose number leaves a gap to the one before in its scope; scopes of 4 or more with backward steps or repeats are passed over."""
    rows = nodes.withColumn("before", F.lag(number).over(Window.partitionBy(*scope).orderBy(order)))
    back = F.max((F.col(number) < F.col("before")).cast("int"))
    counts = rows.groupBy(*scope, number).agg(F.count("*").alias("n"), back.alias("back"))  # sets of numbers as partial sums
    mixed = counts.groupBy(*scope).agg(((F.sum("n") >= 4) & ((F.max("back") > 0) | (F.max("n") > 1))).alias("mixed")).filter("mixed").drop("mixed")
    return rows.filter(F.col(number) > F.col("before") + 1).join(mixed, scope, "left_anti")


def merged_metadata(lines: DataFrame, key: str) -> DataFrame:
    """(key, node, …): what the lines of a node (their `node`) say of its source: pages, captions, and sums of the counts the reader gave them."""
    kinds = dict(lines.dtypes)
    counts = [c for c in kinds if c.endswith("_count")]
    lists = [c for c, k in kinds.items() if k.startswith("array") and c.startswith("source_")]
    return lines.groupBy(key, "node").agg(
        *([F.min("page_no").alias("page_start"), F.max("page_no").alias("page_end"), F.array_sort(F.collect_set("page_no")).alias("source_pages")] if "page_no" in kinds else []),
        F.count_if(F.col("line").rlike(CAPTION) & ~F.col("line").startswith("|")).alias("caption_count"),
        *[F.sum(c).alias(c) for c in counts],
        *[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in lists],
    )


def char_windows(text: str, most: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of at most `most` characters that end at white space where there is some in their second half."""
    spans, at = [], 0
    while at < len(text):
        end = min(len(text), at + most)
        if end < len(text):
            cut = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
            if cut - at > most // 2:
                end = cut
        spans.append((at, end))
        if end >= len(text):
            break
        at = max(end - overlap, at + 1)
    return spans


def chunks_of(docs: DataFrame, key: str, text: str, most: int = 1800, overlap: int = 120) -> DataFrame:
    """(key, part from 0, begin, end, chunk_text): a text within `most` is one chunk, a longer one is cut into windows."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, n, a, b, t[a:b]) for k, t in zip(pdf[key], pdf[text], strict=True) for n, (a, b) in enumerate(char_windows(t or "", most, overlap))]
            yield pd.DataFrame(rows, columns=[key, "part", "begin", "end", "chunk_text"])

    return docs.select(key, text).mapInPandas(run, f"{key} {kind}, part int, begin int, end int, chunk_text string")


def chunk_id(document: Column, kind: Column, number: Column, order: Column, page: Column, part: Column) -> Column:
    clean = lambda c: F.regexp_replace(F.coalesce(c.cast("string"), F.lit("none")), r"[^0-9A-Za-z가-힣_-]+", "_")
    return F.format_string("%s_%s_%s_%04d_p%d_%03d", document.cast("string"), clean(kind), clean(number), order.cast("int"), page.cast("int"), part.cast("int"))


def cells_of(line: Column) -> Column:
    """Cells of a table row: between pipes, else between runs of two blanks or more."""
    piped = F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    spaced = F.transform(F.split(F.trim(line), r"\s{2,}"), lambda x: F.trim(x))
    return F.when(line.contains("|"), piped).otherwise(spaced)


def table_score(lines: Column) -> Column:
    """Table likelihood of an array of lines: numeric, delimited, structured and short-label rows, each up to a limit."""
    n = lambda test: F.size(F.filter(lines, test))
    return F.least(
        F.lit(1.0),
        0.12 * F.least(n(lambda x: x.rlike(r"\d[\d,.]*\s*(?:%|원|명|점|일|년)?\s*$")), F.lit(4))
        + 0.12 * F.least(n(lambda x: x.contains("|") | x.contains("\t")), F.lit(4))
        + 0.08 * F.least(n(lambda x: x.rlike(r"\S\s{2,}\S")), F.lit(4))
        + 0.04 * F.least(n(lambda x: (F.length(F.trim(x)) <= 12) & (F.trim(x) != "")), F.lit(5)),
    )


def unique_headers(header: Column) -> Column:
    """Header names; the k-th repeat of a name gets ' (k)'."""
    return F.transform(
        header,
        lambda x, i: F.concat(x, F.when(F.size(F.filter(F.slice(header, F.lit(1), i), lambda y: y == x)) > 0, F.concat(F.lit(" ("), (F.size(F.filter(F.slice(header, F.lit(1), i), lambda y: y == x)) + 1).cast("string"), F.lit(")"))).otherwise("")),
    )


def markdown_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda x: F.replace(x, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
