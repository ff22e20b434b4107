"""Relation edges of chunks: cited articles, regulations and laws with contexts carried forward, articles defined in passing, tables, terms.

chunks: document_id, chunk_id, chunk_order, regulation, article_no, article_title, chunk_type, page_start, page_end, text, article_refs, regulation_refs, law_refs (arrays of strings; null
is empty). Edges: edge_id, relation_type, source_id, source_label, target_id, target_label, document_id, chunk_id, page_start, page_end, weight, confidence, evidence_type,
evidence_text. All of it is joins and windows on short strings; the windows over a document carry no texts. Equal edges are one, that of the greatest confidence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statuta.operators.graph import cooccurrence, first_of_each, top_terms
from statuta.session import shared_folder, written

# Forms of articles and names, words for the law named before, names that say no law, confidences, and the pages that a context lasts.
ARTICLE = r"제\s*\d+\s*조(?:\s*의\s*\d+)?(?:\s*제\s*\d+\s*항)?(?:\s*제\s*\d+\s*호)?"
LAW = r"[가-힣A-Za-z0-9·ㆍ]{1,40}(?:법률|법)(?:\s*(?:시행령|시행규칙))?|[가-힣A-Za-z0-9·ㆍ]{1,40}(?:시행령|시행규칙)"
TOKEN = rf"[「｢『“\"]([^」｣』”\"\n]{{2,80}})[」｣』”\"]\s*({ARTICLE})?|({LAW})\s*({ARTICLE})|({ARTICLE})"
HEADING = r"제\s*\d+\s*조(?:\s*의\s*\d+)?(?=\s*[\(（][^\)）\n]{1,80}[\)）]|\s*<\s*삭제[^>\n]{0,80}>|\s*삭제\s*<[^>\n]{0,80}>)"
OWN_KINDS = r"(?:규정|지침|내규|정관|세칙|요령|기준|편람|규칙|예규)$"
SAME_LAW = ("동법", "동시행령", "동시행규칙", "동법시행령", "동법시행규칙")
GENERIC = ("법", "법률", "법시행령", "법시행규칙", "시행령", "시행규칙", "방법")
CONTEXT = {"local": 0.78, "carried": 0.72, "lookahead": 0.68}
NAMED, LAW_CONTEXT, FOUND, NOT_FOUND, CITED, REROUTED, DEFINED, SHARED = 0.9, 0.78, 0.85, 0.6, 0.8, 0.72, 0.82, 0.5
PAGE_GAP, LOOK_AHEAD = 3, 3
BASE = ["document_id", "chunk_id", "chunk_order", "page_start", "page_end", "regulation", "article_no", "chunk_type", "source_id", "source_label"]


def key(value: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(value, F.lit("")), r"[^0-9A-Za-z가-힣]+", ""))


def compact(value: Column) -> Column:
    return F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", "")


def base(article: Column) -> Column:
    return F.nullif(F.regexp_extract(compact(article), r"^(제\d+조(?:의\d+)?)", 1), F.lit(""))


def spoken(*parts: Column | str) -> Column:
    """Parts that are neither null nor empty, joined by blanks."""
    return F.concat_ws(" ", *[F.nullif(F.col(p) if isinstance(p, str) else p, F.lit("")) for p in parts])


def joined(*parts: Column) -> Column:
    return F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def sourced(chunks: DataFrame) -> DataFrame:
    """chunks with the node that their edges start from: an article, a place in a regulation, or the chunk itself."""
    has = F.coalesce(F.col("article_no"), F.lit("")) != ""
    regulation = F.coalesce("regulation", F.lit("")) != ""
    node = F.when(has, joined(F.lit("article"), F.col("document_id"), key(F.col("regulation")), key(F.col("article_no")))).when(regulation, joined(F.lit("regulation_context"), F.col("document_id"), key(F.col("regulation")), F.col("chunk_id")))
    label = F.when(has, spoken("regulation", "article_no", "article_title")).when(regulation, F.col("regulation")).otherwise(F.col("chunk_id").cast("string"))
    return chunks.withColumns({"source_id": F.coalesce(node, joined(F.lit("chunk"), F.col("chunk_id"))), "source_label": label})


def made(rows: DataFrame, relation: Column, target: Column, label: Column, kind: str, text: Column, confidence: Column | float, source: Column | None = None, source_label: Column | None = None, weight: Column | int = 1) -> DataFrame:
    """Edges of rows that have the columns BASE."""
    column = lambda c: c if isinstance(c, Column) else F.lit(c)
    edges = rows.select(
        relation.alias("relation_type"), (F.col("source_id") if source is None else source).alias("source_id"), (F.col("source_label") if source_label is None else source_label).alias("source_label"), target.alias("target_id"), label.alias("target_label"),
        "document_id", "chunk_id", "page_start", "page_end", column(weight).cast("long").alias("weight"), F.round(column(confidence).cast("double"), 3).alias("confidence"), F.lit(kind).alias("evidence_type"), text.alias("evidence_text"),
    )
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("relation_type", "source_id", "target_id", "chunk_id", "evidence_type", "evidence_text")]
    return edges.select(F.concat(F.lit("edge_"), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16)).alias("edge_id"), "*")


def citing(what: str) -> Column:
    return F.concat(F.when(F.coalesce("article_no", F.lit("")) != "", "article").otherwise("chunk"), F.lit(f"_cites_{what}"))


def mentions(chunks: DataFrame) -> DataFrame:
    """(BASE, n, token, quoted, said, name, article, external, by_alias): names and articles in the order of the text. A name is a law's if it is listed or formed as one, or nothing
    else; '동법' and its like take the law named last before them."""
    tokens = chunks.select(*BASE, "law_refs", "regulation_refs", F.posexplode(F.regexp_extract_all("text", F.lit(TOKEN), 0)).alias("n", "token"))
    group = lambda k: F.nullif(F.trim(F.regexp_replace(F.regexp_extract("token", TOKEN, k), r"\s+", " ")), F.lit(""))
    tokens = tokens.withColumns({"quoted": group(1).isNotNull(), "said": F.coalesce(group(1), group(3)), "article": F.nullif(compact(F.coalesce(group(2), group(4), group(5))), F.lit(""))})
    among = lambda c: F.exists(F.coalesce(c, F.array().cast("array<string>")), lambda x: key(x) == key(F.col("said")))
    alias = key(F.col("said")).isin(*SAME_LAW)
    law = (F.col("said").rlike(f"^(?:.*\\s)?(?:{LAW})$") | among("law_refs")) & ~key(F.col("said")).isin(*GENERIC)
    tokens = tokens.withColumns({"alias": F.coalesce(alias, F.lit(False)), "law": F.coalesce(law & ~alias, F.lit(False)), "own": F.coalesce(among("regulation_refs") | F.col("said").rlike(OWN_KINDS), F.lit(False))})
    before = Window.partitionBy("chunk_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    root = F.regexp_replace(F.last(F.when(F.col("law"), F.col("said")), ignorenulls=True).over(before), r"\s*(?:시행령|시행규칙)$", "")
    tokens = tokens.withColumn("root", root)
    tail = F.when(key(F.col("said")).endswith("시행령"), " 시행령").when(key(F.col("said")).endswith("시행규칙"), " 시행규칙").otherwise("")
    by_alias = F.col("alias") & F.col("root").isNotNull()
    return tokens.select(*BASE, "n", "token", "quoted", "said", F.when(by_alias, F.concat("root", tail)).otherwise(F.col("said")).alias("name"), "article", (F.col("alias") | F.col("law") | ~F.col("own")).alias("external"), "law", by_alias.alias("by_alias"))


def named_articles(found: DataFrame) -> DataFrame:
    """Edges of quoted names with an article."""
    rows = found.filter("quoted and article is not null")
    target = F.concat(F.when(F.col("external"), "law_article:").otherwise("regulation_article:"), joined(key(F.col("name")), key(F.col("article"))))
    relation = F.when(F.col("external"), citing("law_article")).otherwise(citing("regulation_article"))
    return made(rows, relation, target, spoken("name", "article"), "named_article_ref", F.col("token"), NAMED)


def defined_articles(chunks: DataFrame) -> DataFrame:
    """(BASE, article) of headings inside chunks that are no articles: at the beginning, one of several, or after the end of a line or sentence."""
    rows = chunks.filter("coalesce(article_no, '') = '' and coalesce(chunk_type, '') != 'article'").select(*BASE, "text", F.regexp_extract_all("text", F.lit(f"({HEADING})"), 1).alias("heads"))
    alone = F.col("text").rlike(rf"^[\s\S]{{0,10}}{HEADING}") | F.col("text").rlike(rf"(?:\n[^\n]{{0,7}}|[.。;；>〉]\s{{0,7}}){HEADING}")
    return rows.filter((F.size("heads") >= 2) | ((F.size("heads") == 1) & alone)).select(*BASE, F.explode(F.array_distinct(F.transform("heads", compact))).alias("article"))


def law_contexts(found: DataFrame) -> DataFrame:
    """(chunk_id, article, law): articles said with a law's name and, in forms and appendices, those after a listed one with no regulation named between."""
    before = Window.partitionBy("chunk_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("quoted"), F.struct("name", "law", "article")), ignorenulls=True).over(before)
    near = found.withColumn("near", last)
    direct = near.filter("not quoted and said is not null and law").select("chunk_id", "article", F.col("name").alias("law"), F.lit(0).alias("rank"), (-F.col("n")).alias("n"))
    loose = near.filter("said is null and coalesce(article_no, '') = '' and chunk_type in ('form', 'appendix') and near.law and near.article is not null").select("chunk_id", "article", F.col("near.name").alias("law"), F.lit(1).alias("rank"), "n")
    return direct.unionByName(loose).groupBy("chunk_id", "article").agg(F.min_by("law", F.struct("rank", "n")).alias("law"))


def regulation_contexts(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """(chunk_id, context, scope): the one regulation that a chunk names with articles; else the last one of its own regulation's chunks before, unless too many pages back; else, for a chunk
    that cites articles, the next one within three chunks that begins on no later page."""
    own = found.filter("quoted and article is not null and not external").groupBy("chunk_id").agg(F.count_distinct(key(F.col("name"))).alias("k"), F.min_by("name", "n").alias("local")).filter("k = 1").drop("k")
    rows = chunks.select("document_id", "chunk_id", "chunk_order", key(F.col("regulation")).alias("rkey"), "page_start", "page_end", (F.size(F.coalesce("article_refs", F.array().cast("array<string>"))) > 0).alias("cites")).join(own, "chunk_id", "left")
    back = Window.partitionBy("document_id", "rkey").orderBy("chunk_order", "chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    on = Window.partitionBy("document_id").orderBy("chunk_order", "chunk_id")
    carried = F.last(F.when(F.col("local").isNotNull(), F.struct("local", F.coalesce("page_end", "page_start").alias("page"))), ignorenulls=True).over(back)
    ahead = [F.lead(F.struct("rkey", "local", "page_start"), k).over(on) for k in range(1, LOOK_AHEAD + 1)]
    rows = rows.withColumns({"back": carried, **{f"ahead{k}": a for k, a in enumerate(ahead, 1)}})
    seen, stop, same = F.lit(None).cast("string"), F.lit(False), F.lit(True)
    for k in range(1, LOOK_AHEAD + 1):
        a = F.col(f"ahead{k}")
        same = same & F.coalesce(a["rkey"] == F.col("rkey"), F.lit(False))
        here = same & a["local"].isNotNull() & ~stop
        late = F.coalesce(a["page_start"] > F.col("page_start"), F.lit(False))
        seen, stop = F.when(seen.isNull() & here & ~late, a["local"]).otherwise(seen), stop | here
    near = F.when(F.coalesce(F.col("page_start") - F.col("back.page"), F.lit(0)) <= PAGE_GAP, F.col("back.local"))
    rows = rows.withColumns({"near": near, "seen": F.when(F.col("cites"), seen)})
    scope = F.when(F.col("local").isNotNull(), "local").when(F.col("near").isNotNull(), "carried").otherwise("lookahead")
    return rows.select("chunk_id", F.coalesce("local", "near", "seen").alias("context"), scope.alias("scope")).filter("context is not null")


def cited_articles(chunks: DataFrame, found: DataFrame, defined: DataFrame) -> DataFrame:
    """Edges of `article_refs` that neither stand with a quoted name nor are defined in the chunk: to a law's article by context, to one of the own regulation that is there, to the context's
    regulation, or to one that is not there."""
    refs = chunks.select(*BASE, F.explode("article_refs").alias("value")).withColumn("value", F.trim("value")).filter("value != ''").withColumn("article", compact(F.col("value"))).dropDuplicates(["chunk_id", "value"])
    taken = found.filter("quoted and article is not null").select("chunk_id", "article").union(defined.select("chunk_id", "article")).distinct()
    index = chunks.filter("coalesce(article_no, '') != ''").select("document_id", key(F.col("regulation")).alias("rkey"), key(base(F.col("article_no"))).alias("bkey"), "article_no", "article_title", "chunk_order", "chunk_id").filter("bkey != ''")
    index = index.groupBy("document_id", "rkey", "bkey").agg(F.min(F.struct(F.length("article_no").alias("l"), "chunk_order", "chunk_id", F.col("article_no").alias("there"), F.col("article_title").alias("title"))).alias("t"))
    rows = refs.join(taken, ["chunk_id", "article"], "left_anti").join(law_contexts(found), ["chunk_id", "article"], "left").join(regulation_contexts(chunks, found), "chunk_id", "left")
    rows = rows.withColumns({"rkey": key(F.col("regulation")), "bkey": key(base(F.col("article")))}).join(index, ["document_id", "rkey", "bkey"], "left")
    law, there = F.col("law").isNotNull(), F.col("t").isNotNull()
    elsewhere = F.col("context").isNotNull() & (key(F.col("context")) != F.col("rkey"))
    own = F.coalesce(base(F.col("article_no")) == base(F.coalesce("t.there", "article")), F.lit(False))
    inner = F.when(own, "article_cites_own_article_clause").when(there & (base(F.col("article")) != F.col("article")), "article_cites_article_clause").otherwise("article_cites_article")
    place = F.coalesce("t.there", "value")
    local = joined(F.lit("article"), F.col("document_id"), F.col("rkey"), key(place))
    confidence = reduce(lambda c, s: c.when(F.col("scope") == s[0], s[1]), CONTEXT.items(), F.when(F.lit(False), 0.0))
    by_law = made(rows.filter(law), citing("law_article"), joined(F.lit("law_article"), key(F.col("law")), key(F.col("article"))), spoken("law", "article"), "contextual_law_article_ref", F.col("value"), LAW_CONTEXT)
    by_rule = made(rows.filter(~law & ~there & elsewhere), citing("regulation_article"), joined(F.lit("regulation_article"), key(F.col("context")), key(F.col("article"))), spoken("context", "article"), "contextual_article_ref", F.col("value"), confidence)
    plain = made(rows.filter(~law & (there | ~elsewhere)), inner, local, spoken("regulation", place, F.col("t.title")), "article_ref", F.col("value"), F.when(there, FOUND).otherwise(NOT_FOUND))
    return by_law.unionByName(by_rule).unionByName(plain)


def cited_names(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """Edges of `regulation_refs` and `law_refs`; a word for the law named before leads to that law, generic names lead nowhere."""
    known = found.filter("by_alias").groupBy("chunk_id", key(F.col("said")).alias("nkey")).agg(F.min_by("name", "n").alias("law"))

    def each(refs: str) -> DataFrame:
        rows = chunks.select(*BASE, F.explode(refs).alias("value")).withColumn("value", F.trim(F.regexp_replace("value", r"\s+", " "))).withColumn("nkey", key(F.col("value"))).filter("nkey != ''").dropDuplicates(["chunk_id", "value"])
        return rows.join(known, ["chunk_id", "nkey"], "left")

    own, laws = each("regulation_refs"), each("law_refs")
    alias = F.col("nkey").isin(*SAME_LAW)
    lawful = alias | F.col("value").rlike(f"^(?:.*\\s)?(?:{LAW})$")
    name = F.coalesce("law", "value")
    to_law = joined(F.lit("law"), key(name))
    return reduce(DataFrame.unionByName, [
        made(own.filter(~lawful), citing("regulation"), joined(F.lit("regulation"), F.col("nkey")), F.col("value"), "internal_regulation_ref", F.col("value"), CITED),
        made(own.filter(lawful), citing("law"), to_law, name, "internal_regulation_ref", F.col("value"), REROUTED),
        made(laws.filter(~key(name).isin(*GENERIC, *SAME_LAW)), citing("law"), to_law, name, "external_law_ref", name, CITED),
    ])


def table_edges(chunks: DataFrame, tables: DataFrame) -> DataFrame:
    """Edges of tables to columns, rows, cells, fields and values. tables: chunk_id, table_id, label, table_confidence, header (array), rows (array of (row_index, cells)), raw_rows (array, used
    where there are no rows)."""
    rows = chunks.select(*BASE).join(tables, "chunk_id")
    place, conf = key(F.col("table_id").cast("string")), F.coalesce("table_confidence", F.lit(0.0))
    node, label = joined(F.lit("table"), F.col("table_id")), F.coalesce("label", F.col("table_id").cast("string"))
    field, value = lambda h: joined(F.lit("table_field"), place, key(h)), lambda v: joined(F.lit("table_value"), key(v))
    heads = rows.select("*", F.explode("header").alias("head")).withColumn("head", F.trim("head")).filter("head != ''")
    lines = rows.select("*", F.explode("rows").alias("r")).withColumn("said", F.array_join(F.col("r.cells"), " | "))
    row = joined(F.lit("table_row"), place, F.col("r.row_index"))
    cells = lines.select("*", F.posexplode("r.cells").alias("at", "cell")).withColumns({"cell": F.trim("cell"), "head": F.trim(F.get("header", F.col("at")))}).filter("cell != ''")
    fields = cells.filter("head != ''").withColumn("fact", F.concat_ws(": ", "head", "cell"))
    raw = rows.filter("coalesce(size(rows), 0) <= 0").select("*", F.posexplode("raw_rows").alias("at", "line")).withColumn("line", F.trim("line")).filter("line != ''")
    cell = joined(F.lit("table_cell"), place, F.col("r.row_index"), F.col("at"))
    head, said = F.col("head"), F.col("said")
    return reduce(DataFrame.unionByName, [
        made(rows, F.lit("chunk_has_table"), node, label, "table", label, conf),
        made(heads, F.lit("table_has_column"), field(head), head, "table_header", head, conf, node, label),
        made(lines, F.lit("table_has_row"), row, said, "table_row", said, conf, node, label),
        made(cells, F.lit("table_row_has_cell"), cell, F.col("cell"), "table_cell", F.col("cell"), conf, row, said),
        made(fields, F.lit("table_row_has_field"), field(head), head, "table_field", F.col("fact"), conf, row, said),
        made(fields, F.lit("table_row_has_value"), value(F.col("cell")), F.col("cell"), "table_value", F.col("fact"), conf, row, said),
        made(fields, F.lit("table_field_has_value"), value(F.col("cell")), F.col("cell"), "table_field_value", F.col("fact"), conf, field(head), head),
        made(raw, F.lit("table_has_raw_row"), joined(F.lit("table_row"), place, F.col("at")), F.col("line"), "raw_table_row", F.col("line"), conf, node, label),
    ])


def term_edges(terms: DataFrame) -> DataFrame:
    """Edges between terms of one chunk, the twelve heaviest of each. terms: chunk_id, term, weight."""
    pairs = cooccurrence(top_terms(terms, "chunk_id", "term", "weight"), "chunk_id", "term")
    blank = [F.lit(None).cast(t).alias(n) for n, t in (("document_id", "string"), ("chunk_id", "string"), ("page_start", "int"), ("page_end", "int"))]
    rows = pairs.select("a", "b", "weight", *blank)
    return made(rows, F.lit("term_cooccurs_with_term"), joined(F.lit("term"), key(F.col("b"))), F.col("b"), "term_cooccurrence", spoken("a", "b"), SHARED, joined(F.lit("term"), key(F.col("a"))), F.col("a"), F.col("weight"))


def relation_edges(chunks: DataFrame, tables: DataFrame | None = None, terms: DataFrame | None = None) -> DataFrame:
    """All families in one table; chunk and document ids become strings. What is read from the texts is written once, as short rows, to the shared folder."""
    rows = sourced(chunks.withColumns({c: F.col(c).cast("string") for c in ("document_id", "chunk_id")}).withColumns({c: F.col(c).cast("int") for c in ("page_start", "page_end")}))
    folder = shared_folder(chunks.sparkSession)
    found, defined = written(mentions(rows), folder, "mentions"), written(defined_articles(rows), folder, "defined")
    rows = rows.drop("text")
    inner = joined(F.lit("article"), F.col("document_id"), key(F.col("regulation")), key(F.col("article")))
    families = [
        named_articles(found), cited_articles(rows, found, defined), cited_names(rows, found),
        made(defined, F.lit("chunk_defines_inline_article"), inner, spoken("regulation", "article"), "inline_article_heading", F.col("article"), DEFINED),
    ]
    if tables is not None:
        families.append(table_edges(rows, tables.withColumn("chunk_id", F.col("chunk_id").cast("string"))))
    if terms is not None:
        families.append(term_edges(terms))
    return first_of_each(families, "edge_id", F.desc("confidence"))
