"""Chunks of a document's structure: which nodes become chunks, their texts, parts, paths, counts and references.

Nodes come from structure.nodes_of: key, node, node_type, level, number, title, text, parent; nodes are numbered in document order.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate, groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statuta.functions.text import context_header, match_key, retrieval_text
from statuta.operators.structure import char_windows

# Longest chunk, overlap of windows; kinds that are chunks of their own; kinds that take their descendants in; marks to cut long ones at.
MOST, OVERLAP = 1800, 120
OWN = ("article", "appendix", "form", "supplementary", "table")
GATHERING = ("article", "appendix", "form", "paragraph", "item", "subitem")
SMALL = ("paragraph", "item", "subitem")
CUTS = tuple(re.compile(p, re.M) for p in (r"(?=^[①-⑳㉑-㉚])", r"(?=^\(\d+\))", r"(?=^\d+\.\s+)", r"(?=^[가-힣][.)])"))
SENTENCES = re.compile(r"(?<=[.!?。])\s+")
RANKS = {"regulation": 0, "article": 1, "paragraph": 2, "item": 3, "appendix": 4}


def hard_windows(text: str, most: int, overlap: int) -> list[str]:
    return [w for a, b in char_windows(text, most, overlap) if (w := text[a:b].strip())]


def packed(sentences: list[str], most: int, overlap: int) -> list[str]:
    """Windows of whole sentences. With the running length of all sentences, where a window ends is looked up instead of tried sentence by sentence; each
    window leads with the last `overlap` characters of the one before and holds one sentence at least."""
    reach = list(accumulate(len(s) + 1 for s in sentences))
    windows, start = [], 0
    while start < len(sentences):
        lead = windows[-1][-overlap:].strip() if windows and overlap else ""
        room = most - len(lead) - bool(lead) + 1
        stop = max(start + 1, bisect_right(reach, room + (reach[start - 1] if start else 0)))
        windows.append(" ".join(filter(None, [lead, *sentences[start:stop]])))
        start = stop
    return windows


def sentence_windows(text: str, most: int, overlap: int) -> list[str]:
    """Sentences put together up to `most` characters with `overlap` characters of the window before; a sentence that is longer is cut hard, by itself."""
    sentences = filter(None, map(str.strip, SENTENCES.split(text)))
    windows = []
    for long, stretch in groupby(sentences, lambda s: len(s) > most):
        windows += [w for s in stretch for w in hard_windows(s, most, overlap)] if long else packed(list(stretch), most, overlap)
    return windows


def parts_of(text: str, most: int = MOST, overlap: int = OVERLAP) -> list[str]:
    """A text within `most` characters is one part; a longer one is cut at the first kind of mark whose parts all fit, else in sentence windows."""
    text = text.strip()
    if len(text) <= most:
        return [text]
    for cut in CUTS:
        parts = [p for x in cut.split(text) if (p := x.strip())]
        if len(parts) > 1 and max(map(len, parts)) <= most:
            return parts
    return sentence_windows(text, most, overlap)


def split_parts(text: Column, overlap: Column, most: int = MOST) -> Column:
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(texts: pd.Series, overlaps: pd.Series) -> pd.Series:
        return pd.Series([parts_of(t or "", most, int(o)) for t, o in zip(texts, overlaps, strict=True)])

    return split(text, overlap)


def label(number: Column, title: Column) -> Column:
    return F.trim(F.concat_ws(" ", F.nullif(number, F.lit("")), F.nullif(title, F.lit(""))))


def is_root(kind: Column, parent_kind: Column, body: Column) -> Column:
    """Nodes that become chunks: articles, attachments, supplements and tables; small units without an article above; containers with text of their own."""
    small = kind.isin(*SMALL) & (parent_kind.isNull() | (parent_kind == "supplementary"))
    return kind.isin(*OWN) | small | (kind.isin("regulation", "part", "chapter", "section", "subsection") & body)


def chunk_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.filter(is_root(F.col("node_type"), F.get("above", F.size("above") - 1)["node_type"], F.col("text").contains("\n")))


def preceding_regulations(nodes: DataFrame, key: str) -> DataFrame:
    """nodes with the number and title of the nearest regulation at or before each."""
    order = Window.partitionBy(key).orderBy("node").rowsBetween(Window.unboundedPreceding, 0)
    held = F.last(F.when(F.col("node_type") == "regulation", F.struct("number", "title", "node")), True).over(order)
    return nodes.withColumn("held", held).select(*nodes.columns, F.col("held.number").alias("regulation_no"), F.col("held.title").alias("regulation_title"), F.col("held.node").alias("regulation_node"))


def build_chunks(nodes: DataFrame, documents: DataFrame, key: str, name: str, most: int = MOST, overlap: int = OVERLAP) -> DataFrame:
    """One row per chunk part: chunk_id, key, chunk_type, number, title, text, retrieval_text, regulation and article of it, hierarchy_path (from the document
    on), canonical_path (from the regulation on), source_nodes, part, part_count, order_index. documents: key, name and, for those without structure,
    raw_text, which becomes chunks of type document."""
    # every node goes to the chunks above it that gather, and to its own; nodes of a document are already together, so nothing is shuffled again
    gathers = F.filter("above", lambda x, i: x["node_type"].isin(*GATHERING) & is_root(x["node_type"], F.get("above", i - 1)["node_type"], F.lit(False)))
    own = is_root(F.col("node_type"), F.get("above", F.size("above") - 1)["node_type"], F.col("text").contains("\n"))
    fact = F.struct("node", "node_type", "number", "title")
    homes = F.concat(F.transform(gathers, lambda x: x["node"]), F.when(own, F.array("node")).otherwise(F.array().cast("array<bigint>")))
    spread = preceding_regulations(nodes, key).withColumn("way", F.concat("above", F.array(fact))).withColumn("root", F.explode(homes))
    head = F.when(F.col("node") == F.col("root"), F.struct("node_type", "number", "title", "way", "regulation_no", "regulation_title", "regulation_node"))
    rows = spread.groupBy(key, F.col("root").alias("node")).agg(F.array_sort(F.collect_list(F.struct("node", "text"))).alias("held"), F.first(head, True).alias("head"))
    rows = rows.select(
        key, "node", "head.*", F.transform("held", lambda x: x["node"]).alias("source_nodes"), F.array_join(F.transform("held", lambda x: x["text"]), "\n").alias("body")
    ).join(documents.select(key, F.col(name).alias("document_name")), key)
    way = F.col("way")
    of = lambda kind, field: F.get(F.transform(F.filter(way, lambda x: x["node_type"] == kind), lambda x: x[field]), F.lit(0))
    rows = rows.withColumn("article_no", of("article", "number")).withColumn("article_title", of("article", "title")).withColumn("inferred", of("regulation", "node").isNull() & F.col("regulation_node").isNotNull())
    names = F.filter(F.transform(way, lambda x: label(x["number"], x["title"])), lambda x: x != "")
    below = F.filter(F.transform(F.filter(way, lambda x: x["node_type"] != "regulation"), lambda x: label(x["number"], x["title"])), lambda x: x != "")
    root_label = F.coalesce(F.nullif(F.col("regulation_title"), F.lit("")), F.nullif(F.col("regulation_no"), F.lit("")), F.col("document_name"))
    path = F.array_join(F.concat(F.array("document_name"), names), " > ")
    canonical = F.array_join(F.concat(F.array(root_label), below), " > ")
    no_overlap = F.col("node_type").isin("paragraph", "part", "chapter", "section", "subsection", "regulation")
    rows = rows.withColumn("hierarchy_path", path).withColumn("canonical_path", canonical).withColumn("parts", split_parts(F.col("body"), F.when(no_overlap, 0).otherwise(overlap), most))
    parts = rows.select("*", F.size("parts").alias("part_count"), F.posexplode("parts").alias("at", "part_text"))
    number = F.regexp_replace(F.regexp_replace(F.coalesce(F.nullif("number", F.lit("")), F.col("node_type")), r"[^0-9A-Za-z_가-힣]+", "_"), "^_+|_+$", "")
    out = parts.select(
        F.format_string("%s_%s_%s_%04d_p0_%03d", F.col(key).cast("string"), "node_type", number, (F.col("node") + 1).cast("int"), F.col("at") + 1).alias("chunk_id"),
        key, F.col("node_type").alias("chunk_type"), "number", "title", F.col("part_text").alias("text"),
        retrieval_text(root_label, F.col("canonical_path"), F.col("part_text")).alias("retrieval_text"),
        "regulation_no", "regulation_title", "inferred", "article_no", "article_title", "hierarchy_path", "canonical_path", "source_nodes",
        (F.col("at") + 1).alias("part"), "part_count", F.col("node").cast("long").alias("order_index"),
    )
    if "raw_text" not in documents.columns:
        return out
    bare = documents.join(out.select(key).distinct(), key, "left_anti").filter(F.trim(F.coalesce("raw_text", F.lit(""))) != "")
    bare = bare.select(key, F.col(name).alias("document_name"), split_parts(F.col("raw_text"), F.lit(overlap), most).alias("parts"))
    bare = bare.select("*", F.size("parts").alias("part_count"), F.posexplode("parts").alias("at", "part_text"))
    none = lambda kind: F.lit(None).cast(kind)
    return out.unionByName(
        bare.select(
            F.format_string("%s_document_fallback_%03d", F.col(key).cast("string"), F.col("at") + 1).alias("chunk_id"), key, F.lit("document").alias("chunk_type"), F.lit("document").alias("number"),
            F.col("document_name").alias("title"), F.col("part_text").alias("text"), retrieval_text(F.col("document_name"), F.col("document_name"), F.col("part_text")).alias("retrieval_text"),
            none("string").alias("regulation_no"), F.col("document_name").alias("regulation_title"), F.lit(True).alias("inferred"), none("string").alias("article_no"), none("string").alias("article_title"),
            F.col("document_name").alias("hierarchy_path"), F.col("document_name").alias("canonical_path"), F.array().cast("array<bigint>").alias("source_nodes"), (F.col("at") + 1).alias("part"), "part_count", F.lit(0).cast("long").alias("order_index"),
        )
    )


def with_context(path: Column, text: Column) -> Column:
    """A chunk's text below its place."""
    return F.concat(F.lit("[위치] "), path, F.lit("\n[본문]\n"), F.trim(text))


def child_units(nodes: DataFrame, key: str, sample: int = 20) -> DataFrame:
    """(key, node, n_paragraphs, n_items, n_subitems, units): small units below each article that stand in no attachment, the first `sample` of them listed."""
    small = nodes.filter(F.col("node_type").isin(*SMALL))
    small = small.filter(~F.exists("above", lambda x: x["node_type"].isin("appendix", "form", "supplementary", "table")))
    below = small.withColumn("article", F.explode(F.transform(F.filter("above", lambda x: x["node_type"] == "article"), lambda x: x["node"])))
    n = lambda kind: F.count_if(F.col("node_type") == kind)
    return below.groupBy(key, F.col("article").alias("node")).agg(
        n("paragraph").alias("n_paragraphs"), n("item").alias("n_items"), n("subitem").alias("n_subitems"),
        F.slice(F.array_sort(F.collect_list(F.struct(F.col("node"), "node_type", "number"))), 1, sample).alias("units"),
    )


def reference_edges(chunks: DataFrame, document: str, regulation_refs: str, article_refs: str) -> DataFrame:
    """(chunk_id, kind, reference, target): what each chunk refers to within its document. A regulation is looked up by number, then title; an article within
    the chunk's own regulation. Of several chunks the best kind, then the first page, is the target; a chunk is no target of its own articles."""
    kind = F.create_map(*[F.lit(x) for pair in RANKS.items() for x in pair])
    rank = F.struct(F.coalesce(F.try_element_at(kind, F.col("chunk_type")), F.lit(9)).alias("kind"), F.coalesce("source_page_start", F.lit(999999)).alias("page"), F.col("chunk_id"))
    own = F.coalesce(F.nullif(match_key(F.col("regulation_no")), F.lit("")), F.nullif(match_key(F.col("regulation_title")), F.lit("")))
    rows = chunks.withColumn("rank", rank).withColumn("own", own)
    keys = F.array_compact(F.array(F.nullif(match_key(F.col("regulation_no")), F.lit("")), F.nullif(match_key(F.col("regulation_title")), F.lit(""))))
    regulations = rows.select(document, F.explode(keys).alias("wanted"), "rank").groupBy(document, "wanted").agg(F.min("rank").alias("best"))
    articles = rows.filter("own is not null and article_no is not null").groupBy(document, "own", match_key(F.col("article_no")).alias("wanted")).agg(F.min("rank").alias("best"))
    asked = rows.select(document, "chunk_id", "own", F.explode(regulation_refs).alias("reference")).withColumn("wanted", match_key(F.col("reference")))
    found = asked.join(regulations, [document, "wanted"], "left").select("chunk_id", F.lit("regulation").alias("kind"), "reference", F.col("best.chunk_id").alias("target"))
    asked = rows.select(document, "chunk_id", "own", F.explode(article_refs).alias("reference")).withColumn("wanted", match_key(F.col("reference")))
    own_found = asked.join(articles, [document, "own", "wanted"], "left").select("chunk_id", F.lit("article").alias("kind"), "reference", F.nullif(F.col("best.chunk_id"), F.col("chunk_id")).alias("target"))
    return found.unionByName(own_found)


__all__ = ["build_chunks", "child_units", "chunk_nodes", "context_header", "parts_of", "preceding_regulations", "reference_edges", "split_parts", "with_context"]
