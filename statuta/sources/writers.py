"""Export shapes of chunks and vector records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.operators.structure import cells_of, markdown_row


def to_csv_rows(df: DataFrame) -> DataFrame:
    """List and struct columns as JSON, so the frame can be written as CSV."""
    nested = ("array", "struct", "map")
    return df.select(*[F.to_json(c).alias(c) if kind.startswith(nested) else F.col(c) for c, kind in df.dtypes])


def to_markdown(chunks: DataFrame, document: str, order: str, title: str, text: str) -> DataFrame:
    """(document, markdown): the chunks of a document, in order, each with its title."""
    part = F.concat(F.lit("## "), F.coalesce(F.col(title), F.lit("")), F.lit("\n\n"), F.col(text))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), part.alias("t"))))
    return chunks.groupBy(document).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n").alias("markdown"))


def table_rows(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """(key, row_no, cells, markdown) of every line that has cells."""
    lines = chunks.select(key, F.posexplode(F.split(text, "\n")).alias("row_no", "line"))
    rows = lines.withColumn("cells", cells_of(F.col("line"))).filter(F.size("cells") > 1)
    return rows.select(key, "row_no", "cells", markdown_row(F.col("cells")).alias("markdown"))


def qdrant_point(key: Column, vector: Column, payload: Column) -> Column:
    return F.to_json(F.struct(key.alias("id"), vector.alias("vector"), payload.alias("payload")))


def chroma_row(key: Column, vector: Column, document: Column, metadata: Column) -> Column:
    return F.to_json(F.struct(key.alias("id"), vector.alias("embedding"), document.alias("document"), metadata.alias("metadata")))


def pgvector_row(key: Column, vector: Column, content: Column) -> Column:
    text = F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: x.cast("string")), ","), F.lit("]"))
    return F.to_json(F.struct(key.alias("id"), content.alias("content"), text.alias("embedding")))


def manifest(rows: DataFrame, kind: str) -> DataFrame:
    """(kind, n) of an export."""
    return rows.groupBy(kind).agg(F.count("*").alias("n"))
