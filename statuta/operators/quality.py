"""Chunk validation, coverage and the quality score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Points off per unit and the most that each kind takes off.
PENALTIES = {
    "error_count": (20, 60), "warning_count": (2, 25), "duplicate_ids": (10, 40), "empty_chunks": (10, 40), "missing_pages": (0.5, 20),
    "missing_metadata": (0.5, 20), "replacement_chars": (2, 20), "mojibake": (2, 20), "suspicious_metadata": (5, 15), "tables_without_cells": (0.02, 10),
}


def score(counts: dict[str, Column]) -> Column:
    """100 less capped penalties, at least 0, to one decimal."""
    left = F.lit(100.0)
    for name, value in counts.items():
        each, most = PENALTIES[name]
        left = left - F.least(F.lit(float(most)), value * float(each))
    return F.round(F.greatest(F.lit(0.0), left), 1)


def issues(chunks: DataFrame, key: str, text: str, page: str | None, longest: int) -> DataFrame:
    """(key, issue, severity) of every chunk: empty, very long, page missing, replacement character."""
    found = F.array_compact(
        F.array(
            F.when(F.trim(F.coalesce(F.col(text), F.lit(""))) == "", F.struct(F.lit("empty").alias("issue"), F.lit("error").alias("severity"))),
            F.when(F.length(text) > longest, F.struct(F.lit("very_long").alias("issue"), F.lit("warning").alias("severity"))),
            F.when(F.col(text).contains("�"), F.struct(F.lit("replacement_char").alias("issue"), F.lit("warning").alias("severity"))),
            *([F.when(F.col(page).isNull(), F.struct(F.lit("page_missing").alias("issue"), F.lit("warning").alias("severity")))] if page else []),
        )
    )
    return chunks.select(key, F.explode(found).alias("i")).select(key, "i.*")


def repeated_edges(pages: DataFrame, doc: str, first: str, last: str) -> DataFrame:
    """(doc, line, n): edge lines found on at least max(3, half) of a document's pages; documents of three pages or more."""
    edges = pages.select(doc, F.explode(F.array_distinct(F.array(first, last))).alias("line")).filter("line <> ''")
    counts = edges.groupBy(doc, "line").agg(F.count("*").alias("n"))
    sizes = pages.groupBy(doc).agg(F.count("*").alias("pages")).filter("pages >= 3")
    return counts.join(sizes, doc).filter(F.col("n") >= F.greatest(F.lit(3), F.floor(F.col("pages") / 2))).select(doc, "line", "n")


def budgeted(rows: DataFrame, order: str, cost: str, most: int, budget: int, scope: str) -> DataFrame:
    """The leading rows of each scope, up to `most` and to the first that exceeds the budget, with place and spent.

    The `most` first rows of a scope are found by a partial top-k in every task; only they are summed up."""
    by = Window.partitionBy(scope).orderBy(order)
    first = rows.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= most)
    return first.withColumn("spent", F.sum(cost).over(by)).filter(F.col("spent") <= budget)
