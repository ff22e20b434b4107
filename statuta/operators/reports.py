"""Checks and roll-ups over batches, indexes and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What an error message says of its cause, first match first.
FAILURES = (
    ("ocr_required", r"(?i)ocr|no text layer"), ("password", r"(?i)password|encrypted"), ("timeout", r"(?i)time.?out|deadline"),
    ("corrupt", r"(?i)corrupt|bad zip|malformed|truncated"), ("unsupported", r"(?i)unsupported|no reader"), ("memory", r"(?i)out of memory|oom"),
)


def failure_category(message: Column) -> Column:
    """The category of an error message; other if none fits, none without a message."""
    out = F.when(message.isNull() | (F.trim(message) == ""), "none")
    for name, pattern in FAILURES:
        out = out.when(message.rlike(pattern), name)
    return out.otherwise("other")


def checks(row: DataFrame, tests: list[tuple[str, str, Column]]) -> DataFrame:
    """(check, severity, passed) of a one-row or grouped frame: a row for each test and input row, with the frame's first column."""
    key = row.columns[0]
    made = F.array(*[F.struct(F.lit(n).alias("check"), F.lit(s).alias("severity"), F.coalesce(t, F.lit(False)).alias("passed")) for n, s, t in tests])
    return row.select(key, F.inline(made))


def verdict(results: DataFrame, key: str) -> DataFrame:
    """(key, passed, n_failed): passed if no check of severity error failed."""
    failed = ~F.col("passed")
    return results.groupBy(key).agg(F.bool_and(F.col("passed") | (F.col("severity") != "error")).alias("passed"), F.count_if(failed).alias("n_failed"))


def coverage(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, n, filled) of every field."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"), *[F.count(f).alias(f) for f in fields])
    return counts.unpivot([key, "n"], fields, "field", "filled")


def index_status(expected: DataFrame, indexed: DataFrame, key: str, content: str) -> DataFrame:
    """One row: records expected, indexed, missing, stale (other content) and left over."""
    e, i = expected.select(key, F.col(content).alias("want")), indexed.select(key, F.col(content).alias("have"))
    both = e.join(i, key, "full_outer")
    return both.agg(
        F.count("want").alias("expected"),
        F.count("have").alias("indexed"),
        F.count_if(F.col("have").isNull()).alias("missing"),
        F.count_if(F.col("have").isNotNull() & F.col("want").isNotNull() & (F.col("have") != F.col("want"))).alias("stale"),
        F.count_if(F.col("want").isNull()).alias("left_over"),
    )


def representatives(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    """(group, representative, n): the first row of each group and how many it stands for."""
    return rows.groupBy(*group).agg(F.min(order).alias("representative"), F.count("*").alias("n"))


def citation(document: Column, path: Column, article: Column, page: Column) -> Column:
    return F.concat_ws(" ", document, F.concat(F.lit("("), path, F.lit(")")), article, F.concat(F.lit("p."), page.cast("string")))
