"""All queries of the library but those of the llm subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from statuta.plans import approved_plans, book_plans, catalog_plans, detail_plans, gate_plans, governance_plans, grid_plans, identity_plans, intake_plans, layout_plans, metadata_plans, profile_plans, reference_plans, relation_plans, relational_plans, report_plans, retrieval_plans, search_plans, tablerow_plans, text_plans

ALL = {**text_plans.QUERIES, **metadata_plans.QUERIES, **retrieval_plans.QUERIES, **relational_plans.QUERIES, **report_plans.QUERIES, **book_plans.QUERIES, **gate_plans.QUERIES, **governance_plans.QUERIES, **search_plans.QUERIES, **reference_plans.QUERIES, **catalog_plans.QUERIES, **identity_plans.QUERIES, **intake_plans.QUERIES, **detail_plans.QUERIES, **approved_plans.QUERIES, **grid_plans.QUERIES, **layout_plans.QUERIES, **tablerow_plans.QUERIES, **relation_plans.QUERIES, **profile_plans.QUERIES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
