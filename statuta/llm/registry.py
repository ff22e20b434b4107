"""Queries of this subpackage and, where SQL can say the same, their DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from statuta.llm.ann import op10_nearest_neighbours
from statuta.llm.jaccard import OP3_SQL, op3_jaccard_join
from statuta.llm.lines import OP11_SQL, op11_line_dedup
from statuta.llm.lm import OP8_BIGRAMS_SQL, OP8_SQL, op8_lm_scoring, op8_lm_scoring_bigrams
from statuta.llm.packing import op2_best_fit_packing
from statuta.llm.periods import op12_period_runs
from statuta.llm.pieces import op6_pieces
from statuta.llm.quality import OP1_SQL, op1_quality_rules
from statuta.llm.secrets import op4_secret_scans
from statuta.llm.sharding import OP9_SQL, op9_sharding
from statuta.llm.toxicity import op7_toxicity
from statuta.llm.tries import OP13_SQL, op13_conversation_trie
from statuta.llm.urls import OP5_SQL, op5_url_filters


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_jaccard_join": op3_jaccard_join,
        "op4_secret_scans": op4_secret_scans,
        "op5_url_filters": op5_url_filters,
        "op6_pieces": op6_pieces,
        "op7_toxicity": op7_toxicity,
        "op8_lm_scoring": op8_lm_scoring,
        "op8_lm_scoring_bigrams": op8_lm_scoring_bigrams,
        "op9_sharding": op9_sharding,
        "op10_nearest_neighbours": op10_nearest_neighbours,
        "op11_line_dedup": op11_line_dedup,
        "op12_period_runs": op12_period_runs,
        "op13_conversation_trie": op13_conversation_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1_SQL, "op3_jaccard_join": OP3_SQL, "op5_url_filters": OP5_SQL, "op8_lm_scoring": OP8_SQL, "op8_lm_scoring_bigrams": OP8_BIGRAMS_SQL, "op9_sharding": OP9_SQL, "op11_line_dedup": OP11_SQL, "op13_conversation_trie": OP13_SQL}
