"""The training-data pipeline: toxicity, quality rules, near duplicates, secrets, packing.

Every stage works on all that its predecessor kept. The first three drop documents, the fourth replaces secrets in
their texts, the last deals what is left into training sequences (one row per piece).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.llm.jaccard import keep_one
from statuta.llm.packing import pack
from statuta.llm.quality import keep_quality
from statuta.llm.secrets import redact_secrets
from statuta.llm.toxicity import score_toxicity, train
from statuta.session import shared_folder, table, written

TOXIC = 0.5


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs scored below TOXIC, as they are. Null and empty texts get the score of a text without words; without labels that train, or with an empty table,
    nothing is rejected for its words. Repeated rows, null ids and other columns of any name and type stay."""
    model = train(docs, table(spark, sf_dir, "labels"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*columns).alias("row"), F.col("text"))
    return score_toxicity(rows, model, score="score").filter(F.col("score") < TOXIC).select("row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that no rule rejects, as they are. Null and blank texts have too few words and go; an empty table stays empty; repeated rows are judged each."""
    return keep_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of the least id (null ids last; of equal ids the first). Blank texts link with nothing and all stay."""
    return keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All docs, with every secret of their texts replaced by its kind and n_chars after the new text. Null and empty texts stay as they are."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of every document, with its bin and place. Null and blank texts give a piece of length 0 in no bin; an empty table gives no rows."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scans),
    ("best-fit packing", packing),
]

#: Neither Viterbi decoding nor best-fit packing can be said in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again."""
    folder = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, folder, f"stage{k}")
    return docs
