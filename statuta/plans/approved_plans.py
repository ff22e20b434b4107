"""An approved search over the generated records: every way in which a record can be hidden hides some of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.operators import approved, search
from statuta.plans.search_plans import RECORDS, records
from statuta.session import shared_folder

REQUEST = approved.Request("w3", "t1", "operator", ("hr",), day="2025-06-01", k=60)


def governed_records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, chunks as they are now, documents)."""
    k = F.col("k")
    rows = records(spark, sf_dir).withColumns({
        "document_id": F.concat(F.lit("d"), k % 3), "chunk_id": F.col("id"), "approval_status": F.when(k % 17 == 0, "pending").otherwise("approved"), "approval_id": F.concat(F.lit("a"), k % 7),
        "security_level": F.element_at(F.array(*[F.lit(x) for x in ("public", "internal", "sensitive", "confidential")]), (k % 4 + 1).cast("int")),
        "department_acl": F.when(k % 5 == 0, F.array(F.lit("hr"))).when(k % 5 == 1, F.array(F.lit("fin"))).otherwise(F.array().cast("array<string>")), "profile_id": F.lit("p"),
        "regulation_id": F.concat(F.lit("r"), "reg"), "effective_from": F.when(k % 2 == 0, "2024-01-01").otherwise("2025-01-01"), "effective_to": F.lit(None).cast("string"), "repealed_at": F.lit(None).cast("string"),
    })
    rows = rows.withColumn("approved_content_hash", F.col("content_hash")).withColumn("content_hash", F.when(k % 19 == 0, F.sha2(F.lit("older"), 256)).otherwise(F.col("content_hash")))
    chunks = rows.filter("k % 29 <> 0").withColumn("approval_id", F.when(k % 23 == 0, "withdrawn").otherwise(F.col("approval_id")))
    documents = rows.select("document_id", F.when(F.col("document_id") == "d2", "t2").otherwise("t1").alias("tenant_id"), "profile_id").distinct()
    return rows, chunks, documents


def approved_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, chunks, documents = governed_records(spark, sf_dir)
    folder = shared_folder(spark)
    search.build_index(rows, folder)
    index = search.Index.open(spark, folder)
    return approved.approved_search(rows, chunks, documents, REQUEST, index, index.fingerprint).select("id", "model", F.round("score", 6).alias("score"))


APPROVED_SQL = f"""
WITH r AS (SELECT *, 34 + (k % 3 = 0)::INT AS n FROM ({RECORDS})),
s AS (SELECT count(*) AS docs, round(avg(n), 6) AS mean, count(*) FILTER (k % 13 = 3) AS dw FROM r),
v AS (SELECT * FROM r WHERE k % 13 = 3 AND k % 17 <> 0 AND k % 4 <> 3 AND k % 5 <> 1 AND k % 19 <> 0 AND k % 29 <> 0 AND k % 23 <> 0 AND k % 3 <> 2 AND k % 2 = 1)
SELECT id, 'bm25' AS model, round(round(ln(1 + (docs - dw + 0.5) / (dw + 0.5)) * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * n / mean)), 8), 6) AS score FROM v, s ORDER BY score DESC, id LIMIT 60"""

QUERIES = {"approved_results": (approved_results, APPROVED_SQL)}
