"""Metadata of generated files: every part is a file of one of fifty regulations, named and written in one of six ways."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from statuta.operators import intake
from statuta.plans.fixtures import both

TODAY = "2025-06-30"
TITLE = "concat(CASE f % 3 WHEN 0 THEN '인사관리' WHEN 1 THEN '보수' ELSE '여비' END, f, '규정')"
NUMBERED = f"SELECT *, {TITLE} AS t FROM (SELECT p_partkey AS k, p_partkey % 6 AS c, CAST(floor(p_partkey / 6) AS BIGINT) % 50 AS f FROM {{part}}) AS a"

file_rows, FILES = both(
    f"""SELECT k AS file_id, CASE c WHEN 0 THEN concat(t, '(20240', f % 9 + 1, '05).pdf') WHEN 1 THEN concat('1-2-3. ', t, '_v2.1 final.docx') WHEN 2 THEN concat('scan', k, '.pdf')
    WHEN 3 THEN concat('제3차 개정 ', t, '.hwp') WHEN 4 THEN concat(t, ' 24010', f % 9 + 1, '.hwp') ELSE concat(t, '.txt') END AS filename,
    CASE c WHEN 2 THEN concat('기관 안내\\n', t, '\\n개정 2023. 5. ', f % 9 + 1, '.\\n시행 2023. 6. 1.\\n제1조(목적) 이 규정은 목적을 정한다.') WHEN 5 THEN '날짜가 없는 글' END AS text,
    concat('p', f % 2) AS profile_id, CAST(NULL AS STRING) AS tenant_id FROM ({NUMBERED}) AS b""",
    "part",
)

#: Every second regulation has three documents; the second of them is the newest approved one and has an id of its own.
document_rows, DOCUMENTS = both(
    f"""SELECT DISTINCT concat('d', f, '-', e) AS document_id, concat(t, CASE e WHEN 0 THEN ' 최종본' ELSE '' END) AS document_name, CAST(NULL AS STRING) AS filename,
    CASE WHEN e = 1 THEN concat('custom-', f) END AS regulation_id, CASE e WHEN 0 THEN 'v4' WHEN 1 THEN 'v3' ELSE 'v9' END AS regulation_version,
    CASE WHEN e = 2 THEN 'draft' ELSE 'Approved' END AS regulation_status, concat('202', e, '-01-01') AS effective_from, CAST(NULL AS STRING) AS revision_date, '2022-01-01' AS created_at,
    concat('P', f % 2) AS profile_id, CAST(NULL AS STRING) AS tenant_id FROM ({NUMBERED}) AS b CROSS JOIN (VALUES (0), (1), (2)) AS x(e) WHERE f % 2 = 0""",
    "part",
)


def file_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = intake.inferred(file_rows(spark, sf_dir), document_rows(spark, sf_dir), TODAY)
    return found.drop("filename", "text", "profile_id", "tenant_id")


METADATA_SQL = f"""
WITH b AS ({NUMBERED.format(part='part')}),
d AS (SELECT *, CASE c WHEN 0 THEN '2024-0' || (f % 9 + 1) || '-05' WHEN 2 THEN '2023-05-0' || (f % 9 + 1) WHEN 4 THEN '2024-01-0' || (f % 9 + 1) ELSE '{TODAY}' END AS revision_date FROM b)
SELECT k AS file_id, t AS document_name, CASE WHEN f % 2 = 0 THEN 'custom-' || f ELSE 'reg-' || t END AS regulation_id,
    CASE c WHEN 1 THEN 'v2.1' WHEN 3 THEN 'rev-3' WHEN 5 THEN CASE WHEN f % 2 = 0 THEN 'v10' ELSE 'v1' END ELSE 'rev-' || replace(revision_date, '-', '') END AS regulation_version,
    revision_date, CASE WHEN c = 2 THEN '2023-06-01' ELSE revision_date END AS effective_from, CASE WHEN f % 2 = 0 THEN 'd' || f || '-1' END AS supersedes_document_id,
    CASE WHEN c = 2 THEN 'content' ELSE 'filename' END AS title_source, CASE WHEN c = 2 THEN 'content' WHEN c IN (0, 4) THEN 'filename' ELSE 'upload_date' END AS revision_date_source,
    CASE WHEN c = 2 THEN 'content' WHEN c IN (0, 4) THEN 'filename' ELSE 'revision_date' END AS effective_from_source,
    CASE WHEN c = 2 THEN 'content' WHEN c = 5 THEN 'sequence' ELSE 'filename' END AS version_source FROM d"""


def file_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file that each file of an upload follows, by the inferred titles and dates."""
    found = intake.inferred(file_rows(spark, sf_dir), document_rows(spark, sf_dir), TODAY)
    return intake.chained(found).select("file_id", "effective_from", "before_file_id")


CHAINS_SQL = f"""
WITH m AS ({METADATA_SQL}), n AS (SELECT document_name, effective_from, count(*) AS n, min(file_id) AS one FROM m GROUP BY 1, 2),
p AS (SELECT a.document_name, a.effective_from, max(b.effective_from) AS before_day FROM n a LEFT JOIN n b ON a.document_name = b.document_name AND b.effective_from < a.effective_from GROUP BY 1, 2)
SELECT m.file_id, m.effective_from, CASE WHEN n.n = 1 THEN n.one END AS before_file_id FROM m JOIN p USING (document_name, effective_from)
LEFT JOIN n ON n.document_name = p.document_name AND n.effective_from = p.before_day"""

QUERIES = {"file_metadata": (file_metadata, METADATA_SQL), "file_chains": (file_chains, CHAINS_SQL)}
