"""Unit identity over generated documents: every part is a document of three records, every eight parts a family that shows one step or veto."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from statuta.operators import identity
from statuta.plans.fixtures import both

#: k: document; f, j: its family and place there; s: what the family shows; v: which veto; r: record.
FAMILIES = """SELECT *, concat('인사기준', f, '나', j) AS own, concat('공통기준', f, '다', CAST(floor(j / 2) AS BIGINT)) AS common FROM (
    SELECT *, f % 10 AS s, CAST(floor(f / 10) AS BIGINT) % 4 AS v, k % 8 AS j FROM (
    SELECT p_partkey AS k, CAST(floor(p_partkey / 8) AS BIGINT) AS f, r FROM {part} CROSS JOIN (VALUES (0), (1), (2)) AS t(r)) AS a) AS b"""

record_rows, RECORDS = both(
    f"""SELECT concat('r', k, '-', r) AS record_id, concat('d', k) AS document_id, concat('p', f % 3) AS profile_id,
    CASE WHEN s = 0 AND r = 2 THEN '인사기준' WHEN s IN (1, 2) AND r = 0 THEN concat(own, '갑') WHEN s = 2 AND r = 2 THEN concat('별개문서', k) WHEN s IN (1, 2) OR (s = 9 AND v = 3 AND j = 0 AND r = 2) THEN concat(own, '을')
         WHEN s IN (3, 4, 5) THEN common ELSE own END AS regulation_title,
    CASE WHEN s = 0 AND r = 2 THEN '제16조' WHEN s = 0 AND r = 1 THEN concat('제3.', j, '호') WHEN s = 0 THEN concat('3-', j) WHEN s IN (1, 2) AND r = 2 THEN NULL WHEN s IN (1, 2) THEN CAST(r + 1 AS STRING)
         WHEN s = 5 OR (s = 3 AND j % 2 = 1) THEN NULL WHEN s IN (3, 4) THEN CAST(7 + j % 2 AS STRING) WHEN s = 9 AND v = 3 AND j = 0 AND r = 2 THEN '99' ELSE concat('1', j) END AS regulation_no,
    CASE WHEN s = 7 AND v = 3 THEN '통합 규정집' END AS document_name, CASE WHEN s IN (3, 4, 5) THEN common END AS canonical_title,
    CASE WHEN s = 7 AND v = 0 THEN concat('regulation-book-', f) WHEN s IN (6, 7) THEN concat('RID ', f) END AS regulation_id,
    CASE WHEN s = 9 AND v = 0 AND j = 0 THEN concat('d', k + 7) WHEN s = 9 AND v = 1 AND j = 2 THEN concat('d', k - 2) WHEN s IN (8, 9) AND j > 0 THEN concat('d', k - 1) END AS supersedes_document_id,
    CASE WHEN s = 7 AND v = 2 AND j = 3 THEN NULL WHEN s = 7 AND v = 1 AND j = 1 THEN '2024-01-01' WHEN s = 9 AND v = 0 THEN '2024-05-01' WHEN s = 9 AND v = 2 THEN concat('2024-0', 9 - j, '-01') ELSE concat('2024-0', j + 1, '-01') END AS lineage_date
    FROM ({FAMILIES}) AS c""",
    "part",
)


def unit_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, number and unit of every record."""
    return identity.identities(record_rows(spark, sf_dir)).select("record_id", "title", "regulation_no", "unit_id")


#: What each family must come to: the title and number of the segment, and of the one whose identity its unit takes.
IDENTITY_SQL = f"""
WITH b AS ({FAMILIES.format(part='part')}),
own_id AS (SELECT *,
    CASE WHEN (s IN (1, 2) AND r = 0) THEN own || '갑' WHEN s = 2 AND r = 2 THEN '별개문서' || k WHEN s IN (1, 2) OR (s = 9 AND v = 3 AND j = 0 AND r = 2) THEN own || '을' WHEN s IN (3, 4, 5) THEN common ELSE own END AS title,
    CASE WHEN s = 0 THEN '제3.' || j || '호' WHEN s = 1 AND r = 2 THEN '2' WHEN s = 2 AND r = 2 THEN '' WHEN s IN (1, 2) THEN (r + 1)::VARCHAR WHEN s IN (3, 5) THEN '' WHEN s = 4 THEN (7 + j % 2)::VARCHAR
         WHEN s = 9 AND v = 3 AND j = 0 AND r = 2 THEN '99' ELSE '1' || j END AS regulation_no,
    CASE WHEN s IN (6, 8) THEN 0 WHEN s = 9 AND v = 1 AND j > 2 THEN 2 WHEN s = 9 AND v = 3 AND j > 1 THEN 1 ELSE j END AS root FROM b),
unit_names AS (SELECT *, CASE WHEN root <> j THEN '인사기준' || f || '나' || root ELSE title END AS t,
    CASE WHEN root <> j THEN '1' || root WHEN s = 0 THEN '3-' || j WHEN s = 5 THEN 'source-' || substr(sha256('d' || k), 1, 16) ELSE regulation_no END AS n FROM own_id)
SELECT 'r' || k || '-' || r AS record_id, title, regulation_no,
    'regunit-' || substr(sha256('p' || f % 3 || chr(10) || CASE WHEN n <> '' THEN 'title:' || t || chr(10) || 'no:' || n ELSE t END), 1, 20) AS unit_id FROM unit_names"""

QUERIES = {"unit_identities": (unit_identities, IDENTITY_SQL)}
