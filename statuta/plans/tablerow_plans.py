"""Rows of flattened tables of generated texts, one of each layout in turn; every sixth is an article, in which no layout is tried."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.operators import tablerows
from statuta.session import table

#: {k} the part's key, {s} its size.
TEXTS = (
    "1. 계약 심사\n가. 공사\n(1) {k}만원 이상\n(2) 설명뿐\n나. 용역\n(3) {s}원 초과\n2. 소송\n(1) 소송 {k}", "1. 출장비: {k}원\n나. 숙박비 : {s}만원 이하\n1. 출장비: {k}원\n\n3. 비고: 없음\n4. 기간: {s}일",
    "안전 점검\n평가 항목\n내용\n소방\n설비 상태 {k} 확인\n및 기록\n전기\n비상등\n※ 주의\n{k}회 점검", "가급 10 20 30 나급 {s} 5\n직책 7\n다급 라급 1 2\n제3조 관련 4 5", "A-{k}\n토목 공사 {s}\n건축 공사\nB-{k}\n[주] 뺀다\nC-1",
    "1. 출장비: {k}원\n2. 숙박비: {s}원",
)


def flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    filled = [F.replace(F.replace(F.lit(x), F.lit("{k}"), k.cast("string")), F.lit("{s}"), s) for x in TEXTS]
    return table(spark, sf_dir, "part").select(k.alias("document_id"), F.get(F.array(*filled), (k % 6).cast("int")).alias("text"), F.when(k % 6 == 5, "article").when(k % 6 == 1, "form").otherwise("appendix").alias("context"))


def flattened_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tablerows.layout_rows(flattened(spark, sf_dir), "document_id", "text", "context")
    return rows.select("document_id", "layout", "row_no", "line_no", F.array_join("cells", "|").alias("cells"), F.array_join("flags", ",").alias("flags"))


ROWS_SQL = """
SELECT p_partkey AS document_id, layout, row_no, line_no, replace(replace(cells, '{k}', p_partkey::VARCHAR), '{s}', p_size::VARCHAR) AS cells, CASE layout WHEN 'dense_numeric' THEN 'dense_numeric_row_reconstruction' WHEN 'vertical_checklist' THEN 'vertical_checklist_row' ELSE '' END AS flags
FROM part JOIN (VALUES (0, 'outline_condition', 0, -1, '대항목|세부항목|순번|기준'), (0, 'outline_condition', 1, 2, '계약 심사|공사|1|{k}만원 이상'), (0, 'outline_condition', 2, 5, '계약 심사|용역|3|{s}원 초과'), (0, 'outline_condition', 3, 7, '소송||1|소송 {k}'),
    (1, 'numbered_colon', 0, -1, '항목|기준|값'), (1, 'numbered_colon', 1, 0, '1|출장비|{k}원'), (1, 'numbered_colon', 2, 1, '나|숙박비|{s}만원 이하'), (1, 'numbered_colon', 3, 4, '4|기간|{s}일'),
    (2, 'vertical_checklist', 0, -1, '안전 점검|평가 항목'), (2, 'vertical_checklist', 1, 3, '소방|설비 상태 {k} 확인'), (2, 'vertical_checklist', 2, 7, '비상등|{k}회 점검'),
    (3, 'dense_numeric', 0, -1, '구분|수치1|수치2|수치3'), (3, 'dense_numeric', 1, 0, '가급|10|20|30'), (3, 'dense_numeric', 2, 0, '나급|{s}|5'), (3, 'dense_numeric', 3, 2, '다급 라급|1|2'),
    (4, 'code_description', 0, -1, '분류코드|대상'), (4, 'code_description', 1, 0, 'A-{k}|토목 공사 {s}'), (4, 'code_description', 2, 2, 'B-{k}|건축 공사')) AS t(m, layout, row_no, line_no, cells) ON p_partkey % 6 = m"""

QUERIES = {"flattened_rows": (flattened_rows, ROWS_SQL)}
