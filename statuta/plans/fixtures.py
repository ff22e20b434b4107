"""Regulation-like tables made from the test tables, row by row. SQL that both engines read is used for both sides of a check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.session import table


def both(sql: str, *names: str):
    """(a function that gives the rows in Spark, the SQL for DuckDB) of one statement that names its tables in braces."""

    def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})

    return rows, sql.format(**{n: n for n in names})


#: One regulation book per part: a contents list, chapter, articles with paragraphs, items and subitems, a reference in a sentence, a supplement, an attachment.
BOOK_LINES = (
    "목차", "1-1-{k}. 제{b}규정 ..... 3", "1-1-{k}. 제{b}규정", "제1장 총칙", "제1조(목적) 이 규정은 기준을 정한다.", "제5조에 따라 처리한다.", "① 다음 각 호와 같다.",
    "1. 첫째", "2) 둘째", "가. 세부 하나", "(나) 세부 둘", "각. 항목이 아니다", "1.5배를 지급한다", "㉑ 스물한째 항", "□ 네모 항", "제2조 정의", "2024. 1. 5. 개정한 날",
    "제3조의2【특례】 제3항 및 제4항", "제4조 및 제5조를 준용한다", "[별표 1]의 기준에 따른다", "부칙", "제1조(시행일) 이 규정은 2024년 3월 1일부터 시행한다.",
    "제2조(다른 규정의 개정) 인사규정 일부를 다음과 같이 개정한다.", "제9조(휴가) 휴가는 다음과 같다.", "[별표 {s}] 수당 기준표", "구분 | 금액", "붙임 2 신청서 목록", "[별지 제3호 서식] 신청서",
)


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, name, raw_text): every part is a document; each seventh has no structure."""
    parts = table(spark, sf_dir, "part")
    lines = [F.replace(F.replace(F.replace(F.lit(x), F.lit("{k}"), F.col("p_partkey").cast("string")), F.lit("{b}"), F.substring("p_brand", 7, 2)), F.lit("{s}"), F.col("p_size").cast("string")) for x in BOOK_LINES]
    plain = F.concat_ws("\n", F.concat(F.lit("안내문 "), "p_name"), F.repeat(F.concat(F.col("p_name"), F.lit(". ")), 60))
    return parts.select(F.col("p_partkey").alias("document_id"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 7 == 0, plain).otherwise(F.array_join(F.array(*lines), "\n")).alias("raw_text"))
