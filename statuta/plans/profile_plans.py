"""Answer profiles of generated articles and answers to questions by intent: parts are articles (an allowance, a procedure or nothing in turn), suppliers ask about two of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.operators import profiles
from statuta.session import table

ALLOWANCE = "제1조(수당) 직원에게 수당 {k}만원을 지급한다. 다만, 휴직한 자는 제외한다. 신청 기한은 10일 이내로 한다."
PROCEDURE = "① 공고 ② 서류 심사 ③ 면접"


def profiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, F.replace(F.lit(ALLOWANCE), F.lit("{k}"), k.cast("string"))).when(k % 3 == 1, F.lit(PROCEDURE))
    return profiles.profiles(table(spark, sf_dir, "part").select(k.alias("chunk_id"), text.alias("text"), F.lit("보수규정").alias("title")), "text", ["title"])


def answer_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = lambda f: F.concat_ws("=", f["type"], f["value"])
    flat = lambda c: F.array_join(c, "|").alias(c)
    return profiled(spark, sf_dir).select("chunk_id", flat("answer_intents"), flat("answer_keywords"), F.array_join(F.transform("answer_facts", fact), "|").alias("answer_facts"), flat("answer_outline"))


PROFILES_SQL = """
SELECT p_partkey AS chunk_id, CASE p_partkey % 3 WHEN 0 THEN 'procedure|eligibility|duration|payment|exception' WHEN 1 THEN 'procedure|payment' ELSE 'payment' END AS answer_intents,
    CASE p_partkey % 3 WHEN 0 THEN '보수규정|procedure|eligibility|duration|payment|exception|수당|지급한다|휴직한' WHEN 1 THEN '보수규정|procedure|payment|공고|심사' ELSE '보수규정|payment' END AS answer_keywords,
    CASE p_partkey % 3 WHEN 0 THEN 'payment=' || p_partkey || '만원|condition=다만, 휴직한 자는 제외한다.|exception=다만, 휴직한 자는 제외한다.|duration=10일 이내' WHEN 1 THEN 'procedure_step=공고|procedure_step=서류 심사' ELSE '' END AS answer_facts,
    CASE p_partkey % 3 WHEN 0 THEN '제1조(수당) 직원에게 수당 ' || p_partkey || '만원을 지급한다.|다만, 휴직한 자는 제외한다.|신청 기한은 10일 이내로 한다.' WHEN 1 THEN '① 공고|② 서류 심사' ELSE '' END AS answer_outline
FROM part"""


def slot_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier")
    queries = rows.select(s.alias("query_id"), F.get(F.array(*[F.lit(q) for q in ("수당은 얼마인가", "심사 절차", "기타", "신청 기한")]), (s % 4).cast("int")).alias("query"))
    hits = rows.select(s.alias("query_id"), F.posexplode(F.array(s, s + 1)).alias("rank", "chunk_id"))
    flat = lambda c: F.array_join(c, "|").alias(c)
    return profiles.answers(queries, hits, profiled(spark, sf_dir)).select("query_id", "intent", flat("filled"), flat("missing"), flat("evidence"))


ANSWERS_SQL = """
WITH q AS (SELECT s_suppkey AS s, s_suppkey % 4 AS m, CASE s_suppkey % 3 WHEN 0 THEN s_suppkey WHEN 2 THEN s_suppkey + 1 END AS a, CASE s_suppkey % 3 WHEN 0 THEN s_suppkey + 1 WHEN 1 THEN s_suppkey END AS b, '다만, 휴직한 자는 제외한다.' AS x FROM supplier)
SELECT s AS query_id, CASE m WHEN 0 THEN 'payment' WHEN 1 THEN 'procedure' WHEN 2 THEN 'general' ELSE 'duration' END AS intent,
    CASE m WHEN 1 THEN concat_ws('|', 'procedure_step: 공고' || left(b::VARCHAR, 0), 'duration: 10일 이내' || left(a::VARCHAR, 0))
        WHEN 2 THEN CASE s % 3 WHEN 0 THEN '제1조(수당) 직원에게 수당 ' || a || '만원을 지급한다.|' || x || '|신청 기한은 10일 이내로 한다.' WHEN 1 THEN '① 공고|② 서류 심사' ELSE '' END
        ELSE coalesce(CASE m WHEN 0 THEN 'payment: ' || a || '만원' ELSE 'duration: 10일 이내' || left(a::VARCHAR, 0) END || '|condition: ' || x || '|exception: ' || x, '') END AS filled,
    CASE m WHEN 1 THEN concat_ws('|', CASE WHEN b IS NULL THEN 'procedure_step' END, 'obligation', CASE WHEN a IS NULL THEN 'duration' END) WHEN 2 THEN '' ELSE CASE WHEN a IS NULL THEN CASE m WHEN 0 THEN 'payment' ELSE 'duration' END || '|condition|exception' ELSE '' END END AS missing,
    CASE m WHEN 1 THEN concat_ws('|', b, a) WHEN 2 THEN s::VARCHAR ELSE coalesce(a::VARCHAR, '') END AS evidence FROM q"""

QUERIES = {"answer_profiles": (answer_profiles, PROFILES_SQL), "slot_answers": (slot_answers, ANSWERS_SQL)}
