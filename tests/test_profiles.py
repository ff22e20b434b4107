"""Answer profiles and answers by slots: bounds, repeated facts, empty input, questions without hits."""

from pyspark.sql import functions as F

from statuta.operators import profiles


def test_bounds_and_repeats(spark):
    many = " ".join(f"{i}. 기준 {i}은 {i}일 이내로 한다." for i in range(1, 41))
    rows = spark.createDataFrame([(1, many), (2, "지급한다. 지급한다."), (3, None), (4, " "), (5, "맑음. 흐림. 비. 눈.")], "chunk_id int, text string")
    found = {r["chunk_id"]: r for r in profiles.profiles(rows, "text").collect()}
    assert 20 <= len(found[1]["answer_facts"]) < 24 and len(found[1]["answer_outline"]) == 5
    assert [(f["type"], f["value"]) for f in found[2]["answer_facts"]] == [("payment", "지급한다.")]
    assert all(found[k][c] == [] for k in (3, 4) for c in ("answer_facts", "answer_intents", "answer_keywords", "answer_outline"))
    assert found[5]["answer_outline"] == ["맑음.", "흐림.", "비."]  # no sentence has a score


def test_sentences(spark):
    text = "제1조 (목적) 뜻을 둔다. 2024. 3. 1. 개정한 것 [별표 1] 12. 열둘째 제2조(범위) 둔다"
    assert spark.range(1).select(profiles.sentences(F.lit(text))).first()[0] == ["제1조 (목적) 뜻을 둔다.", "2024.3.1.", "개정한 것", "12.", "열둘째", "제2조(범위) 둔다"]


def test_slots(spark):
    rows = spark.createDataFrame([("a", "성과급 30 % 지급. 다만, 신입은 제외한다."), ("b", "연봉 5만원")], "chunk_id string, text string")
    queries = spark.createDataFrame([(1, "금액은?"), (2, "금액은?"), (3, None), (4, "의무")], "query_id int, query string")
    hits = spark.createDataFrame([(1, 2, "a"), (1, 1, "b"), (3, 1, "a"), (4, 1, "zz")], "query_id int, rank int, chunk_id string")
    found = {r["query_id"]: r for r in profiles.answers(queries, hits, profiles.profiles(rows, "text")).collect()}
    assert (found[1]["filled"], found[1]["missing"], found[1]["evidence"]) == (["payment: 5만원", "condition: 다만, 신입은 제외한다.", "exception: 다만, 신입은 제외한다."], [], ["b", "a"])
    assert (found[2]["filled"], found[2]["missing"], found[2]["evidence"]) == ([], ["payment", "condition", "exception"], [])
    assert (found[3]["intent"], found[3]["filled"][:1], found[3]["evidence"]) == ("general", ["성과급 30 % 지급."], ["a"])
    assert found[4]["missing"] == ["obligation", "duration"]
    own = {"bonus": ("보너스", ["payment"])}
    asked = spark.createDataFrame([(1, "보너스?")], "query_id int, query string")
    assert profiles.answers(asked, hits, profiles.profiles(rows, "text"), own).first()["filled"] == ["payment: 5만원"]
