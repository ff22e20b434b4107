"""Entries of a URL list in the forms people write them, and quality rules for languages without listed stop words."""

import datetime

from pyspark.sql import functions as F

from statuta.llm import quality, urls


def test_entries_match_as_written(spark):
    day = datetime.date(2024, 1, 1)
    patterns = ["worse.com", "Bad.com/", "https://Third.org", "fourth.net:8080/Some/path?x=1", "*.fifth.org", ".sixth.org.", "//seventh.org/a//b", "", "/only/path"]
    entries = spark.createDataFrame([(p, "block", day) for p in patterns] + [("eighth.org", "forbid", day), ("ninth.org", "block", None)], "pattern string, action string, listed_on date")
    cases = ["http://worse.com/x", "http://a.bad.com", "http://third.org/", "http://fourth.net/Some/path/y", "http://x.fifth.org/", "http://sixth.org", "http://seventh.org/a/b/c"]
    good = ["http://fourth.net/some/path", "http://fourth.net/", "http://eighth.org/", "http://ninth.org/", "http://notworse.com/", "http://seventh.org/a"]
    rows = [(k, u, day) for k, u in enumerate(cases + good)]
    found = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, fetched_at date"), entries).collect()
    assert {r["url"]: r["kept"] for r in found} == {u: u in good for u in cases + good}
    assert sorted(r["reason"] for r in urls.rejected_entries(entries).collect()) == ["no date", "no host", "no host", "unknown action"]


def test_two_actions_on_one_date(spark):
    day = datetime.date(2024, 1, 1)
    entries = spark.createDataFrame([("a.org", x, day) for x in ("allow", "block", "drop")] + [("b.org/", x, day) for x in ("drop", "allow")], "pattern string, action string, listed_on date")
    rows = spark.createDataFrame([(1, "http://a.org/", day), (2, "http://b.org", day)], "page_id long, url string, fetched_at date")
    assert {r["page_id"]: (r["action"], r["kept"]) for r in urls.filter_urls(rows, entries).collect()} == {1: ("block", False), 2: ("allow", True)}


def test_unlisted_languages_are_not_judged_by_stop_words(spark):
    korean = "이 규정은 직원의 휴가와 수당에 관한 기준을 정하여 업무를 공정하게 처리하는 것을 목적으로 하며 부서의 장은 매년 계획을 세워 모든 직원에게 알리고 그 결과를 기록하여 다음 해까지 보관한다 또한"
    italian = "questo regolamento stabilisce norme generali sulle ferie dei dipendenti pubblici secondo quanto previsto dalla legge vigente affinché ogni ufficio possa applicarle senza ulteriori indugi oppure incertezze rispetto alla disciplina precedente"
    rows = spark.createDataFrame([(1, korean, None), (2, italian, "it"), (3, italian, "en"), (4, italian, None), (5, korean, "KO")], "doc_id long, text string, lang string").withColumn("listed", F.lit(7))
    found = {r["doc_id"]: r["rejected_by"] for r in quality.quality(rows).collect()}
    assert found == {1: None, 2: None, 3: "stop words", 4: "stop words", 5: None}
    assert {r["doc_id"] for r in quality.keep_quality(rows).collect()} == {1, 2, 5}
    assert {r["doc_id"] for r in quality.keep_quality(rows.drop("lang")).collect()} == {1, 5}
