"""Structure, chunks, search, graph, tables and governance on small inputs with known answers."""

import pytest
from pyspark.sql import functions as F

from statuta.functions import dates, korean, text
from statuta.operators import chunking, gate, governance, graph, metadata, numbering, references, search, structure, tables


def classes(spark, lines):
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc_id long, line_no int, line string")
    return [(r["node_type"], r["number"], r["title"]) for r in structure.classified(rows).orderBy("line_no").collect()]


def test_line_classes(spark):
    got = classes(spark, ["제5조에 따라 처리한다", "1.5배를 지급한다", "각. 항목", "㉑ 항", "붙임 1 서류", "제1조 목적", "제1조 이 규정은 직원에 적용한다.", "제2조 삭제 <2020. 1. 1.>", "제7조제2항의 경우", "1-2-3. 인사규정", "[별표 2] 표", "[별표 2]의 표", "1.2.3. 항목", "(가) 목", "2024. 1. 5. 개정"])
    assert [g[0] for g in got] == ["text", "text", "text", "paragraph", "appendix", "article", "article", "article", "text", "regulation", "appendix", "text", "item", "subitem", "text"]
    assert got[5][2] == "목적" and got[6][2] == "" and got[7][2] == "삭제" and got[4][1] == "붙임1"


def test_inline_markers(spark):
    one = lambda x: spark.createDataFrame([(x,)], "t string").select(structure.split_inline(F.col("t")).alias("p")).first()["p"]
    assert one("① 첫째 항 ② 둘째 항 1. 항목") == ["① 첫째 항", "② 둘째 항", "1. 항목"]
    assert one("시행 2024. 1. 5. 개정") == ["시행 2024. 1. 5. 개정"]
    assert one("[별표 1] 표 1. 목록") == ["[별표 1] 표 1. 목록"]
    assert one("(1) 항 안의 ① 표시") == ["(1) 항 안의 ① 표시"]


def test_parts_and_windows():
    assert chunking.parts_of(" short ", 100) == ["short"]
    long = "제1조 머리\n" + "\n".join(f"{c} " + "가" * 60 for c in "①②③")
    assert [p[0] for p in chunking.parts_of(long, 100)] == ["제", "①", "②", "③"]
    sentences = " ".join(f"문장 {i} 입니다." for i in range(40))
    parts = chunking.parts_of(sentences, 100, 20)
    assert all(len(p) <= 121 for p in parts) and parts[0].startswith("문장 0") and parts[-1].endswith("39 입니다.")
    assert "".join(chunking.hard_windows("x" * 250, 100, 0)) == "x" * 250


def test_title_only_regulations(spark):
    lines = ["합본", "인사규정", "제1조(목적) 이 규정은 정한다.", "[별표 1] 표", "보수규정", "제1조(목적) 이 규정은 정한다.", "[별지 제1호 서식] 신청", "여비기준", "내용이 이어진다"]
    rows = spark.createDataFrame([(1, "\n".join(lines), "text", 0)], "doc_id long, t string, kind string, at int")
    found = {r["line"]: (r["node_type"], r["boundary"]) for r in structure.detected(rows, "doc_id", "t", "kind", "at").collect()}
    assert found["인사규정"] == ("regulation", "implicit") and found["보수규정"] == ("regulation", "implicit") and found["여비기준"] == ("text", "ambiguous")


def test_profiles_are_checked():
    default, own = gate.read_profiles(b'{"default": {"coverage_ratio_min": 0.5}, "profiles": {" KR ": {"coverage_ratio_max": 2.0}}}')
    assert default.coverage_ratio_min == 0.5 and own["kr"].coverage_ratio_max == 2.0 and own["kr"].coverage_ratio_min == 0.5
    for bad in (b'{"default": {"x": 1}}', b'{"other": 1}', b'{"default": {"coverage_ratio_min": 3}}', b"[]"):
        with pytest.raises(ValueError):
            gate.read_profiles(bad)


def test_index_versions_and_cold_words(spark, tmp_path):
    rows = spark.createDataFrame([("a", "육아 휴직 수당을 지급한다", "인사규정", "제5조", "h1"), ("b", "출장 여비", "여비규정", "제6조", "h2"), ("c", "foo-bar text", "보수규정", "제7조", "h3")], "id string, text string, regulation_title string, article_no string, content_hash string")
    folder = f"file://{tmp_path}/index"
    assert search.current(spark, folder) is None
    first = search.build_index(rows, folder)
    second = search.build_index(rows.filter("id <> 'c'"), folder)
    assert search.current(spark, folder) == second != first
    index = search.Index.open(spark, folder, first)
    assert not index.stale_for(rows) and index.stale_for(rows.limit(1))
    found = lambda q, allowed=None: {r["id"] for r in index.search(q, allowed).collect()}
    assert found("foo-bar") == {"c"} and found("수당") == {"a"} and found("zzz") == set() and found("") == set()
    assert found("휴직 여비", rows.filter("id = 'b'")) == {"b"}
    assert search.segments("육아휴직수당", {"육아", "휴직", "수당", "휴직수당"}) == ("육아", "휴직", "수당")
    assert set(index.cold_terms("육아휴직자")) >= {"육아", "휴직"}
    assert [r["model"] for r in search.cascade(rows, "oo-b", index, 5).collect()] == ["literal"]
    assert [r["id"] for r in search.cascade(rows, "bar", None, 5).collect()] == ["c"]


def test_definitions_of_listed_kinds(spark):
    rows = spark.createDataFrame([("a", "휴가의 종류는 연가 및 병가로 구분한다", "종류", 1), ("b", "내용", "병가", 0), ("c", "연가는 쉬는 것이다", "기타", 3), ("d", "다른 글", "보수", 4)], "id string, text string, article_title string, order_index int")
    scored = rows.filter("id in ('a', 'd')").withColumn("score", F.when(F.col("id") == "a", 5.0).otherwise(1.0))
    out = {r["id"]: r["score"] for r in search.promoted(scored, rows, "휴가의 종류").collect()}
    assert out["b"] >= 24 and out["a"] >= 29 and search.promoted(scored, rows, "휴가") is scored


def test_tables_by_name(spark):
    chunks = spark.createDataFrame([("d", "c1", "별표 1", ["수당표"], [["a"]]), ("d", "c2", "별표 2", None, [["b"]])], "document_id string, id string, label string, aliases array<string>, rows array<array<string>>")
    side = spark.createDataFrame([("d", "s1", "별표1", [["a"]]), ("d", "s2", "별표1", [["c"]])], "document_id string, id string, label string, rows array<array<string>>")
    assert {(r["id"], r["source"]) for r in search.tables_named(chunks, side, "d", "별표1").collect()} == {("c1", "chunk"), ("s2", "inventory")}
    assert [r["id"] for r in search.tables_named(chunks, side, "d", "수당표").collect()] == ["c1"]


def test_wrapped_rows(spark):
    rows = spark.createDataFrame([(1, 0, ["구분", "금액"]), (1, 1, ["긴 이름", "3원"]), (1, 2, ["", "부터"]), (1, 3, ["다음", "4원"])], "t int, row_no int, cells array<string>")
    out = [(r["cells"], r["flags"]) for r in tables.merged_wraps(rows, "t").orderBy("row_no").collect()]
    assert out == [(["구분", "금액"], []), (["긴 이름", "3원 부터"], ["wrapped_cell_merge"]), (["다음", "4원"], [])]


def test_cycles_by_walk_and_by_colour(spark):
    arcs = [(100, 101), (101, 102), (102, 100), (103, 103), (200, 201), (1, 2), (2, 1), (2, 100)]
    df = spark.createDataFrame(arcs, "a long, b long")
    walked = {tuple(x) for x in graph.cycles(df, "a", "b").select("node", "cycle_id", "size").collect()}
    coloured = {tuple(x) for x in graph.cycles(df, "a", "b", most=1).select("node", "cycle_id", "size").collect()}
    assert walked == coloured and walked == {(100, 100, 3), (101, 100, 3), (102, 100, 3), (103, 103, 1), (1, 1, 2), (2, 1, 2)}
    chain = [(i, i + 1) for i in range(200_000)] + [(200_000, 0)]
    assert len(graph.components_of(chain)) == 200_001


def test_running_numbers(spark):
    rows = spark.createDataFrame([("a" if i % 3 else "b", i, i % 5) for i in range(40)], "k string, o int, v int")
    got = {(x["k"], x["o"]): (x["n"], x["s"]) for x in numbering.running(numbering.running(rows, ["k"], ["o"], None, "n"), ["k"], ["o"], "v", "s").collect()}
    seen = {}
    for i in range(40):
        k = "a" if i % 3 else "b"
        n, s = seen.get(k, (0, 0))
        seen[k] = (n + 1, s + i % 5)
        assert got[k, i] == seen[k]
    runs = metadata.islands(spark.createDataFrame([("x", i) for i in [1, 2, 3, 5, 8, 9, 10, 11, 16, 17]], "k string, o long"), "k", "o", 4)
    assert sorted((x["first"], x["last"], x["n"]) for x in runs.collect()) == [(1, 3, 3), (5, 5, 1), (8, 11, 4), (16, 17, 2)]


def test_places_and_dates(spark):
    one = spark.createDataFrame([("제 3 조의 2 제1항 제 4 호 나목", "시행 2024. 3. 1. 그리고 2024. 9. 9. 개정")], "p string, t string")
    row = one.select(references.locator(F.col("p")).alias("p"), dates.near_dates(F.col("t"), dates.REVISED).alias("r"), dates.near_dates(F.col("t"), dates.IN_FORCE).alias("f"), text.answer_text(F.lit("경 우에 ①직원 <개정>")).alias("a")).first()
    assert tuple(row["p"]) == ("제3조의2", "제3조의2제1항제4호나목") and str(row["r"][0]) == "2024-09-09" and str(row["f"][0]) == "2024-03-01" and row["a"] == "경우에 ① 직원"


def test_decisions_are_recorded(spark):
    chunks = spark.createDataFrame([("d", "c", "t", "approved", "x", "a1", "kim", "2024", "h")], "document_id string, chunk_id string, tenant_id string, approval_status string, text string, approval_id string, approved_by string, approved_at string, approved_content_hash string")
    out, journal = governance.decided(chunks, "rejected", "r1", "lee", "2025", F.lit("h2"), "wrong table")
    assert out.first()["approval_id"] is None and out.first()["approval_status"] == "rejected" and journal.first()["reason"] == "wrong table"
    for bad in (("rejected", " "), ("maybe", "x")):
        with pytest.raises(ValueError):
            governance.decided(chunks, bad[0], "r", "l", "t", F.lit("h"), bad[1])
    events = spark.createDataFrame([("d", "c", "t", "a1", "h", "approved", "1"), ("d", "c", "t", "a1", "h", "approved", "2"), ("d", "c", "t", "a1", "h", "rejected", "2")], "document_id string, chunk_id string, tenant_id string, approval_id string, approved_content_hash string, decision string, at string")
    assert governance.journal_approved(chunks, events).count() == 0 and governance.journal_approved(chunks, events.filter("at = '1'")).count() == 1
    found = governance.scan(spark.createDataFrame([(1, "x010-1234-5678 call 010-1234-5678")], "id long, t string"), "id", "t").filter("rule_id = 'phone_number'").first()
    assert (found["start"], found["end"]) == (20, 33)


def test_damaged_runs():
    assert korean.damaged_spans("총칙(總則) 慤桥") == [(7, 9, False)]
    assert korean.damaged_spans("연봉 敤敱浫 지급") == [(3, 6, True)] and korean.damaged_spans("(慤桥)") == [] and korean.damaged_spans("慤") == []
