"""Layouts as data: rows of flattened tables, rules of an institution, refused rules, odd and long texts."""

import pytest

from statuta.operators import tablerows
from statuta.operators.tablerows import Layout, Rule


def rows_of(text, name):
    (found,) = [x for x in tablerows.checked_rules(tablerows.LAYOUTS, tablerows.RULES) if x[0].name == name]
    return tablerows.walked([x.strip() for x in text.split("\n") if x.strip()], *found)


def test_outline_clears_what_lies_below():
    assert rows_of("(1) 10원\n가. 앞일\n1. 갑부\n(1) 10원\n가. 을부\n(2) 20원 이상\n2. 병부\n(1) 계약", "outline_condition")[1] == [(3, ["갑부", "", "1", "10원"]), (5, ["갑부", "을부", "2", "20원 이상"]), (7, ["병부", "", "1", "계약"])]


def test_codes_use_both_lines():
    assert rows_of("가\nA1\n나\nB2\n다", "code_description")[1] == [(0, ["A1", "가"]), (2, ["B2", "나"])]
    assert rows_of("가\nA1\n※ 주", "code_description") == ([], [])  # one row is no table


def test_checklist_headers():
    assert rows_of("평가기준\n12\n점검 항목\n세부 내용\n문\n1개\n창\n2개\n3개", "vertical_checklist") == (["점검 항목", "세부 내용"], [(4, ["문", "1개"]), (6, ["창", "2개 3개"])])
    assert rows_of("평가기준\n항목\n문\n1개\n창\n2개\n틀\n3개", "vertical_checklist")[0] == ["항목", "문"]  # a line that ends in 기준 is a caption


def test_numbers_need_labels():
    assert list(tablerows.number_runs("1 2 갑 3 4 을 5 병 6 7 12345 8 9")) == [["갑", "3", "4"], ["병", "6", "7"]]
    assert list(tablerows.number_runs("- 1 2")) == [] == list(tablerows.number_runs(""))


def test_rules_of_an_institution(spark):
    layouts = [Layout("sanctions", ("비위", "정도", "처분"), least=1, needs=(0, 1))]
    rules = [Rule("sanctions", "", r"\[(.+)\]$", "set", 0, "in"), Rule("sanctions", "in", r"(경|중)\s+(\S+)$", "row", 1)]
    tables = spark.createDataFrame([(1, "경 견책\n[음주]\n경 감봉\n중 정직\n[도박]\n중 해임", None), (2, None, "form"), (3, "", "form")], "id long, t string, c string")
    found = tablerows.layout_rows(tables, "id", "t", "c", layouts, rules).orderBy("id", "row_no").collect()
    assert [(r["id"], r["line_no"], r["cells"]) for r in found] == [(1, -1, ["비위", "정도", "처분"]), (1, 2, ["음주", "경", "감봉"]), (1, 3, ["음주", "중", "정직"]), (1, 5, ["도박", "중", "해임"])]
    assert tablerows.layout_rows(tables.limit(0), "id", "t", "c").count() == 0


def test_refused_rules():
    for rule in (Rule("x", "", "(a)", "row"), Rule("code_description", "", "(a)", "jump"), Rule("code_description", "", "(a)(b)", "row", 1)):
        with pytest.raises(ValueError):
            tablerows.checked_rules(tablerows.LAYOUTS, [rule])


def test_long_texts(spark):
    """A line of 200,000 words and a table of 30,000 lines are read whole."""
    text = "가나 " * 200_000 + "1 2\n" + "\n".join(f"항{i} 1 2" if i % 2 else "가 나 3 4" for i in range(30_000))
    tables = spark.createDataFrame([(1, text, "table")], "id long, t string, c string")
    assert tablerows.layout_rows(tables, "id", "t", "c").count() == 30_001
