"""Titles, dates, versions and predecessors of new files, with odd names and texts."""

from pyspark.sql import functions as F

from statuta.operators import intake

FILES = "file_id string, filename string, text string, profile_id string, tenant_id string"
DOCS = "document_id string, document_name string, filename string, regulation_id string, regulation_version string, regulation_status string, effective_from string, revision_date string, created_at string, profile_id string, tenant_id string"


def test_names(spark):
    names = {
        "3-1. 인사규정(20240105).pdf": "인사규정", "취업규칙_v2 최종본.hwp": "취업규칙", "보수규정 2.hwp": "보수규정", "제2차 일부개정 여비규정 (3).docx": "여비규정", "복무규정 2024. 1. 5. 개정본.pdf": "복무규정",
        "2024.pdf": "2024", "": "regulation", "20240105.pdf": "20240105", "dir/sub\\정관.final.hwp": "정관", "Travel Policy latest.docx": "Travel Policy",
    }
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r["n"]: r["t"] for r in rows.select("n", intake.name_title(F.col("n")).alias("t")).collect()} == names
    dates = {"a 240102 20231231 2022-3-4.pdf": ["2024-01-02", "2023-12-31", "2022-03-04"], "x 991231 20241399.hwp": ["1999-12-31"], "1234567.hwp": [], "a20240101b20240101": ["2024-01-01"]}
    rows = spark.createDataFrame([(n,) for n in dates], "n string")
    assert {r["n"]: [str(d) for d in r["d"]] for r in rows.select("n", intake.name_dates(F.col("n")).alias("d")).collect()} == dates
    long = "가" * 80 + "규정"
    made = spark.createDataFrame([(long,), ("Travel  Policy!",), ("…",)], "t string").select(intake.regulation_id(F.col("t")).alias("i")).collect()
    assert len(made[0]["i"]) == 4 + 64 and made[1]["i"] == "reg-travel-policy" and made[2]["i"].startswith("reg-") and len(made[2]["i"]) == 20


def test_text_goes_before_the_name(spark):
    text = "제정 2020. 1. 1.\n- 취업 규칙 -\n개정 2021. 2. 3.\n제1조(목적) 규정\n부칙\n이 규칙은 2022. 5. 1.부터 시행한다."
    rows = spark.createDataFrame([("a", "scan.pdf", text, None, None), ("b", None, None, None, None), ("c", "정관_v3.hwp", "제4차 개정\nv7", "", None)], FILES)
    found = {r["file_id"]: r for r in intake.inferred(rows, spark.createDataFrame([], DOCS), "2025-01-01").collect()}
    a = found["a"]
    assert (a["document_name"], a["title_source"], a["revision_date"], a["effective_from"], a["regulation_version"]) == ("취업 규칙", "content", "2021-02-03", "2022-05-01", "rev-20210203")
    assert (found["b"]["document_name"], found["b"]["revision_date"], found["b"]["regulation_version"], found["b"]["version_source"]) == ("regulation", "2025-01-01", "v1", "sequence")
    assert found["c"]["regulation_version"] == "rev-4" and found["c"]["version_source"] == "content" and found["c"]["supersedes_document_id"] is None


def test_predecessors_by_scope(spark):
    docs = [
        ("d1", "인사규정", None, None, "v1", "approved", "2020-01-01", None, "1", "p1", "t"), ("d2", "인사규정 개정본", None, None, "v2", "approved", "2021-01-01", None, "2", "p1", None),
        ("d3", None, "인사규정_2023.hwp", None, "v10", "approved", "2021-01-01", None, "1", "p2", "t"), ("d4", "other", None, "reg-인사규정", "v4", "draft", "2029-01-01", None, "1", "p1", "t"),
    ]
    files = [("f1", "인사규정.hwp", None, "P1", None), ("f2", "인사규정.hwp", None, None, None), ("f3", "인사규정.hwp", None, "p1", "T"), ("f4", "인사규정.hwp", None, "p9", None), ("f5", "여비규정.hwp", None, None, None)]
    found = {r["file_id"]: (r["supersedes_document_id"], r["regulation_version"]) for r in intake.inferred(spark.createDataFrame(files, FILES), spark.createDataFrame(docs, DOCS), "2025-01-01").collect()}
    assert found == {"f1": ("d2", "v5"), "f2": ("d3", "v11"), "f3": ("d1", "v5"), "f4": (None, "v1"), "f5": (None, "v1")}
