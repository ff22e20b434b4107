"""Readers, writers and streams on small files."""

import json
import zipfile

from pyspark.sql import functions as F

from statuta.functions import dates, text
from statuta.operators import lifecycle, structure
from statuta.sources import readers, writers
from statuta.streaming import jobs


def test_reads_docx_hwpx_and_rejects_the_rest(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = f"<w:document {w}><w:body><w:p><w:r><w:t>제1조 목적</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", body)
    with zipfile.ZipFile(tmp_path / "b.hwpx", "w") as z:
        z.writestr("Contents/section0.xml", '<s xmlns:h="x"><h:p><h:run><h:t>본문</h:t></h:run></h:p></s>')
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        z.writestr("word/document.xml", '<!DOCTYPE x [<!ENTITY a "b">]><x/>')
    (tmp_path / "d.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "e.md").write_text("one\n\ntwo")
    rows = readers.read_documents(spark, str(tmp_path)).collect()
    by = {}
    for r in rows:
        by.setdefault(r["path"].rpartition("/")[2], []).append(r)
    assert [(r["block_type"], r["text"]) for r in by["a.docx"]] == [("text", "제1조 목적"), ("table", "a | b")]
    assert [r["text"] for r in by["b.hwpx"]] == ["본문"] and [r["text"] for r in by["e.md"]] == ["one", "two"]
    assert by["c.docx"][0]["error"] and by["d.pdf"][0]["error"]


def test_record_lines_are_validated(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text("\n".join(['{"id": "a", "text": "x"}', '{"id": "b"}', "{broken"]))
    rows = readers.read_records(spark, str(tmp_path / "r.jsonl"), "id string, text string", ["id", "text"]).collect()
    assert [r["line_error"] for r in rows] == [None, "missing text", "malformed"]


def test_export_shapes(spark):
    chunks = spark.createDataFrame([("d", 2, "B", "two"), ("d", 1, "A", "x | y")], "doc string, pos int, title string, text string")
    assert writers.to_markdown(chunks, "doc", "pos", "title", "text").first()["markdown"] == "## A\n\nx | y\n\n## B\n\ntwo"
    assert writers.table_rows(chunks, "pos", "text").first()["cells"] == ["x", "y"]
    row = spark.range(1).select(writers.pgvector_row(F.lit("k"), F.array(F.lit(0.5), F.lit(1.0)), F.lit("t")).alias("j")).first()["j"]
    assert json.loads(row) == {"id": "k", "content": "t", "embedding": "[0.5,1.0]"}


def test_korean_dates_and_structure(spark):
    body = "제1장 총칙\n제1조(목적) 이 규정은\n① 첫째\n1. 항목\n가. 세목\n제2조(정의) 뜻은\n이어지는 줄\n부칙\n2026. 1. 1.부터 시행"
    d = spark.createDataFrame([(1, body)], "doc_id long, text string")
    nodes = structure.nodes_of(structure.classified(structure.lines_of(d, "doc_id", "text")), "doc_id").orderBy("node").collect()
    assert [n["node_type"] for n in nodes] == ["chapter", "article", "paragraph", "item", "subitem", "article", "supplementary"]
    assert [n["parent"] for n in nodes] == [None, 1, 2, 3, 4, 1, None]
    assert nodes[5]["text"].endswith("이어지는 줄")
    far = structure.ancestors(structure.nodes_of(structure.classified(structure.lines_of(d, "doc_id", "text")), "doc_id"), "doc_id")
    assert {(r["ancestor"], r["distance"]) for r in far.filter("node = 5").collect()} == {(4, 1), (3, 2), (2, 3), (1, 4)}
    one = spark.createDataFrame([("2026. 1. 1.부터 시행", "규정_20240305_v2", "제3조의2의 개정규정은 2025년 3월 1일부터 시행한다")], "a string, b string, c string")
    r = one.select(dates.effective_date(F.col("a")).alias("a"), dates.filename_dates(F.col("b")).alias("b"), dates.article_overrides(F.col("c")).alias("c")).first()
    assert r["a"] == "2026-01-01" and str(r["b"][0]) == "2024-03-05"
    assert (r["c"][0]["article"], str(r["c"][0]["effective"])) == ("제3조의2", "2025-03-01")


def test_normalize(spark):
    raw = "a\u00a0b\u200b\r\n\r\n\r\n\r\nc \x01 d\n   \uf081e  \n"
    assert spark.createDataFrame([(raw,)], "t string").select(text.normalize(F.col("t")).alias("t")).first()["t"] == "a b\n\nc d\n①e"


def test_windows_cover_the_text():
    body = "word " * 1000
    spans = structure.char_windows(body, 180, 12)
    assert spans[0][0] == 0 and spans[-1][1] == len(body) and all(b - a <= 180 for a, b in spans) and all(y[0] <= x[1] for x, y in zip(spans, spans[1:]))


def test_versions_in_force(spark):
    rows = [("r1", 1, "2024-01-01", "2025-12-31", None), ("r1", 2, "2026-01-01", None, None), ("r1", 3, "2027-01-01", None, None), ("r2", 1, "2020-01-01", None, "2026-07-01")]
    v = spark.createDataFrame(rows, "unit string, version int, start string, stop string, repealed string")
    v = v.select("unit", "version", *[F.col(c).cast("date").alias(c) for c in ("start", "stop", "repealed")])
    live = lifecycle.latest_in_force(v, "unit", F.lit("2026-07-01").cast("date"), "start", F.col("stop"), F.col("repealed"), [F.desc("start")])
    assert [(r["unit"], r["version"]) for r in live.collect()] == [("r1", 2)]


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([(i, f"2024-01-01 0{i % 5}:00:00", i % 3, "click", 1.0) for i in range(30)], "event_id long, ts string, user_id long, event_type string, value double")
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(str(tmp_path / "events"))
    stream = jobs.event_stream(spark, str(tmp_path / "events"))
    jobs.run_once(jobs.first_events(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 30
    spark.createDataFrame([(1, "a b a"), (2, "b")], "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "docs"))
    jobs.index_batches(docs, str(tmp_path / "index"), str(tmp_path / "cp2"))
    assert sorted((r["doc_id"], r["term"], r["tf"]) for r in spark.read.parquet(str(tmp_path / "index")).collect()) == [(1, "a", 2), (1, "b", 1), (2, "b", 1)]
