"""Contexts, laws by another word, definitions and edges without input."""

from statuta.operators import relations

CHUNK = "document_id string, chunk_id string, chunk_order int, regulation string, article_no string, article_title string, chunk_type string, page_start int, page_end int, text string, article_refs array<string>, regulation_refs array<string>, law_refs array<string>"


def chunk(n, text, refs=None, kind="paragraph", page=1, document="d", regulation="갑규정", article=None):
    return (document, f"{document}{n}", n, regulation, article, None, kind, page, page, text, refs, None, None)


def edges(spark, rows):
    found = relations.relation_edges(spark.createDataFrame(rows, CHUNK)).collect()
    assert len({e["edge_id"] for e in found}) == len(found)
    return {(e["chunk_id"], e["relation_type"], e["target_label"], e["confidence"]) for e in found}


def test_contexts(spark):
    rows = [
        chunk(0, "「을규정」 제1조와 「병규정」 제2조", page=1),  # two regulations: no context
        chunk(1, "", ["제9조"], page=1),
        chunk(2, "「을규정」 제1조", page=1),
        chunk(3, "", ["제9조"], page=4),
        chunk(4, "", ["제9조"], page=5),  # too far back
        chunk(5, "「갑규정」 제3조", page=6),
        chunk(6, "", ["제9조"], page=6),  # the context is the own regulation
        chunk(0, "「을규정」 제1조", regulation="정규정", document="e"), chunk(1, "", ["제9조"], document="e"),
    ]
    found = {(c, label, confidence) for c, _, label, confidence in edges(spark, rows) if label.endswith("제9조")}
    assert found == {("d1", "을규정 제9조", 0.68), ("d3", "을규정 제9조", 0.72), ("d4", "갑규정 제9조", 0.6), ("d6", "갑규정 제9조", 0.6), ("e1", "갑규정 제9조", 0.6)}


def test_law_contexts(spark):
    rows = [
        chunk(0, "「소득세법」 제5조 및 「을규정」 제1조에 따라 제6조", ["제6조"], "form"),  # a regulation stands between
        chunk(1, "「소득세법」 제5조와 제6조", ["제6조"], "paragraph", document="f"),  # only forms and appendices
        chunk(2, "민법 제2조, 「동법」 제3조, 「동시행령」 제4조", ["제2조"]),
        chunk(3, "「동법」 제3조"),  # nothing before it
    ]
    found = edges(spark, rows)
    assert {(c, label) for c, _, label, _ in found if label.endswith("제6조")} == {("d0", "을규정 제6조"), ("f1", "갑규정 제6조")}
    assert {(label, confidence) for c, _, label, confidence in found if c == "d2"} == {("민법 제2조", 0.78), ("민법 제3조", 0.9), ("민법 시행령 제4조", 0.9)}
    assert {(kind, label) for c, kind, label, _ in found if c == "d3"} == {("chunk_cites_law_article", "동법 제3조")}


def test_definitions(spark):
    rows = [chunk(0, "제1조(목적) 한다"), chunk(1, "이것은 매우 긴 문장 안에서 제2조(범위)를 말함"), chunk(2, "이것은 매우 긴 문장이다. 제3조(정의) 뜻"), chunk(3, "제4조(기간) 날", kind="article"), chunk(4, "제5조(기간) 날", article="제5조")]
    assert {label for _, kind, label, _ in edges(spark, rows) if kind == "chunk_defines_inline_article"} == {"갑규정 제1조", "갑규정 제3조"}


def test_nothing(spark):
    assert edges(spark, []) == set()
    assert edges(spark, [("d", None, None, None, None, None, None, None, None, None, [None, " "], [None], [])]) == set()
