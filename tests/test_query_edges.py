"""Queries against their SQL on rows that the given tables do not have."""

import random

import duckdb

from statuta.operators import metadata
from statuta.plans import registry


def same(spark, path, name, **tables):
    """Runs a query over tables (rows, schema) and holds it against its SQL, row by row."""
    db = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{t}.parquet")
        db.execute(f"create view {t} as select * from '{path}/{t}.parquet/*.parquet'")
    want = db.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    expected = sorted(map(str, want.fetchall()))
    assert sorted(str(tuple(r[c] for c in columns)) for r in registry.queries()[name](spark, str(path)).collect()) == expected and expected


DOCUMENTS = "doc_id long, text string"


def test_structure_nodes_of_odd_lines(spark, tmp_path):
    texts = [
        "first\n28.68.191.238 is an address\nlast\n1.5 times\n(가) no\n2024. 1. 5. day", "관련 규정\n제5조 own\n가. no\n제3항 및\n1-2-3. book\n부칙", "\n12)x\n제 7 호 x\n　\n\xa0\nlast",
        "a\rb\n12.\rb\n(1)\rc\n\x0b3. x", None, "", "\n\n", "3.\n4. \n①\n㉑\n제1장 x\n[별표 1] y",
    ]
    same(spark, tmp_path, "structure_nodes", documents=(list(enumerate(texts)), DOCUMENTS))


def test_version_diff_of_empty_texts_and_repeated_ids(spark, tmp_path):
    rows = [(1, ""), (2, "x"), (3, None), (5, ""), (7, ""), (8, "ab"), (8, "a"), (8, "abc"), (8, "abcd"), (8, None), (10, "a"), (10, "a"), (14, "b"), (14, ""), (35, ""), (None, ""), (9, "😀"), (11, "e\u0301")]
    same(spark, tmp_path, "version_diff", documents=(rows, DOCUMENTS))


def test_counts_in_spans_without_pairs(spark):
    r = random.Random(2)
    points = [(r.randrange(3), r.randrange(40)) for _ in range(300)] + [(None, 3), (1, None)]
    spans = [(r.randrange(4), i, r.randrange(45), r.randrange(45)) for i in range(60)]
    got = metadata.counted_in_spans(spark.createDataFrame(points, "k int, at int"), spark.createDataFrame(spans, "k int, s int, a int, b int"), "k", "at", "a", "b", "s")
    counts = {s: sum(p[0] == k and p[1] is not None and a <= p[1] <= b for p in points) for k, s, a, b in spans}
    assert {x["s"]: x["n"] for x in got.collect()} == {s: n for s, n in counts.items() if n}
