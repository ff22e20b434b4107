"""The versioned store and the segmented index: failures between any two steps, updates against a full build, what updates and searches touch."""

import random

import pytest
from pyspark.sql import functions as F

from statuta.operators import inverted, search
from statuta.operators.store import ConflictError, Store

SCHEMA = "id string, doc string, text string, regulation_title string, article_no string, content_hash string"


def records(spark, docs):
    """docs: {document: {id: text}}"""
    rows = [(i, d, t, f"규정 {d}", f"제{n}조", f"{i}-{t}") for d, chunks in docs.items() for n, (i, t) in enumerate(chunks.items())]
    return spark.createDataFrame(rows, SCHEMA)


def size(spark, store, names):
    return sum(store.files().getContentSummary(store.path(n.rpartition("/")[2])).getLength() for n in names)


def test_commit_is_one_step(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/store")
    assert store.read() is None and store.numbers() == []
    first = store.commit({"data": [], "what": "첫째"}, None)
    assert store.read() == first and first["number"] == 1
    with pytest.raises(ConflictError):  # another writer took the number
        store.commit({"data": [], "what": "late"}, None)
    assert store.read()["what"] == "첫째"
    monkeypatch.setattr(Store, "rename", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store.commit({"data": [], "what": "second"}, 1)
    monkeypatch.undo()
    assert store.read()["what"] == "첫째"
    assert [n for n in store.vacuum(older_than_s=0) if n.startswith("aside-")]  # left by the failure
    assert store.commit({"data": [], "what": "second"}, 1)["number"] == 2 and store.read(1)["what"] == "첫째"
    assert store.vacuum(keep=1) == ["manifest-000000001.json"] and store.numbers() == [2]


def test_a_build_that_fails_anywhere_leaves_the_old_version(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/index"
    rows = records(spark, {"d": {"a": "육아 휴직", "b": "출장 여비"}})
    search.build_index(rows, folder)
    old = search.Index.open(spark, folder).search("휴직").collect()
    for step in ("write_postings", "write_terms", "totals"):
        with monkeypatch.context() as m:
            m.setattr(inverted, step, lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
            with pytest.raises(RuntimeError):
                search.build_index(rows.filter("id = 'b'"), folder)
        assert search.current(spark, folder) == 1 and search.Index.open(spark, folder).search("휴직").collect() == old
    store = Store(spark, folder)
    assert len(store.vacuum(older_than_s=0)) == 3  # half-done data
    assert search.Index.open(spark, folder).search("휴직").collect() == old


def test_updates_equal_a_full_build(spark, tmp_path):
    r = random.Random(3)
    words = "휴직 수당 출장 여비 alpha beta 제3조 제3조의2 w1 w2 w3 w4".split()
    text = lambda: " ".join(r.choice(words) for _ in range(r.randrange(1, 9)))
    docs = {f"d{k}": {f"d{k}c{j}": text() for j in range(5)} for k in range(40)}
    folder = f"file://{tmp_path}/index"
    rows = records(spark, docs)
    search.build_index(rows, folder, group="doc")
    store = Store(spark, folder)
    whole = size(spark, store, store.read()["data"])
    query = "휴직 beta w3 제3조"
    for turn, touched in enumerate((["d1"], ["d2", "d99"], ["d3"])):
        before = inverted.fingerprint(rows)
        for d in touched:
            docs[d] = {} if d == "d3" else {f"{d}c{j}": text() for j in range(r.randrange(1, 7))}
        rows = records(spark, docs)
        groups = spark.createDataFrame([(d,) for d in touched], "grp string")
        assert search.update_index(folder, rows.filter(F.col("doc").isin(touched)), groups, rows, "doc", before_print=before)
        index = search.Index.open(spark, folder)
        assert index.fingerprint == inverted.fingerprint(rows)
        if turn == 0:
            assert size(spark, store, store.read()["data"][-1:]) < whole / 2
    fresh = f"file://{tmp_path}/fresh"
    search.build_index(rows, fresh, group="doc")
    want = sorted(map(tuple, search.Index.open(spark, fresh).search(query).collect()))
    assert sorted(map(tuple, index.search(query).collect())) == want
    made = inverted.compact(store)
    assert len(made["segments"]) == 5 and made["segments"][-1]["forward"] is None
    assert sorted(map(tuple, search.Index.open(spark, folder).search(query).collect())) == want
    # an index of other records is built anew
    assert not search.update_index(folder, rows.limit(0), groups, rows, "doc", before_print="0-0-0")
    assert sorted(map(tuple, search.Index.open(spark, folder).search(query).collect())) == want and len(store.read()["segments"]) == 1


def test_a_search_reads_only_its_buckets(spark, tmp_path):
    folder = f"file://{tmp_path}/catalog"
    chunks = records(spark, {f"d{k}": {f"d{k}c{j}": f"word{k} 제{j}조" for j in range(3)} for k in range(30)}).withColumn("version_id", F.col("doc"))
    versions = spark.createDataFrame([(f"d{k}", f"규정 {k}", "", "word3", "2024") for k in range(30)], "version_id string, title string, regulation_no string, search_text string, revision_date string")
    search.build_catalog(versions, chunks, folder, contents=chunks.select("id"), references=chunks.limit(0))
    body = search.BodyIndex.open(spark, folder)
    plan = body.matches(["word3"], ["제2조"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(bucket") == 2
    assert "GreaterThanOrEqual(term,제2조)" in plan and "LessThan(term,제2족)" in plan
    assert body.table("contents").count() == 90 and body.table("references").count() == 0
    found = lambda q, v: {x["id"] for x in body.body_scores(q, versions.filter(F.col("version_id").isin(v))).collect()}
    assert found("word3", ["d3", "d4"]) == {"d3c0", "d3c1", "d3c2"} and found("word3", ["d4"]) == set() and found("", ["d3"]) == set() and found("zz", ["d3"]) == set()
    assert found("제2조", ["d3", "d4"]) == {"d3c2", "d4c2"}
    with pytest.raises(ValueError):
        search.Index.open(spark, folder)


def test_least_records_are_searched(spark, tmp_path):
    rows = spark.createDataFrame([("a", "foo bar", "h1"), ("b", "bar", "h2"), ("c", None, None)], "id string, text string, content_hash string")
    search.build_index(rows, f"file://{tmp_path}/least")
    index = search.Index.open(spark, f"file://{tmp_path}/least")
    assert [x["id"] for x in search.cascade(rows, "인사규정 foo", index, 5).collect()] == ["a"]
    empty = f"file://{tmp_path}/empty"
    search.build_index(rows.limit(0), empty)
    none = search.Index.open(spark, empty)
    assert none.search("foo").count() == 0 and none.avg_len == 0.0 and search.cascade(rows.limit(0), "foo", none, 5).count() == 0


def test_parts_of_compounds():
    known = {"육아", "휴직", "수당", "휴직수당", "ab", "abc", "cd", "de", "12"}
    assert search.segments("육아휴직수당", known) == ("육아", "휴직", "수당")
    assert search.segments("abcde", known) == ("abc", "de")
    assert search.segments("xabcd", known) == ("ab", "cd") and search.segments("12", known) == () and search.segments("휴직수당", {"휴직수당"}) == ()
