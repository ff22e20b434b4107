"""Units of records: long chains, rings, odd rows; components of awkward links."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from statuta.operators import graph, identity
from statuta.session import shared_folder

SCHEMA = "record_id string, document_id string, profile_id string, regulation_title string, regulation_no string, document_name string, canonical_title string, regulation_id string, supersedes_document_id string, lineage_date string"


def units(spark, rows, profile="p"):
    found = identity.identities(spark.createDataFrame(rows, SCHEMA), profile).collect()
    return {r["record_id"]: (r["title"], r["regulation_no"], r["unit_id"]) for r in found}


def row(k, title=None, number=None, name=None, canonical=None, stable=None, replaces=None, date=None, document=None, profile=None):
    return (f"r{k}", f"d{k}" if document is None else document, profile, title, number, name, canonical, stable, replaces, date)


def test_components_of_links(spark):
    r = random.Random(2)
    order = list(range(300))
    r.shuffle(order)
    links = list(zip(order, order[1:], strict=False)) + [(1000 + r.randrange(60), 1000 + r.randrange(60)) for _ in range(40)]
    nodes = sorted({x for link in links for x in link} | {5000})
    root = {n: n for n in nodes}

    def find(n):
        return n if root[n] == n else find(root[n])

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    folder = shared_folder(spark)
    found = graph.components(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(links, "a long, b long"), folder)
    assert {x["node"]: x["anchor"] for x in found.collect()} == {n: find(n) for n in nodes}


def test_titles_names_and_odd_rows(spark):
    rows = [
        row(1, "휴가", "3", name="휴가 규정"), row(2, None, None, name="여비규정"), row(3, "규정집", None, name="인사 규정집"), row(4), row(5, "보수규정", "2024-01-05"), row(6, "보수규정", "보수규정"),
        row(7, "복무규정", "5", document=""), row(8, "복무규정", "제5호", profile="P"), row(8, "복무규정", "제5호", profile="P"), row(9, "복무규정", "5", profile="p "),
    ]
    found = units(spark, rows)
    assert found["r1"][:2] == ("휴가 규정", "3") and found["r2"][:2] == ("여비규정", "") and found["r3"][0] == "규정집" and found["r4"][:2] == ("", "")
    assert found["r5"][1] == found["r6"][1] == "" and found["r5"][2] == found["r6"][2] and "r7" not in found
    assert found["r8"][2] == found["r9"][2] and found["r8"][1] == "제5호"
    assert units(spark, []) == {}


def test_an_id_that_several_documents_share(spark):
    # one id, renamed each year, joined with an older one by name: all are one unit, the earliest's
    rows = [row(1, "직제규정", "1", stable="A", date="2020-01-01"), row(2, "조직규정", "1", stable=" a ", date="2021-01-01"), row(3, "조직규정", "1", date="2022-01-01"), row(4, "조직 및 정원 규정", "1", replaces="d3", date="2023-01-01")]
    found = units(spark, rows)
    assert len({u for _, _, u in found.values()}) == 1
    # a replacement's root goes before dates: the unit is that of r3, not of the earliest
    own = "title:조직규정\nno:1"
    assert found["r1"][2] == "regunit-" + hashlib.sha256(f"p\n{own}".encode()).hexdigest()[:20]


@pytest.mark.parametrize("n", [120])
def test_long_chain_takes_few_rounds(spark, monkeypatch, n):
    rows = [row(k, f"이름{k}규정", str(k), replaces=f"d{k - 1}" if k else None) for k in range(n)]
    written, steps = graph.written, []
    monkeypatch.setattr(graph, "written", lambda df, folder, name: steps.append(name) or written(df, folder, name))
    found = units(spark, rows)
    assert len({u for _, _, u in found.values()}) == 1
    assert max(int(s[6:]) for s in steps if s.startswith("labels")) <= 12
