"""Operator 11 against a plain version, with nulls, ties, repeated rows, long texts and clashing columns."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from statuta.llm import lines

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(UPPER)


def plain(rows, documents=2, chars=10):
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    least = {k: min(v, key=lambda i: (i is None, i or 0)) for k, v in holders.items()}
    out = []
    for i, t in rows:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if not (len(key(x)) >= chars and len(holders[key(x)]) >= documents and least[key(x)] != i)]
        out.append((i, "\n".join(kept), len(all_lines), len(all_lines) - len(kept)))
    return sorted(out, key=str)


def rows():
    r = random.Random(2)
    pool = ["Licensed under the terms", " licensed UNDER the terms\t", "ÄÖÜ große Straße", "äöü große strasse", "ÄÖÜ GROßE STRAßE", "short", "İstanbul Ünite 12345", "exactly10!", "Exactly10!", "nine 9999"]
    out = [(i, "\n".join(r.choice(pool) if r.random() < 0.6 else f"own line {i} {r.random()}" for _ in range(r.randrange(1, 12)))) for i in range(3, 60)]
    out += [(1, None), (2, ""), (None, "Licensed under the terms\nonly without id"), (None, "only without id\nExactly10!"), (7, out[4][1]), (7, out[4][1]), (7, "other text\nLicensed under the terms")]
    return [*out, (70, "\n\n\n"), (71, "licensed under the terms"), (72, "long " * 50_000 + "\n" + "exactly10!"), (73, "\n".join(["exactly10!", "x"] * 3000)), (-5, "EXACTLY10!")]


@pytest.mark.parametrize(("documents", "chars"), [(2, 10), (4, 10), (1, 3)])
def test_lines_against_plain_version(docs, documents, chars):
    d = docs(rows()).withColumn("places", F.lit(1)).withColumn("h", F.lit("x")).withColumn("a.b", F.lit(0)).repartition(5)
    found = lines.dedup_lines(d, documents, chars)
    assert sorted(map(tuple, found.collect()), key=str) == plain(rows(), documents, chars)
    assert lines.dedup_lines(d.limit(0)).count() == 0


def test_no_python_and_no_line_is_shuffled(docs, spark):
    d = docs(rows())
    plan = lines.dedup_lines(d)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    shuffled = lines.exploded(d.select("doc_id", "text"), 10)
    assert shuffled.columns == ["doc_id", "version", "place", "h", "g"]


def test_query_of_line_dedup(spark, tmp_path, docs):
    docs(rows()).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, lines.op11_line_dedup(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(((i, n, gone, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, gone in plain(rows())), key=str)
