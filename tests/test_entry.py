"""The entry point with and without the llm subpackage, and every query that has SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from statuta.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rounded(value):
    if isinstance(value, float):
        return None if value != value else float(f"{value:.8g}")
    return str(value) if value is not None and not isinstance(value, (int, bool)) else value


def same(spark, name, run, sql):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = db.execute(sql)
    columns = sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(c) for c in columns]
    expected = sorted((tuple(rounded(r[i]) for i in order) for r in want.fetchall()), key=str)
    df = run(spark, SF)
    assert sorted(df.columns) == columns
    got = sorted((tuple(rounded(r[c]) for c in columns) for r in df.collect()), key=str)
    assert got == expected, name


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_is_its_sql(spark, name):
    same(spark, name, registry.queries()[name], registry.oracle_sql()[name])


def test_flagship(spark):
    assert entry.entry(spark).count() == 10


def test_entry_without_llm(monkeypatch):
    monkeypatch.setattr(entry, "has_llm", lambda: False)
    assert set(entry.queries()) == set(registry.queries()) and set(entry.oracle_sql()) == set(registry.oracle_sql())
