"""Cycles of a graph whose arcs mostly lead nowhere, by every bound on what is walked."""

import random

from statuta.operators import graph


def test_bounds_do_not_change_cycles(spark, monkeypatch):
    r = random.Random(4)
    arcs = {(i, i + 1) for i in range(100, 160)} | {(1, 2), (2, 3), (3, 1), (3, 100), (7, 8), (8, 7), (50, 50), (8, 50)} | {(r.randrange(200, 230), r.randrange(200, 230)) for _ in range(40)}
    rows = spark.createDataFrame([(s, a, b) for s in ("x", "y") for a, b in arcs if s == "x" or a < 100], "s string, a long, b long")
    rounds, write = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, folder, name: rounds.append(name) or write(df, folder, name))
    want = {(s, *x) for s in ("x", "y") for x in graph.components_of([(a, b) for a, b in arcs if s == "x" or a < 100])}
    for most in (len(arcs) - 4, 10_000):
        rounds.clear()
        assert {tuple(x) for x in graph.cycles(rows, "a", "b", "s", most).select("s", "node", "cycle_id", "size").collect()} == want
        if most < len(arcs):  # a few rounds take it under the bound; the chain alone would take sixty
            assert any(x.startswith("trim") for x in rounds) and len(rounds) < 15
