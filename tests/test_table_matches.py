"""Sidecar tables matched to chunks: one result by all ways, and no side of a join gathered in the driver."""

import random

from pyspark.sql import functions as F

from statuta.operators import tables


def test_every_way_matches_alike(spark):
    r = random.Random(9)
    words = ["구분", "금액", "alpha", "beta", "gamma", "x", "12", "3.5원", "delta"]
    text = lambda: " ".join(r.choices(words, k=r.randrange(0, 5)))
    chunks = spark.createDataFrame([(i % 4, i, text(), i % 2) for i in range(60)], "d int, chunk_id int, text string, page int")
    side = spark.createDataFrame([(i % 5, i, text(), r.choice(["structured_table_candidate", "other"]), i % 3) for i in range(40)], "d int, table_id int, sample string, label string, page int")
    pairs = chunks.withColumnRenamed("page", "pa").join(side.withColumnRenamed("page", "pb"), "d").filter(F.arrays_overlap(tables.match_terms(F.col("text")), tables.match_terms(F.col("sample"))))
    pairs = pairs.withColumn("score", tables.match_score(F.col("text"), F.col("sample"), F.col("pa") == F.col("pb")))
    want = {}
    for p in pairs.collect():
        want[p["chunk_id"]] = max(want.get(p["chunk_id"], (-1,)), (p["score"], p["table_id"]))
    assert len(want) > 20
    for most in (0, 5, 64):
        got = tables.best_tables(chunks, side, "d", most)
        assert {g["chunk_id"]: (g["score"], g["table_id"]) for g in got.collect()} == want
        assert "Broadcast" not in got._jdf.queryExecution().sparkPlan().toString()
