"""The pipeline against what its stages should do to a small corpus whose answers are known."""

import random

import corpus_pipeline
from statuta.llm.secrets import redact_text

WORDS = "the of and to rain river stone light walk green seven under house paper cloud".split()


def text(seed, n=60):
    r = random.Random(seed)
    words = [r.choice(WORDS) + ("" if r.random() < 0.8 else str(r.randrange(99))) for _ in range(n)]
    return " ".join(["the", *words[1:12], "of", *words[13:24], "and", *words[25:36], "to", *words[37:48], "the", *words[49:]])


def corpus():
    r, rows, marks = random.Random(2), [], []
    for i in range(240):
        words = text(i).split()
        if i % 4 == 0:
            words[r.randrange(60)] = r.choice(["idiot", "moron"])
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(i % 4 == 0)))
    rows += [(500, "short text"), (501, None), (502, ""), (503, " ".join(w + "###" for w in text(503).split())), (504, "a b c d e f g h the " * 20)]
    rows += [(600, rows[1][1]), (601, rows[2][1].upper()), (602, " ".join(["new", *rows[3][1].split()[1:]]))]
    rows += [(700, text(700) + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ' + text(701)), (None, text(800))]
    return rows, marks


def test_pipeline(spark, docs, tmp_path):
    rows, marks = corpus()
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {i for i, _ in rows if i is None or i < 240 and i % 4 or i == 700}
    want = {i: len(redact_text(t).split()) for i, t in rows if i in kept}
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want


def test_stages_keep_the_columns_of_documents(spark, docs, tmp_path):
    rows, marks = corpus()
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, d, str(tmp_path))
        assert out.columns == d.columns and dict(out.dtypes) == dict(d.dtypes)
    assert corpus_pipeline.secret_scans(spark, d, str(tmp_path)).filter("text like '%04dbebab%'").count() == 0
    empty = d.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
