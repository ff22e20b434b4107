"""The character model counts every document's words: unlabelled, held-out and unsampled ones too."""

from pyspark.sql import functions as F

from statuta.llm import toxicity


def test_trigrams_of_all_documents(spark, docs):
    rows = [(i, f"plain text {'xyzzy' if i >= 40 else ''}") for i in range(60)] + [(60, None), (61, "Xyzzy xyzzy q")]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    for most in (20_000, 5):
        counts = toxicity.train(docs(rows), labels, rows=most).chars.counts
        assert counts["xyz"] == counts["^^x"] == 21 and counts["pla"] == 60 and "^^q" not in counts


def test_no_trigram_is_cut(docs):
    many = docs([(i, " ".join(chr(0x4E00 + 50 * i + j) * 2 for j in range(50))) for i in range(300)])
    assert len(toxicity.char_model(many.withColumn("word", F.lit("clash"))).counts) == 3 * 15_000
