"""Retrieval, catalog, vector and evaluation operators bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statuta.operators import retrieval
from statuta.session import table


def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for a two-term query (a top-k report)."""
    scores = retrieval.bm25(table(spark, sf_dir, "documents"), "the que")
    return scores.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(10)


BM25_CTE = r"""
t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS toks FROM documents),
c AS (SELECT doc_id, len(toks) AS n, len(list_filter(toks, lambda x: x = 'the')) AS a, len(list_filter(toks, lambda x: x = 'que')) AS b FROM t),
s AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM c),
r AS (SELECT doc_id, ln(1 + (docs - da + 0.5) / (da + 0.5)) * a * 2.5 / (a + 1.5 * (0.25 + 0.75 * n / mean)) + ln(1 + (docs - db + 0.5) / (db + 0.5)) * b * 2.5 / (b + 1.5 * (0.25 + 0.75 * n / mean)) AS score FROM c, s)"""
BM25_SQL = f"WITH {BM25_CTE} SELECT doc_id, round(score, 6) AS score FROM r WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10"
BM25_ALL_SQL = f"WITH {BM25_CTE} SELECT doc_id, round(score, 6) AS score FROM r WHERE score > 0"


def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25(table(spark, sf_dir, "documents"), "the que").select("doc_id", F.round("score", 6).alias("score"))


def bm25_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency and occurrences of every term of the corpus."""
    entries = retrieval.postings(table(spark, sf_dir, "documents"), "doc_id", "text")
    return entries.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


CORPUS_SQL = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')) AS term FROM documents)
SELECT term, count(DISTINCT doc_id)::BIGINT AS df, count(*)::BIGINT AS cf FROM t GROUP BY term"""


def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the hash embedding of every document."""
    entries = retrieval.postings(table(spark, sf_dir, "documents"), "doc_id", "text")
    return retrieval.hash_embedding(entries, "doc_id").select("doc_id", "bucket", F.round("weight", 6).alias("weight"))


EMBEDDING_SQL = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents),
h AS (SELECT doc_id, ('0x' || substr(sha256(term), 1, 8))::UBIGINT % 384 AS bucket, CASE WHEN ('0x' || substr(sha256(term), 9, 2))::UBIGINT % 2 = 0 THEN 1 ELSE -1 END AS s FROM t),
c AS (SELECT doc_id, bucket, sum(s) AS v FROM h GROUP BY ALL HAVING sum(s) <> 0),
n AS (SELECT doc_id, sqrt(sum(v * v)) AS norm FROM c GROUP BY doc_id)
SELECT doc_id, bucket::BIGINT AS bucket, round(round(v / norm, 8), 6)::DOUBLE AS weight FROM c JOIN n USING (doc_id)"""


def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    scored = retrieval.vector_search(rows, rows.filter("vec_id = 0"), "vec_id", "embedding")
    return scored.select("vec_id", F.round("score", 5).alias("score"))


VECTOR_SQL = """SELECT e.vec_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"""


def embedding_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.transform("embedding", lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(e, F.lit(0.0), lambda s, x: s + x * x))
    ok = (F.size("embedding") == 64) & ~F.exists(e, lambda x: F.isnan(x) | x.isNull()) & (F.abs(norm - 1) < 1e-3)
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.count_if(ok).alias("n_ok"))


INTEGRITY_SQL = """SELECT label, count(*)::BIGINT AS n, (count(*) FILTER (len(embedding) = 64 AND len(list_filter(embedding, lambda x: isnan(x) OR x IS NULL)) = 0
AND abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) < 1e-3))::BIGINT AS n_ok FROM embeddings GROUP BY label"""


def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", retrieval.lexical_score(F.col("text"), ["license", "and", "de"]).cast("long").alias("lexical"), retrieval.literal_score(F.col("text"), "the license").cast("long").alias("literal"))


LEXICAL_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS toks, regexp_replace(lower(text), '\s+', '', 'g') AS low FROM documents)
SELECT doc_id, (least(5, len(list_filter(toks, lambda x: x = 'license'))) + least(5, len(list_filter(toks, lambda x: x = 'and'))) + least(5, len(list_filter(toks, lambda x: x = 'de'))))::BIGINT AS lexical,
((CASE WHEN contains(low, 'thelicense') THEN 10 ELSE 0 END) + (CASE WHEN contains(low, 'the') THEN 2 ELSE 0 END) + (CASE WHEN contains(low, 'license') THEN 2 ELSE 0 END))::BIGINT AS literal FROM t"""


def catalog_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as regulations: name the title, brand the number."""
    part = table(spark, sf_dir, "part")
    score = retrieval.catalog_score(F.col("p_name"), F.col("p_brand"), "brand#12 part")
    return part.select("p_partkey", score.cast("long").alias("score")).filter("score > 0")


CATALOG_SQL = """SELECT p_partkey, score::BIGINT AS score FROM (SELECT p_partkey, (CASE WHEN contains(lower(p_name), 'brand#12 part') OR contains('brand#12 part', lower(p_name)) THEN 100 ELSE 0 END)
+ (CASE WHEN lower(p_brand) <> '' AND contains('brand#12 part', lower(p_brand)) THEN 80 ELSE 0 END) + (CASE WHEN contains(lower(p_name), 'brand#12') THEN 24 ELSE 0 END) + (CASE WHEN contains(lower(p_brand), 'brand#12') THEN 18 ELSE 0 END)
+ (CASE WHEN contains(lower(p_name), 'part') THEN 24 ELSE 0 END) + (CASE WHEN contains(lower(p_brand), 'part') THEN 18 ELSE 0 END) AS score FROM part) WHERE score > 0"""


def retrieval_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and MRR: query = a source's label-1 documents, ranked by length within the source."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    order = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    ranked = d.select(F.col("source").alias("query_id"), F.col("doc_id").alias("item_id"), F.row_number().over(order).alias("rank")).filter("rank <= 10")
    relevant = d.join(labels.filter("toxic = 1"), "doc_id").select(F.col("source").alias("query_id"), F.col("doc_id").alias("item_id"))
    out = retrieval.recall_and_mrr(ranked, relevant)
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


QUALITY_SQL = """
WITH ranked AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 10),
rel AS (SELECT DISTINCT source, doc_id FROM documents JOIN labels USING (doc_id) WHERE toxic = 1),
per AS (SELECT source, count(*) AS n, count(*) FILTER (rank <= 1) AS h1, count(*) FILTER (rank <= 3) AS h3, count(*) FILTER (rank <= 5) AS h5, min(rank) AS f FROM rel LEFT JOIN ranked USING (source, doc_id) GROUP BY source)
SELECT round(sum(h1) / sum(n), 9) AS recall_at_1, round(sum(h3) / sum(n), 9) AS recall_at_3, round(sum(h5) / sum(n), 9) AS recall_at_5, round(avg(coalesce(1 / f, 0)), 9) AS mrr FROM per"""


def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles of event values for each type."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.expr("percentile_disc(0.5) within group (order by value)").alias("p50"),
        F.expr("percentile_disc(0.95) within group (order by value)").alias("p95"),
        F.max("value").alias("most"),
        F.round(F.avg("value"), 6).alias("mean"),
    )


LATENCY_SQL = """SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS most, round(avg(value), 6) AS mean FROM events GROUP BY event_type"""


def incremental_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequencies after documents of one source were replaced by their upper half: untouched postings stay, changed ones are recounted."""
    d = table(spark, sf_dir, "documents")
    changed = d.filter("source = 'src1'").select("doc_id", F.expr("substring(text, 1, cast(length(text) / 2 as int))").alias("text"))
    stored = retrieval.postings(d, "doc_id", "text")
    fresh = stored.join(changed.select("doc_id"), "doc_id", "left_anti").unionByName(retrieval.postings(changed, "doc_id", "text"))
    return retrieval.document_frequencies(fresh)


INCREMENTAL_SQL = r"""
WITH d AS (SELECT doc_id, CASE WHEN source = 'src1' THEN substr(text, 1, length(text) // 2) ELSE text END AS text FROM documents),
t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM d)
SELECT term, count(DISTINCT doc_id)::BIGINT AS df FROM t GROUP BY term"""


def extractive_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best sentence of every assistant turn for its user's question: most shared words, then the first."""
    c = table(spark, sf_dir, "conversations")
    words = lambda x: F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(r"([\p{L}\p{N}_]+)"), 1))
    asked = c.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), words(F.col("text")).alias("q"))
    told = c.filter("role = 'assistant'").select("conv_id", "turn", F.posexplode(F.split("text", r"[.?!]\s*")).alias("pos", "sentence"))
    met = told.join(asked, ["conv_id", "turn"]).select("conv_id", "turn", "pos", F.size(F.array_intersect(words(F.col("sentence")), F.col("q"))).alias("shared"))
    best = met.groupBy("conv_id", "turn").agg(F.min(F.struct(-F.col("shared"), "pos")).alias("b"))
    return best.select("conv_id", "turn", F.col("b.pos").cast("long").alias("pos"), (-F.col("b.col1")).cast("long").alias("shared"))


EVIDENCE_SQL = r"""
WITH q AS (SELECT conv_id, turn + 1 AS turn, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS q FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn, string_split_regex(text, '[.?!]\s*') AS s FROM conversations WHERE role = 'assistant'),
e AS (SELECT conv_id, turn, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS sentence FROM a),
m AS (SELECT conv_id, turn, pos, len(list_intersect(list_distinct(regexp_extract_all(lower(sentence), '[\p{L}\p{N}_]+')), q)) AS shared FROM e JOIN q USING (conv_id, turn))
SELECT conv_id, turn, pos::BIGINT AS pos, shared::BIGINT AS shared FROM m QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY shared DESC, pos) = 1"""

QUERIES = {
    "bm25_search": (bm25_search, BM25_SQL),
    "bm25_scores": (bm25_scores, BM25_ALL_SQL),
    "bm25_corpus": (bm25_corpus, CORPUS_SQL),
    "incremental_bm25": (incremental_bm25, INCREMENTAL_SQL),
    "hash_embedding": (hash_embedding, EMBEDDING_SQL),
    "vector_search": (vector_search, VECTOR_SQL),
    "embedding_integrity": (embedding_integrity, INTEGRITY_SQL),
    "lexical_search": (lexical_search, LEXICAL_SQL),
    "catalog_ranking": (catalog_ranking, CATALOG_SQL),
    "retrieval_quality": (retrieval_quality, QUALITY_SQL),
    "latency_stats": (latency_stats, LATENCY_SQL),
    "extractive_evidence": (extractive_evidence, EVIDENCE_SQL),
}
