"""Index building and ranking: BM25, hash embeddings, vector, lexical and catalog search, evaluation."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.functions.text import tokens
from statuta.session import shared_folder, written

K1, B = 1.5, 0.75
BUCKETS = 384


def postings(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf) of every document."""
    return rows.select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def document_lengths(rows: DataFrame, key: str, text: str) -> DataFrame:
    return rows.select(key, F.size(tokens(F.col(text))).alias("len"))


def document_frequencies(entries: DataFrame) -> DataFrame:
    return entries.groupBy("term").agg(F.count("*").alias("df"))


def occurrences(toks: Column, word: str) -> Column:
    return F.size(F.filter(toks, lambda x: x == word))


def bm25(rows: DataFrame, query: str, key: str = "doc_id", text: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """(key, score) of documents with a positive score, without an index. The texts are read once: the counts of the query's terms are written (a few numbers a
    row), then give the statistics, one row (count, average length, document frequency of each query term), and the scores. The query is split as the texts are."""
    terms = re.findall(r"[^\W]+", query.lower())
    unique = list(dict.fromkeys(terms))
    toks = tokens(F.col(text))
    counted = rows.select(key, toks.alias("toks")).select(
        key, F.size("toks").alias("len"), *[occurrences(F.col("toks"), t).alias(f"tf{i}") for i, t in enumerate(unique)]
    )
    counted = written(counted, shared_folder(rows.sparkSession), "counted")
    stats = counted.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(unique))])
    joined = counted.crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i, t in enumerate(unique):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + terms.count(t) * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return joined.select(key, score.alias("score")).filter("score > 0")


def hash_embedding(entries: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """(key, bucket, weight): signed counts of hashed terms with unit length. Terms hash by sha256: 8 digits for the bucket, 2 for the sign."""
    h = F.sha2("term", 256)
    signed = entries.select(
        key,
        (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % buckets).alias("bucket"),
        (F.when(F.conv(F.substring(h, 9, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1) * F.col("tf")).alias("v"),
    )
    cells = signed.groupBy(key, "bucket").agg(F.sum("v").alias("v")).filter("v <> 0")
    norms = cells.groupBy(key).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return cells.join(norms, key).select(key, "bucket", F.round(F.col("v") / F.col("norm"), 8).alias("weight"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_search(rows: DataFrame, query: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, score): dot product with a one-row query, all rows scored."""
    one = query.select(F.col(vector).alias("q")).limit(1)
    return rows.crossJoin(F.broadcast(one)).select(key, dot(F.col(vector), F.col("q")).alias("score"))


def lexical_score(text: Column, words: list[str], most: int = 5) -> Column:
    """Sum over words of their count in the text, `most` each at the top."""
    toks = tokens(text)
    return sum((F.least(occurrences(toks, w), F.lit(most)) for w in words), F.lit(0))


def literal_score(text: Column, query: str, whole: int = 10, word: int = 2) -> Column:
    low = F.lower(F.regexp_replace(text, r"\s+", ""))
    score = F.when(low.contains("".join(query.lower().split())), whole).otherwise(0)
    for w in dict.fromkeys(query.lower().split()):
        score = score + F.when(low.contains(w), word).otherwise(0)
    return score


def catalog_score(title: Column, number: Column, query: str) -> Column:
    """Title and query holding one another 100, the number 80, each term 24 in the title, 18 in the number."""
    q = query.lower()
    t, n = F.lower(title), F.lower(number)
    score = F.when(t.contains(q) | F.lit(q).contains(t), 100).otherwise(0) + F.when((n != "") & F.lit(q).contains(n), 80).otherwise(0)
    for w in dict.fromkeys(q.split()):
        score = score + F.when(t.contains(w), 24).otherwise(0) + F.when(n.contains(w), 18).otherwise(0)
    return score


def recall_and_mrr(ranked: DataFrame, labels: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """One row: recall@k (found of labelled) for each k and the mean reciprocal rank of the first relevant result.

    ranked: (query_id, item_id, rank); labels: (query_id, item_id)."""
    hits = labels.distinct().join(ranked, ["query_id", "item_id"], "left")
    per = hits.groupBy("query_id").agg(F.count("*").alias("n"), *[F.count_if(F.col("rank") <= k).alias(f"hit{k}") for k in ks], F.min("rank").alias("first"))
    return per.agg(
        *[(F.sum(f"hit{k}") / F.sum("n")).alias(f"recall_at_{k}") for k in ks], F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr")
    )
