"""Search operators over generated regulation records: every order is an article of one of five regulations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.functions import korean
from statuta.operators import inverted, search
from statuta.operators.store import Store
from statuta.plans.fixtures import both
from statuta.session import shared_folder, table

record_rows, RECORDS = both(
    """SELECT concat('c', CAST(o_orderkey AS STRING)) AS id, o_orderkey AS k, o_orderkey AS order_index, CASE o_custkey % 5 WHEN 0 THEN '인사규정' WHEN 1 THEN '보수규정' WHEN 2 THEN '복무규정' WHEN 3 THEN '여비규정' ELSE '회계규정' END AS regulation_title,
    concat('r', CAST(o_custkey % 5 AS STRING)) AS regulation_no0, CAST(o_custkey % 5 AS INT) AS reg, concat('제', CAST(o_orderkey % 30 + 1 AS STRING), '조') AS article_no,
    CASE o_orderkey % 6 WHEN 0 THEN '목적어' WHEN 1 THEN '휴직자' WHEN 2 THEN '급여율' WHEN 3 THEN '출장비' WHEN 4 THEN '채용법' ELSE '위임장' END AS article_title,
    concat('alpha', CAST(o_orderkey % 7 AS STRING), CASE WHEN o_orderkey % 3 = 0 THEN ' Beta ' ELSE ' ' END, 'w', CAST(o_orderkey % 13 AS STRING), ' w', CAST(o_orderkey % 13 AS STRING)) AS text FROM {orders}""",
    "orders",
)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = record_rows(spark, sf_dir).withColumn("hierarchy_path", F.concat_ws(" > ", "regulation_title", F.concat_ws(" ", "article_no", "article_title")))
    return rows.withColumn("content_hash", F.sha2("text", 256)).withColumn("version_id", F.concat(F.lit("v"), "reg"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).select("version_id", F.col("regulation_title").alias("title"), F.col("regulation_no0").alias("regulation_no"), "reg").distinct()
    return rows.select("version_id", "title", "regulation_no", F.concat("title", F.lit(" 휴직자")).alias("search_text"), F.format_string("2024-01-0%d", F.col("reg") + 1).alias("revision_date"))


def weighted_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all matching records from an index written, published and opened again."""
    rows = records(spark, sf_dir)
    folder = shared_folder(spark)
    search.build_index(rows, folder)
    return search.Index.open(spark, folder).search("beta w3 휴직자 제5조").select("id", F.round("score", 6).alias("score"))


WEIGHTED_SQL = f"""
WITH r AS (SELECT *, 11 * (k % 30 = 4)::INT AS a, (k % 3 = 0)::INT AS b, 2 * (k % 13 = 3)::INT AS w, 5 * (k % 6 = 1)::INT AS h, 34 + (k % 3 = 0)::INT AS n FROM ({RECORDS})),
s AS (SELECT count(*) AS docs, round(avg(n), 6) AS mean, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db, count(*) FILTER (w > 0) AS dw, count(*) FILTER (h > 0) AS dh FROM r),
p AS (SELECT id, 1.5 * (0.25 + 0.75 * n / mean) AS z, r.*, s.* FROM r, s)
SELECT id, round(round(2 * ln(1 + (docs - da + 0.5) / (da + 0.5)) * a * 2.5 / (a + z) + ln(1 + (docs - db + 0.5) / (db + 0.5)) * b * 2.5 / (b + z) + ln(1 + (docs - dw + 0.5) / (dw + 0.5)) * w * 2.5 / (w + z)
 + ln(1 + (docs - dh + 0.5) / (dh + 0.5)) * h * 2.5 / (h + z), 8), 6) AS score FROM p WHERE a + b + w + h > 0"""


def updated_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of weighted_search after an index of older records took three updates (a group with other words, three new groups, a group removed) and was compacted."""
    rows = records(spark, sf_dir).withColumn("grp", (F.col("k") % 10).cast("string"))
    folder, now = shared_folder(spark), rows.filter("k % 10 <> 0")
    old = rows.filter("k % 10 < 7").withColumn("text", F.when(F.col("k") % 10 == 3, F.lit("w3 w3 w3 other beta")).otherwise(F.col("text"))).withColumn("content_hash", F.sha2("text", 256))
    search.build_index(old, folder, group="grp")
    for groups in (["3"], ["7", "8", "9"], ["0"]):
        changed = now.filter(F.col("grp").isin(groups))
        search.update_index(folder, changed, spark.createDataFrame([(g,) for g in groups], "grp string"), now, "grp")
    inverted.compact(Store(spark, folder))
    return search.Index.open(spark, folder).search("beta w3 휴직자 제5조").select("id", F.round("score", 6).alias("score"))


UPDATED_SQL = WEIGHTED_SQL.replace(f"FROM ({RECORDS})", f"FROM (SELECT * FROM ({RECORDS}) WHERE k % 10 <> 0)")


def structured_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    return rows.select("id", search.structured_boost(rows, "인사규정 제5조 휴직자").alias("boost"))


BOOSTS_SQL = f"""
WITH b AS (SELECT id, reg = 0 AS t, k % 30 = 4 AS d, k % 6 = 1 AS n FROM ({RECORDS}))
SELECT id, (CASE WHEN t THEN 10 ELSE 0 END + CASE WHEN n AND d THEN 14 WHEN n THEN 8 ELSE 0 END + CASE WHEN d THEN 16 ELSE 0 END + CASE WHEN t AND (d OR n) THEN 8 ELSE 0 END)::DOUBLE AS boost FROM b"""


def domain_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).withColumn("text", F.when(F.col("k") % 4 == 0, "성과연봉은 12월 일시금").when(F.col("k") % 4 == 1, "중징계 처분").otherwise(F.col("text")))
    return rows.select("id", search.domain_boost(rows, "성과 연봉 지급대상 제외").alias("boost")).filter("boost <> 0")


DOMAIN_SQL = f"""
WITH b AS (SELECT id, k % 4 = 1 AS c, k % 4 = 0 AND k % 30 + 1 = 24 AS a FROM ({RECORDS}))
SELECT id, (CASE WHEN c THEN 10 ELSE 0 END - CASE WHEN a THEN 14 ELSE 0 END)::DOUBLE AS boost FROM b WHERE c OR a"""


def catalog_body_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best articles by way of catalog and body."""
    out = search.catalog_search(versions(spark, sf_dir), records(spark, sf_dir), "휴직자 인사규정", 5)
    return out.select("id", F.round("score", 6).alias("score"), "catalog_score")


CATALOG_BODY_SQL = f"""
WITH r AS (SELECT *, 12.0 * (k % 6 = 1)::INT AS a, 4.0 * (reg = 0)::INT AS b, 8 + (k % 3 = 0)::INT AS n, regulation_title || ' > ' || article_no || ' ' || article_title AS path FROM ({RECORDS})),
s AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM r),
f AS (SELECT r.*, greatest(1e-6, ln((docs - da + 0.5) / (da + 0.5))) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean)) + greatest(1e-6, ln((docs - db + 0.5) / (db + 0.5))) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)) AS z FROM r, s WHERE a + b > 0),
t AS (SELECT *, 1 - 1 / (1 + z) AS ret, CASE WHEN reg = 0 THEN 128.0 ELSE 4.0 END AS cat FROM f ORDER BY ret DESC, id LIMIT 30)
SELECT id, round(round(ret + least(cat, 100) / 100, 8), 6) AS score, cat::DOUBLE AS catalog_score FROM t ORDER BY round(ret + least(cat, 100) / 100, 8) DESC, reg DESC, path DESC, id LIMIT 5"""


def body_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """catalog_body_search from the catalog on disk: versions and chunks from its tables, bodies from the buckets of the query's terms."""
    folder = shared_folder(spark)
    search.build_catalog(versions(spark, sf_dir), records(spark, sf_dir), folder)
    body = search.BodyIndex.open(spark, folder)
    out = search.catalog_search(body.table("versions"), body.table("chunks"), "휴직자 인사규정", 5, body=body)
    return out.select("id", F.round("score", 6).alias("score"), "catalog_score")


def article_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of two regulations by an article number, which is the beginning of other numbers, and a word."""
    folder = shared_folder(spark)
    rows = records(spark, sf_dir).withColumn("article_no", F.when(F.col("k") % 4 == 0, F.concat("article_no", F.lit("의2"))).otherwise(F.col("article_no")))
    search.build_catalog(versions(spark, sf_dir), rows, folder)
    body = search.BodyIndex.open(spark, folder)
    return body.body_scores("제7조 휴직자", body.table("versions").filter("version_id IN ('v0', 'v1')")).select("id", F.round("retrieval_score", 6).alias("score"))


PREFIX_SQL = f"""
WITH r AS (SELECT *, 10.0 * (k % 30 = 6)::INT AS a, 12.0 * (k % 6 = 1)::INT AS b, 8 + (k % 3 = 0)::INT AS n FROM ({RECORDS})),
s AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM r)
SELECT id, round(1 - 1 / (1 + greatest(1e-6, ln((docs - da + 0.5) / (da + 0.5))) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean))
    + greatest(1e-6, ln((docs - db + 0.5) / (db + 0.5))) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score FROM r, s WHERE a + b > 0 AND reg < 2"""


def exact_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An article that is there, by title and number, and one that is not, by way of the search."""
    rows = records(spark, sf_dir).withColumn("regulation_no", F.col("regulation_no0"))
    hit = search.lookup(rows, versions(spark, sf_dir), "", 20, "인사 규정", "제 7 조").select(F.lit("exact").alias("way"), "id")
    miss = search.lookup(rows, versions(spark, sf_dir), "휴직자 인사규정", 5, "인사규정", "제99조").select(F.lit("search").alias("way"), "id")
    return hit.unionByName(miss)


EXACT_SQL = f"""
SELECT 'search' AS way, id FROM ({CATALOG_BODY_SQL}) UNION ALL SELECT * FROM (SELECT 'exact', id FROM ({RECORDS}) WHERE reg = 0 AND article_no = '제7조' ORDER BY order_index, id LIMIT 20)"""


def search_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ways of the fallback: the index, literal matches where it finds none, and literal matches with an index of other records."""
    rows = records(spark, sf_dir)
    folder = shared_folder(spark)
    search.build_index(rows, folder)
    index = search.Index.open(spark, folder)
    part = lambda n, df: df.select(F.lit(n).alias("way"), "model", "id", F.round("score", 6).alias("score"))
    first = search.cascade(rows, "w3", index, 7, record_print=index.fingerprint)
    second = search.cascade(rows, "lpha3", index, 7, record_print=index.fingerprint)
    third = search.cascade(rows.filter("k % 2 = 0"), "alpha5", index, 7)
    return part(1, first).unionByName(part(2, second)).unionByName(part(3, third))


CASCADE_SQL = f"""
WITH r AS (SELECT *, 34 + (k % 3 = 0)::INT AS n FROM ({RECORDS})),
s AS (SELECT count(*) AS docs, round(avg(n), 6) AS mean, count(*) FILTER (k % 13 = 3) AS dw FROM r)
SELECT * FROM (SELECT 1 AS way, 'bm25' AS model, id, round(round(ln(1 + (docs - dw + 0.5) / (dw + 0.5)) * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * n / mean)), 8), 6) AS score FROM r, s WHERE k % 13 = 3 ORDER BY score DESC, id LIMIT 7)
UNION ALL SELECT * FROM (SELECT 2, 'literal', id, 12.0::DOUBLE FROM r WHERE k % 7 = 3 ORDER BY id LIMIT 7)
UNION ALL SELECT * FROM (SELECT 3, 'literal', id, 12.0::DOUBLE FROM r WHERE k % 7 = 5 AND k % 2 = 0 ORDER BY id LIMIT 7)"""


def offline_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).withColumn("n_edges", F.col("k") % 2).withColumn("table_like", F.col("k") % 5 == 0).withColumn("text", F.when(F.col("k") % 17 == 0, F.concat("text", F.lit(" �"))).otherwise(F.col("text")))
    return rows.select("id", F.round(search.evaluator_scores(rows, "beta 휴직자 인사규정"), 6).alias("score"))


OFFLINE_SQL = f"""
WITH s AS (SELECT id, k, (k % 3 = 0)::INT + 1.4 * ((k % 6 = 1)::INT + (reg = 0)::INT) + 0.25 * ((k % 6 = 1)::INT + (reg = 0)::INT) AS s FROM ({RECORDS}))
SELECT id, round(CASE WHEN s > 0 THEN (s + CASE WHEN k % 2 = 1 THEN 0.35 ELSE 0 END + CASE WHEN k % 5 = 0 THEN 0.15 ELSE 0 END) * CASE WHEN k % 17 = 0 THEN 0.35 ELSE 1 END ELSE 0 END, 6)::DOUBLE AS score FROM s"""


def governed_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    articles = rows.filter("k % 2 = 0").withColumn("appendix_refs", F.array(F.concat(F.lit("[별표 "), (F.col("k") % 40).cast("string"), F.lit("]"))))
    hits = rows.filter("k % 2 = 1").withColumn("label", F.concat(F.lit("별표"), (F.col("k") % 41).cast("string")))
    return search.governing_articles(hits, articles, "label", "appendix_refs", ["reg"]).select("id", "governing_article")


GOVERNED_SQL = f"""
WITH a AS (SELECT reg, k % 40 AS no, arg_min(id, (order_index, id)) AS governing_article FROM ({RECORDS}) WHERE k % 2 = 0 GROUP BY reg, k % 40)
SELECT id, governing_article FROM (SELECT * FROM ({RECORDS}) WHERE k % 2 = 1) h LEFT JOIN a ON a.reg = h.reg AND a.no = h.k % 41"""


def mode_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", (F.col("l_linenumber") % 2).alias("l_linenumber")).agg(F.max("l_quantity").alias("l_quantity"), F.max("l_discount").alias("l_discount"))
    metrics = rows.select("l_orderkey", F.when(F.col("l_linenumber") == 1, "rag").otherwise("fetch").alias("mode"), F.col("l_quantity").cast("double").alias("recall"), F.col("l_discount").cast("double").alias("mrr"))
    return search.answer_comparison(metrics, "l_orderkey", "rag", "fetch", ["recall", "mrr"])


MODES_SQL = """
WITH l AS (SELECT l_orderkey, l_linenumber % 2 AS l_linenumber, max(l_quantity) AS q, max(l_discount) AS d FROM lineitem GROUP BY l_orderkey, l_linenumber % 2),
m AS (SELECT l_orderkey, l_linenumber, unnest(['recall', 'mrr']) AS metric, unnest([q::DOUBLE, d::DOUBLE]) AS v FROM l),
p AS (SELECT a.metric, a.v - b.v AS d FROM m a JOIN m b ON a.l_orderkey = b.l_orderkey AND a.metric = b.metric AND a.l_linenumber = 1 AND b.l_linenumber = 0)
SELECT metric, count(*) FILTER (d > 0) AS better_left, count(*) FILTER (d < 0) AS better_right, count(*) FILTER (d = 0) AS equal, round(avg(d), 6) AS mean_delta FROM p GROUP BY metric"""


def korean_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of Korean phrases with endings, compounds, article numbers and decomposed letters."""
    phrases = ("휴직을 신청하는", "인사규정은 제 3 조의 2 에서", "육아휴직수당", "foo-bar 1급", "급여의", "출장비를 지급한다")
    picked = F.array(*[F.lit(p) for p in phrases])
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.get(picked, (F.col("c_custkey") % 6).cast("int")).alias("t"))
    return rows.select("c_custkey", F.array_join(korean.korean_tokens(F.col("t")), " ").alias("tokens"))


KOREAN_SQL = """SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN '휴직을 휴직 신청하는 신청' WHEN 1 THEN '제3조의2 인사규정은 인사규정 제 3 조의 2 에서' WHEN 2 THEN '육아휴직수당 육아휴직 수당' WHEN 3 THEN 'foo bar 1급' WHEN 4 THEN '급여의 급여' ELSE '출장비를 출장비 지급한다 지급' END AS tokens FROM customer"""

QUERIES = {
    "weighted_search": (weighted_search, WEIGHTED_SQL),
    "updated_index": (updated_index, UPDATED_SQL),
    "body_index_search": (body_index_search, CATALOG_BODY_SQL),
    "article_prefixes": (article_prefixes, PREFIX_SQL),
    "structured_boosts": (structured_boosts, BOOSTS_SQL),
    "domain_boosts": (domain_boosts, DOMAIN_SQL),
    "catalog_body_search": (catalog_body_search, CATALOG_BODY_SQL),
    "exact_lookup": (exact_lookup, EXACT_SQL),
    "search_cascade": (search_cascade, CASCADE_SQL),
    "offline_ranking": (offline_ranking, OFFLINE_SQL),
    "governed_attachments": (governed_attachments, GOVERNED_SQL),
    "mode_comparison": (mode_comparison, MODES_SQL),
    "korean_token_counts": (korean_token_counts, KOREAN_SQL),
}
