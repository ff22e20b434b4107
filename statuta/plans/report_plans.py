"""Report operators bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.operators import reports
from statuta.session import table


def failure_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as runs; the message of an error event is made from its number."""
    e = table(spark, sf_dir, "events")
    said = F.element_at(F.array(*[F.lit(x) for x in ("OCR needed", "file is encrypted", "request timed out: timeout", "bad zip file", "no reader for .pdf", "strange")]), (F.col("event_id") % 6 + 1).cast("int"))
    message = F.when(F.col("event_type") == "error", said)
    return e.groupBy(reports.failure_category(message).alias("category")).agg(F.count("*").alias("n"), F.max("event_id").alias("newest"))


FAILURES_SQL = """
WITH m AS (SELECT event_id, CASE WHEN event_type = 'error' THEN ['ocr_required', 'password', 'timeout', 'corrupt', 'unsupported', 'other'][(event_id % 6 + 1)::INT] ELSE 'none' END AS category FROM events)
SELECT category, count(*)::BIGINT AS n, max(event_id) AS newest FROM m GROUP BY category"""


def readiness_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").groupBy("source").agg(
        F.count("*").alias("n"), F.countDistinct("lang").alias("langs"), F.max(F.length("text")).alias("longest"), F.count_if(F.trim("text") == "").alias("empty")
    )
    tests = [("has_documents", "error", F.col("n") > 0), ("no_empty", "error", F.col("empty") == 0), ("languages", "warning", F.col("langs") >= 3), ("length", "warning", F.col("longest") < 20000)]
    return reports.verdict(reports.checks(d, tests), "source")


READINESS_SQL = """
WITH d AS (SELECT source, count(DISTINCT lang) >= 3 AS a, max(length(text)) < 20000 AS b, count(*) FILTER (trim(text) = '') = 0 AS c FROM documents GROUP BY source)
SELECT source, c AS passed, ((NOT a)::INT + (NOT b)::INT + (NOT c)::INT)::BIGINT AS n_failed FROM d"""


def label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("bad", F.when(F.col("toxic") == 1, 1))
    return reports.coverage(rows, "lang", ["quality", "toxic", "bad"])


LABEL_COVERAGE_SQL = """
WITH c AS (SELECT lang, count(*) AS n, count(quality) AS quality, count(toxic) AS toxic, count(*) FILTER (toxic = 1) AS bad FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang)
SELECT lang, n::BIGINT AS n, field, filled::BIGINT AS filled FROM (SELECT lang, n, 'quality' AS field, quality AS filled FROM c UNION ALL SELECT lang, n, 'toxic', toxic FROM c UNION ALL SELECT lang, n, 'bad', bad FROM c)"""


def index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("hash"))
    indexed = d.filter("doc_id % 11 <> 0").withColumn("hash", F.when(F.col("doc_id") % 13 == 0, F.md5("hash")).otherwise(F.col("hash"))).unionByName(d.filter("doc_id < 5").withColumn("doc_id", F.col("doc_id") - 100))
    return reports.index_status(d, indexed, "doc_id", "hash")


STATUS_SQL = """SELECT count(*)::BIGINT AS expected, (count(*) FILTER (doc_id % 11 <> 0) + count(*) FILTER (doc_id < 5))::BIGINT AS indexed, (count(*) FILTER (doc_id % 11 = 0))::BIGINT AS missing,
(count(*) FILTER (doc_id % 11 <> 0 AND doc_id % 13 = 0))::BIGINT AS stale, (count(*) FILTER (doc_id < 5))::BIGINT AS left_over FROM documents"""


def seed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    seeds = reports.representatives(d, ["lang", "source"], "doc_id")
    return seeds.withColumn("query", F.concat(F.lit("What does "), "source", F.lit(" say in "), "lang", F.lit("?")))


SEEDS_SQL = """SELECT lang, source, min(doc_id) AS representative, count(*)::BIGINT AS n, 'What does ' || source || ' say in ' || lang || '?' AS query FROM documents GROUP BY lang, source"""


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    made = reports.citation(F.col("p_name"), F.concat_ws(" > ", "p_brand", "p_type"), F.concat(F.lit("제"), F.col("l_linenumber").cast("string"), F.lit("조")), F.col("l_suppkey"))
    return lines.select("l_orderkey", "l_linenumber", F.md5(made).alias("citation"))


CITATIONS_SQL = """SELECT l_orderkey, l_linenumber, md5(p_name || ' (' || p_brand || ' > ' || p_type || ') 제' || l_linenumber || '조 p.' || l_suppkey) AS citation FROM lineitem JOIN part ON l_partkey = p_partkey"""


def relation_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by kind with their ends counted: orders to customers, lines to parts, parts to suppliers."""
    o, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    edges = [("order_customer", o.select(F.col("o_orderkey").alias("a"), F.col("o_custkey").alias("b"))), ("line_part", lines.select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b"))), ("part_supplier", lines.select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")))]
    out = None
    for kind, rows in edges:
        part = rows.agg(F.count("*").alias("n"), F.countDistinct("a").alias("sources"), F.countDistinct("b").alias("targets")).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


MANIFEST_SQL = """
SELECT 'order_customer' AS kind, count(*)::BIGINT AS n, count(DISTINCT o_orderkey)::BIGINT AS sources, count(DISTINCT o_custkey)::BIGINT AS targets FROM orders
UNION ALL SELECT 'line_part', count(*), count(DISTINCT l_orderkey), count(DISTINCT l_partkey) FROM lineitem
UNION ALL SELECT 'part_supplier', count(*), count(DISTINCT l_partkey), count(DISTINCT l_suppkey) FROM lineitem"""


def relevance_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User questions whose answer shares no word of three letters or more with them are refused."""
    c = table(spark, sf_dir, "conversations")
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]{3,})"), 1))
    q = c.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), words.alias("q"))
    a = c.filter("role = 'assistant'").select("conv_id", "turn", words.alias("a"))
    return q.join(a, ["conv_id", "turn"]).groupBy((F.size(F.array_intersect("q", "a")) == 0).alias("refused")).agg(F.count("*").alias("n"))


GUARD_SQL = r"""
WITH w AS (SELECT conv_id, turn, role, list_distinct(regexp_extract_all(lower(text), '[\p{L}]{3,}')) AS w FROM conversations)
SELECT len(list_intersect(q.w, a.w)) = 0 AS refused, count(*)::BIGINT AS n FROM w q JOIN w a ON q.conv_id = a.conv_id AND a.turn = q.turn + 1 AND q.role = 'user' AND a.role = 'assistant' GROUP BY 1"""


def text_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(
        F.count_if(F.col("text").rlike(r"[\x00-\x08]")).alias("control"),
        F.count_if(F.col("text").rlike(r"[#*$%&]{3,}")).alias("symbol_runs"),
        F.count_if(F.col("text").contains("|")).alias("table_like"),
        F.sum(F.size(F.split("text", "\n"))).alias("lines"),
        F.round(F.avg(F.size(F.split("text", " "))), 4).alias("mean_words"),
    )


METRICS_SQL = r"""SELECT lang, (count(*) FILTER (regexp_matches(text, '[\x00-\x08]')))::BIGINT AS control, (count(*) FILTER (regexp_matches(text, '[#*$%&]{3,}')))::BIGINT AS symbol_runs,
(count(*) FILTER (contains(text, '|')))::BIGINT AS table_like, sum(len(string_split(text, chr(10))))::BIGINT AS lines, round(avg(len(string_split(text, ' '))), 4) AS mean_words FROM documents GROUP BY lang"""

QUERIES = {
    "failure_alerts": (failure_alerts, FAILURES_SQL),
    "readiness_checks": (readiness_checks, READINESS_SQL),
    "label_coverage": (label_coverage, LABEL_COVERAGE_SQL),
    "index_status": (index_status, STATUS_SQL),
    "seed_queries": (seed_queries, SEEDS_SQL),
    "citations": (citations, CITATIONS_SQL),
    "relation_manifest": (relation_manifest, MANIFEST_SQL),
    "relevance_guard": (relevance_guard, GUARD_SQL),
    "text_metrics": (text_metrics, METRICS_SQL),
}
