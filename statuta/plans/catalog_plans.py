"""Catalog operators over generated documents: every order is a document of one of 300 regulations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.functions import text
from statuta.operators import catalog, quality
from statuta.plans.fixtures import both
from statuta.session import table

document_rows, DOCUMENTS = both(
    """SELECT o_orderkey AS document_id, o_orderkey AS k, CASE WHEN o_orderkey % 12 = 0 THEN '' ELSE concat('p', CAST(o_custkey % 4 AS STRING)) END AS profile_id, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE concat('reg', CAST(o_custkey % 300 AS STRING)) END AS regulation_id,
    CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE concat('v', CAST(o_orderkey AS STRING)) END AS version, concat('r', CAST(o_orderkey AS STRING)) AS revision, CAST(CASE WHEN o_orderkey % 5 = 0 THEN 'soon' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS STRING) AS effective_from,
    CAST(CAST(o_orderdate AS DATE) AS STRING) AS valid_from, CASE WHEN o_orderkey % 4 = 0 THEN CAST(CAST(o_orderdate AS DATE) + INTERVAL 400 DAY AS STRING) ELSE NULL END AS valid_to, CASE WHEN o_orderkey % 2 = 0 THEN 'approved' ELSE NULL END AS approval_status, 'done' AS status FROM {orders}""",
    "orders",
)


def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = catalog.lifecycle_fields(document_rows(spark, sf_dir), ["document_id"])
    return out.select("document_id", "profile_id", "regulation_id", "version", *[F.col(c).cast("string").alias(c) for c in ("effective_from", "effective_to", "repealed_at")], "status")


LIFECYCLE_SQL = f"""SELECT document_id, nullif(profile_id, '') AS profile_id, regulation_id, CASE WHEN k % 3 = 0 THEN revision ELSE version END AS version, valid_from AS effective_from, valid_to[1:10] AS effective_to, NULL AS repealed_at,
 coalesce(approval_status, status) AS status FROM ({DOCUMENTS})"""


def regulation_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.grouped_versions(catalog.lifecycle_fields(document_rows(spark, sf_dir), ["document_id"]))


GROUPS_SQL = f"""SELECT profile_id, regulation_id, count(*) AS n, count(DISTINCT version) AS versions FROM ({LIFECYCLE_SQL}) GROUP BY ALL"""


def loaded_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of profile p1 in the version of each regulation in force on a day."""
    rows = catalog.lifecycle_fields(document_rows(spark, sf_dir), ["document_id"])
    return catalog.loaded(rows, {"profile_id": "p1", "status": "approved"}, F.lit("1997-06-01").cast("date")).select("document_id", "regulation_id", "version")


LOADED_SQL = f"""
WITH r AS (SELECT * FROM ({LIFECYCLE_SQL}) WHERE profile_id = 'p1' AND status = 'approved' AND regulation_id IS NOT NULL),
v AS (SELECT DISTINCT regulation_id, version, effective_from FROM r WHERE effective_from <= '1997-06-01' AND (effective_to IS NULL OR effective_to >= '1997-06-01') QUALIFY row_number() OVER (PARTITION BY regulation_id ORDER BY effective_from DESC, version DESC) = 1)
SELECT document_id, regulation_id, version FROM r JOIN v USING (regulation_id, version)"""


def corpus_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.logical_hash(document_rows(spark, sf_dir).select("regulation_id", "version", "document_id"), ["regulation_id", "version", "document_id"])


CORPUS_HASH_SQL = f"""
WITH d AS (SELECT sha256('{{"document_id":' || document_id || CASE WHEN regulation_id IS NULL THEN '' ELSE ',"regulation_id":"' || regulation_id || '"' END || ',"version":"' || version || '"}}') AS d FROM ({DOCUMENTS})),
u AS (SELECT d, count(*) AS n FROM d GROUP BY d), b AS (SELECT d[1:3] AS b, sum(n) AS n, sha256(string_agg(d || ':' || n, chr(10) ORDER BY d || ':' || n)) AS h FROM u GROUP BY 1)
SELECT sum(n)::BIGINT AS n, sha256(string_agg(h, chr(10) ORDER BY b)) AS logical_hash FROM b"""


def revision_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p"), F.max("l_suppkey").alias("s"))
    chunks = rows.select(F.col("l_orderkey").alias("document_id"), (F.col("l_linenumber") % 2).alias("article"), F.col("l_linenumber").cast("string").alias("chunk_id"), (F.col("p") % 5).cast("int").alias("page"), F.concat(F.lit(" part\n "), F.col("p").cast("string")).alias("text"))
    return catalog.revision_units(chunks, ["document_id", "article"]).select("document_id", "article", "n_chunks", "page_start", "page_end", "text")


UNITS_SQL = """
WITH c AS (SELECT l_orderkey AS document_id, l_linenumber % 2 AS article, l_linenumber::VARCHAR AS id, max(l_partkey) AS p FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT document_id, article, count(*)::INT AS n_chunks, min(p % 5)::INT AS page_start, max(p % 5)::INT AS page_end, string_agg('part ' || p, ' ' ORDER BY p % 5, id) AS text FROM c GROUP BY document_id, article"""


def structure_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    found = p.filter("p_partkey % 10 <> 0").select("p_partkey", (F.col("p_partkey") % 7).alias("n"))
    return catalog.structure_scores(found, p.filter("p_partkey % 11 <> 0").select("p_partkey", (F.col("p_partkey") % 5).alias("n")), ["p_partkey"])


SCORES_SQL = """
WITH b AS (SELECT p_partkey, CASE WHEN p_partkey % 10 <> 0 THEN p_partkey % 7 ELSE 0 END AS f, CASE WHEN p_partkey % 11 <> 0 THEN p_partkey % 5 ELSE 0 END AS l FROM part WHERE p_partkey % 110 <> 0),
q AS (SELECT p_partkey, CASE WHEN f > 0 THEN round(100 * least(f, l) / f, 2) END AS p, CASE WHEN l > 0 THEN round(100 * least(f, l) / l, 2) END AS r FROM b)
SELECT p_partkey, p::DOUBLE AS precision, r::DOUBLE AS recall, CASE WHEN p IS NOT NULL AND r IS NOT NULL THEN CASE WHEN p + r <= 0 THEN 0 ELSE round(2 * p * r / (p + r), 2) END END::DOUBLE AS f1 FROM q"""


def law_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most cited laws (a top-k report)."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.concat(F.lit("law"), (F.col("l_partkey") % 90).cast("string")).alias("law"), (F.col("l_suppkey") % 8).alias("article"))
    return catalog.law_report(rows, 20)


LAWS_SQL = """SELECT 'law' || l_partkey % 90 AS law, count(*) AS citations, count(DISTINCT l_orderkey) AS documents, count(DISTINCT l_suppkey % 8) AS articles FROM lineitem GROUP BY 1 ORDER BY citations DESC, law LIMIT 20"""


def retry_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p"))
    runs = rows.select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("run"), F.when(F.col("p") % 2 == 0, "failed").otherwise("done").alias("status"), F.when(F.col("p") % 3 == 0, "timeout").otherwise("corrupt").alias("category"))
    return catalog.retry_manifest(runs, ("timeout", "memory"))


RETRY_SQL = """
WITH r AS (SELECT l_orderkey AS document_id, l_linenumber AS run, max(l_partkey) AS p FROM lineitem GROUP BY ALL), t AS (SELECT *, count(*) OVER (PARTITION BY document_id) AS tries FROM r QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY run DESC) = 1)
SELECT document_id, 'timeout' AS category, tries FROM t WHERE p % 6 = 0"""


def profile_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_rows(spark, sf_dir).select("document_id", "profile_id", F.when(F.col("k") % 7 == 0, F.lit("own")).otherwise(" ").alias("institution_name"), F.lit(None).cast("string").alias("source_url"))
    profiles = spark.createDataFrame([("p0", "zero", None), ("p1", "one", "http://one"), ("p2", None, None)], "profile_id string, institution_name string, source_url string").withColumn("required", F.array(F.lit("institution_name"), F.lit("source_url")))
    out = catalog.with_profile(rows, profiles, "p1", ["institution_name", "source_url"])
    return out.select("document_id", "profile_id", "institution_name", "source_url", F.array_join("missing", ",").alias("missing"))


PROFILE_SQL = f"""
WITH d AS (SELECT document_id, k, coalesce(nullif(profile_id, ''), 'p1') AS pid FROM ({DOCUMENTS})), n AS (SELECT *, CASE WHEN k % 7 = 0 THEN 'own' WHEN pid = 'p0' THEN 'zero' WHEN pid = 'p1' THEN 'one' END AS name, CASE WHEN pid = 'p1' THEN 'http://one' END AS url FROM d)
SELECT document_id, CASE WHEN pid <> 'p3' THEN pid ELSE 'p3' END AS profile_id, name AS institution_name, url AS source_url,
 CASE WHEN pid = 'p3' THEN '' ELSE concat_ws(',', CASE WHEN name IS NULL THEN 'institution_name' END, CASE WHEN url IS NULL THEN 'source_url' END) END AS missing FROM n"""


def parser_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = document_rows(spark, sf_dir)
    k = F.col("k")
    stamp = catalog.uncertainty(F.lit(" HWPX "), F.when(k % 3 == 0, " High").otherwise("odd"), F.array(F.lit("b "), F.lit(""), F.when(k % 2 == 0, "a").otherwise("b")), F.when(k % 5 == 0, "no").otherwise((k % 4 / 2).cast("string")), F.lit(" "))
    return d.select("document_id", stamp.alias("s")).select("document_id", "s.source", "s.risk_level", "s.confidence", F.array_join("s.flags", ",").alias("flags"), "s.recommendation")


STAMPS_SQL = f"""SELECT document_id, 'hwpx' AS source, CASE WHEN k % 3 = 0 THEN 'high' ELSE 'medium' END AS risk_level, CASE WHEN k % 5 = 0 THEN 0 ELSE least(1, (k % 4) / 2) END::DOUBLE AS confidence, CASE WHEN k % 2 = 0 THEN 'a,b' ELSE 'b' END AS flags, 'none' AS recommendation FROM ({DOCUMENTS})"""


def export_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = document_rows(spark, sf_dir)
    rows = d.select("document_id", F.when(F.col("k") % 4 == 0, "cell").otherwise("raw").alias("kind"), F.when(F.col("k") % 1000 == 1, "bad").alias("error"))
    out = catalog.export_manifest(rows, "kind", "error")
    return out.select(F.col("counts")["cell"].alias("cells"), F.col("counts")["raw"].alias("raws"), "n", "has_errors")


EXPORT_COUNTS_SQL = f"""SELECT count(*) FILTER (k % 4 = 0) AS cells, count(*) FILTER (k % 4 <> 0) AS raws, count(*) AS n, bool_or(k % 1000 = 1) AS has_errors FROM ({DOCUMENTS})"""


def upload_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.struct(F.col("vec_id").alias("v")).alias("payload"))
    return catalog.upload_manifest(rows, "regs", 100)


UPLOAD_SQL = """SELECT 'regs' AS collection, count(*) AS points, ceil(count(*) / 100)::BIGINT AS batches, min(len(embedding))::INT AS least_dimensions, max(len(embedding))::INT AS most_dimensions, sum(length('{"v":' || vec_id || '}'))::BIGINT AS payload_bytes, true AS dry_run FROM embeddings"""


def flat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = document_rows(spark, sf_dir).select("document_id", F.struct(F.col("version"), F.lit(5).alias("document_id"), F.col("approval_status").alias("review")).alias("metadata"))
    return catalog.flat_export(d, {"review": "not_requested", "parser": "0"})


FLAT_SQL = f"""SELECT document_id, version, coalesce(approval_status, 'not_requested') AS review, '0' AS parser FROM ({DOCUMENTS})"""


def edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as documents and documents as pages: edge lines on at least max(3, half) of the pages."""
    d = table(spark, sf_dir, "documents").withColumn("text", F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("- header -\n"), "text")).otherwise(F.col("text")))
    pages = d.select("source", F.trim(F.substring_index("text", "\n", 1)).alias("first"), F.trim(F.substring_index("text", "\n", -1)).alias("last"))
    return quality.repeated_edges(pages, "source", "first", "last").select("source", F.md5("line").alias("line_hash"), "n")


EDGE_LINES_SQL = """
WITH d AS (SELECT source, CASE WHEN doc_id % 3 > 0 THEN '- header -' || chr(10) || text ELSE text END AS text FROM documents), p AS (SELECT source, trim(string_split(text, chr(10))[1]) AS a, trim(string_split(text, chr(10))[-1]) AS b FROM d),
n AS (SELECT source, count(*) AS pages FROM d GROUP BY source), e AS (SELECT source, unnest(list_distinct([a, b])) AS line FROM p)
SELECT source, md5(line) AS line_hash, count(*) AS n FROM e JOIN n USING (source) WHERE line <> '' AND pages >= 3 GROUP BY source, line, pages HAVING count(*) >= greatest(3, pages // 2)"""


def number_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    raw = F.concat(F.lit("제 "), F.col("s_suppkey").cast("string"), F.lit(" – 2 호"))
    return s.select("s_suppkey", text.number_key(raw).alias("number_key"), text.is_page_footer(F.concat(F.lit("- "), F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 2 == 0, " -").otherwise(""))).alias("footer"))


NUMBERS_SQL = "SELECT s_suppkey, s_suppkey || '-2' AS number_key, s_suppkey % 2 = 0 AS footer FROM supplier"


def batch_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = document_rows(spark, sf_dir).filter("k % 30 <> 7").select((F.col("k") % 30).alias("batch_id"), F.col("document_id").cast("string").alias("chunk_id"), F.md5("version").alias("content_hash"))
    lines = F.array_sort(F.collect_list(F.concat_ws(":", "chunk_id", "content_hash")))
    claims = c.filter("batch_id <> 4 or chunk_id <> '4'").groupBy("batch_id").agg(F.sha2(F.array_join(lines, "\n"), 256).alias("chunk_fingerprint")).unionByName(spark.createDataFrame([(7, "x")], "batch_id long, chunk_fingerprint string"))
    claims = claims.withColumn("manifest_hash", F.lit("m")).withColumn("expected_hash", F.when(F.col("batch_id") == 3, "n").otherwise("m"))
    return catalog.evidence_errors(claims, c)


EVIDENCE_SQL = "SELECT * FROM (VALUES (3::BIGINT, 'manifest changed'), (4, 'chunks changed'), (7, 'chunks missing')) AS t(batch_id, error)"

QUERIES = {
    "lifecycle_fields": (lifecycle, LIFECYCLE_SQL),
    "regulation_groups": (regulation_groups, GROUPS_SQL),
    "loaded_articles": (loaded_articles, LOADED_SQL),
    "corpus_hash": (corpus_hash, CORPUS_HASH_SQL),
    "revision_units": (revision_units, UNITS_SQL),
    "structure_scores": (structure_scores, SCORES_SQL),
    "law_citations": (law_citations, LAWS_SQL),
    "retry_list": (retry_list, RETRY_SQL),
    "profile_defaults": (profile_defaults, PROFILE_SQL),
    "parser_stamps": (parser_stamps, STAMPS_SQL),
    "export_counts": (export_counts, EXPORT_COUNTS_SQL),
    "upload_preview": (upload_preview, UPLOAD_SQL),
    "flat_rows": (flat_rows, FLAT_SQL),
    "repeated_edge_lines": (edge_lines, EDGE_LINES_SQL),
    "number_keys": (number_keys, NUMBERS_SQL),
    "batch_evidence": (batch_evidence, EVIDENCE_SQL),
}
