"""Operator 5: URL filters as a temporal list join.

A list is a table of dated entries (pattern, action, listed_on): a pattern is a host (the host and its subdomains) or a host and a path
prefix; action is 'block', 'allow' or 'drop' (the entry leaves the list). Patterns are compared as captures are: scheme, user, port and query do not matter,
hosts are in lower case without final dots, paths end in '/'. `rejected_entries` names the entries that can match nothing.
Entries of one pattern become validity intervals [listed_on, next listed_on). Every capture gives its candidate
patterns (host suffixes, host and path prefixes), and an as-of join finds those active at its fetch time.
The longest active pattern decides: 'block' rejects, 'allow' keeps; no active entry keeps.

The list is broadcast only if it has no more than BROADCAST_ENTRIES rows; beyond that, the candidates of distinct captures are
looked up by a salted shuffle join.

Hosts are compared without port and final dots; an IP address is matched whole, never by its last numbers.

Defined results: empty tables give no rows or no matches; very long URLs have all their path prefixes. A null or host-less URL matches nothing and is kept; a null fetch time matches nothing; two
entries of one pattern on one date: the action that comes first in the order block, allow, drop holds.
Repeated captures give a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statuta.llm.common import pick
from statuta.session import table

BROADCAST_ENTRIES = 200_000
SALTS = 16


def entry_pattern(pattern: Column) -> Column:
    """An entry's pattern in the form of a capture's candidates; null without a host."""
    plain = F.regexp_replace(F.trim(pattern), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//|^(?:\*\.)+", "")
    url = F.concat(F.lit("x://"), F.regexp_replace(plain, r"^\*?\.+", ""))
    steps = F.filter(F.split(path_of(url), "/"), lambda p: p != "")
    return F.concat(host_of(url), F.lit("/"), F.array_join(F.transform(steps, lambda p: F.concat(p, F.lit("/"))), ""))


def rejected_entries(entries: DataFrame) -> DataFrame:
    """entries that have no effect, with the reason: no host, no date or an unknown action."""
    reason = F.when(entry_pattern(F.col("pattern")).isNull(), "no host").when(F.col("listed_on").isNull(), "no date").when(~F.coalesce(F.col("action"), F.lit("")).isin("block", "allow", "drop"), "unknown action")
    return entries.withColumn("reason", reason).filter("reason is not null")


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals (pattern, action, valid_from, valid_to) of dated entries; hosts and paths share one pattern space."""
    rows = pick(entries, pattern="pattern", action="action", listed_on="listed_on").withColumn("pattern", entry_pattern(F.col("pattern")))
    rows = rows.filter("pattern is not null and listed_on is not null and action in ('block', 'allow', 'drop')")
    rank = F.when(F.col("action") == "block", 0).when(F.col("action") == "allow", 1).otherwise(2)
    first = rows.groupBy("pattern", "listed_on").agg(F.min_by("action", rank).alias("action"))
    spans = first.withColumn("valid_to", F.lead("listed_on").over(Window.partitionBy("pattern").orderBy("listed_on")))
    return spans.filter(F.col("action") != "drop").select("pattern", "action", F.col("listed_on").alias("valid_from"), "valid_to")


def host_of(url: Column) -> Column:
    """Lower-cased host without port and final dots; an IPv6 address keeps its brackets."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)", 1))
    return F.nullif(F.regexp_replace(host, r"\.+$", ""), F.lit(""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def candidates(url: Column) -> Column:
    """Host suffixes of two labels or more, then host with each path prefix; every one ends in '/'."""
    host, parts = host_of(url), F.split(host_of(url), r"\.")
    n = F.size(parts)
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(parts, i, n), "."), F.lit("/")))
    address = host.rlike(r"^(?:\d+(?:\.\d+){3}|\[.*\])$")  # an address has no subdomains
    suffixes = F.when(address, F.array(F.concat(host, F.lit("/")))).otherwise(suffixes)
    steps = F.filter(F.split(path_of(url), "/"), lambda p: p != "")
    paths = F.transform(
        steps, lambda _, i: F.concat(host, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i + 1), "/"), F.lit("/"))
    )
    return F.when(host.isNotNull(), F.array_distinct(F.concat(suffixes, paths)))


def filter_urls(
    captures: DataFrame, entries: DataFrame, capture_id: str = "page_id", url: str = "url", fetched_at: str = "fetched_at"
) -> DataFrame:
    """One row per capture: id, url, fetched_at, pattern and action of the deciding entry (null: none), kept."""
    base = pick(captures, capture_id=capture_id, url=url, fetched_at=fetched_at)
    spans = intervals(entries)
    n_entries = entries.limit(BROADCAST_ENTRIES + 1).count()
    inside = (F.col("fetched_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to")))
    if n_entries <= BROADCAST_ENTRIES:
        # Candidates of a capture stay in its task up to the partial aggregation: one row a capture is shuffled.
        rows = base.withColumn("row", F.monotonically_increasing_id()).withColumn("pattern", F.explode_outer(candidates(F.col("url"))))
        hits = rows.join(F.broadcast(spans.withColumnRenamed("pattern", "listed")), (F.col("pattern") == F.col("listed")) & inside, "left")
        won = hits.groupBy("row").agg(
            F.first("capture_id").alias("capture_id"),
            F.first("url").alias("url"),
            F.first("fetched_at").alias("fetched_at"),
            F.max_by(F.struct(F.col("listed").alias("pattern"), "action"), F.length("listed")).alias("won"),
        )
        decided = won.select("capture_id", "url", "fetched_at", "won.pattern", "won.action")
    else:
        # Each distinct capture is judged once. Captures of one host are spread over SALTS, to each of which the host's entries go.
        urls = base.select("url", "fetched_at").where("url is not null and fetched_at is not null").distinct()
        asked = urls.withColumn("salt", F.pmod(F.xxhash64("url", "fetched_at"), F.lit(SALTS))).withColumn("pattern", F.explode(candidates(F.col("url"))))
        spread = spans.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        best = asked.join(spread, ["pattern", "salt"]).filter(inside).groupBy("url", "fetched_at").agg(
            F.max_by(F.struct("pattern", "action"), F.length("pattern")).alias("won")
        )
        decided = base.join(best, ["url", "fetched_at"], "left").select("capture_id", "url", "fetched_at", "won.pattern", "won.action")
    return decided.select(
        F.col("capture_id").alias(capture_id),
        "url",
        F.col("fetched_at").alias(fetched_at),
        "pattern",
        "action",
        (F.coalesce("action", F.lit("allow")) != "block").alias("kept"),
    )


def op5_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages has no fetch time: capture k of the crawl is taken on day k mod 365 of 2024."""
    pages = table(spark, sf_dir, "pages")
    return pages.withColumn("fetched_at", F.expr("date_add(date'2024-01-01', cast(page_id % 365 as int))"))


def op5_entries(pages: DataFrame) -> DataFrame:
    """A dated list that grows with the crawl: of every host whose number (from its md5) leaves 0 mod 7, blocked on one day and dropped or
    allowed on a later one; of every host whose number leaves 0 mod 5 the path /en/ is blocked from the middle of the year."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct().withColumn("num", F.conv(F.substring(F.md5("host"), 1, 8), 16, 10).cast("long"))
    day = lambda n: F.expr(f"date_add(date'2024-01-01', cast({n} as int))")
    hit = hosts.filter("num % 7 = 0")
    return (
        hit.select(F.concat("host", F.lit("/")).alias("pattern"), F.lit("block").alias("action"), day("num % 200").alias("listed_on"))
        .unionByName(
            hit.select(
                F.concat("host", F.lit("/")).alias("pattern"),
                F.when(F.col("num") % 2 == 0, "drop").otherwise("allow").alias("action"),
                day("200 + num % 100").alias("listed_on"),
            )
        )
        .unionByName(
            hosts.filter("num % 5 = 0").select(F.concat("host", F.lit("/en/")).alias("pattern"), F.lit("block").alias("action"), day("180").alias("listed_on"))
        )
    )


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = op5_captures(spark, sf_dir)
    return filter_urls(captures, op5_entries(captures)).withColumn("fetched_at", F.col("fetched_at").cast("string"))


OP5_SQL = r"""
WITH captures AS (SELECT row_number() OVER () AS rn, page_id, url, DATE '2024-01-01' + (page_id % 365)::INT AS fetched_at,
    nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path FROM pages),
hosts AS (SELECT host, ('0x' || substr(md5(host), 1, 8))::UBIGINT::BIGINT AS num FROM (SELECT DISTINCT host FROM captures WHERE host IS NOT NULL)),
entries AS (
    SELECT host || '/' AS pattern, 'block' AS action, DATE '2024-01-01' + (num % 200)::INT AS listed_on FROM hosts WHERE num % 7 = 0
    UNION ALL SELECT host || '/', CASE WHEN num % 2 = 0 THEN 'drop' ELSE 'allow' END, DATE '2024-01-01' + (200 + num % 100)::INT FROM hosts WHERE num % 7 = 0
    UNION ALL SELECT host || '/en/', 'block', DATE '2024-01-01' + 180 FROM hosts WHERE num % 5 = 0),
spans AS (SELECT pattern, action, listed_on AS valid_from, lead(listed_on) OVER (PARTITION BY pattern ORDER BY listed_on) AS valid_to FROM entries),
parts AS (SELECT *, string_split(host, '.') AS labels, list_filter(string_split(path, '/'), lambda p: p <> '') AS steps FROM captures WHERE host IS NOT NULL),
keyed AS (
    SELECT rn, fetched_at, unnest(list_distinct(list_concat(
        list_transform(generate_series(1, greatest(len(labels) - 1, 1)), lambda i: array_to_string(labels[i:], '.') || '/'),
        list_transform(generate_series(1, len(steps)), lambda i: host || '/' || array_to_string(steps[1:i], '/') || '/')))) AS pattern FROM parts),
active AS (SELECT rn, k.pattern, action FROM keyed k JOIN spans s ON k.pattern = s.pattern AND action <> 'drop'
    AND fetched_at >= valid_from AND (valid_to IS NULL OR fetched_at < valid_to)),
best AS (SELECT rn, arg_max(pattern, length(pattern)) AS pattern, arg_max(action, length(pattern)) AS action FROM active GROUP BY rn)
SELECT page_id, url, fetched_at::DATE::VARCHAR AS fetched_at, pattern, action, coalesce(action, 'allow') <> 'block' AS kept
FROM captures LEFT JOIN best USING (rn)
"""
