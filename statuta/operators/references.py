"""The reference graph of regulations: locators, edges with status and reason, existence of target articles, queries and cycles under access rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.operators.graph import resolve

PLACE = r"^제\s*(\d+)\s*조(?:\s*의\s*(\d+))?(?:\s*제?\s*(\d+)\s*항)?(?:\s*제?\s*(\d+)\s*호)?(?:\s*(?:제?\s*(\d+)|([가-하]))\s*목)?$"


def locator(text: Column) -> Column:
    """(article, locator) of a place: '제3조의2' and '제3조의2제1항제2호가목', numbers without leading noughts; null where it is no place."""
    flat = F.trim(text)
    group = lambda k: F.nullif(F.regexp_extract(flat, PLACE, k), F.lit(""))
    numbers = [group(k).cast("long") for k in (1, 2, 3, 4, 5)]
    bad = F.lit(False)
    for n in numbers:
        bad = bad | F.coalesce(n <= 0, F.lit(False))
    step = lambda before, n, after: F.coalesce(F.concat(F.lit(before), n.cast("string"), F.lit(after)), F.lit(""))
    article = F.concat(step("제", numbers[0], "조"), step("의", numbers[1], ""))
    whole = F.concat(article, step("제", numbers[2], "항"), step("제", numbers[3], "호"), F.coalesce(F.concat(numbers[4].cast("string"), F.lit("목")), F.concat(group(6), F.lit("목")), F.lit("")))
    return F.when(flat.rlike(PLACE) & ~bad, F.struct(article.alias("article"), whole.alias("locator")))


def reference_graph(records: DataFrame, scope: list[str]) -> tuple[DataFrame, DataFrame]:
    """(units, edges) of approved records. records: scope, record_id, approved, unit_id, number, title, article_no, article_refs (array of (regulation, article)) and
    regulation_refs (array of names).

    A name is looked up in its scope by number, then title. A unit reference that the same record also makes with an article is left out. An article
    must exist in the target: first its base, then the exact place. Equal edges are one, with their mentions and the first evidence."""
    rows = records.filter("approved")
    places = rows.filter("article_no is not null").select(*scope, "unit_id", locator(F.col("article_no")).alias("p")).filter("p is not null")
    known = places.select(*scope, F.col("unit_id").alias("target"), F.explode(F.array("p.article", "p.locator")).alias("place")).distinct()
    units = rows.groupBy(*scope, "unit_id").agg(F.min("number").alias("number"), F.min("title").alias("title"), F.count("*").alias("n_records"))
    names = units.select(*scope, F.col("unit_id"), F.lower(F.trim("number")).alias("number"), F.lower(F.trim("title")).alias("title"))
    base = [*scope, "record_id", F.col("unit_id").alias("source"), locator(F.col("article_no"))["locator"].alias("source_article")]
    cited = rows.select(*base, F.explode("article_refs").alias("r")).select(*scope, "record_id", "source", "source_article", F.col("r.regulation").alias("mention"), F.col("r.article").alias("place"), F.lit("article").alias("kind"))
    plain = rows.select(*base, F.explode("regulation_refs").alias("mention")).select("*", F.lit(None).cast("string").alias("place"), F.lit("unit").alias("kind"))
    plain = plain.join(cited.select(*scope, "record_id", "mention").distinct(), [*scope, "record_id", "mention"], "left_anti")
    asked = cited.unionByName(plain).withColumn("ref", F.lower(F.trim("mention")))
    found = resolve(asked, names, scope, "ref", ["number", "title"], "unit_id").withColumn("p", locator(F.col("place")))
    has = lambda name, out: known.select(*scope, "target", F.col("place").alias(name), F.lit(True).alias(out))
    found = found.withColumn("want_article", F.col("p.article")).withColumn("want_place", F.col("p.locator"))
    found = found.join(has("want_article", "base_there"), [*scope, "target", "want_article"], "left").join(has("want_place", "place_there"), [*scope, "target", "want_place"], "left")
    article = F.col("kind") == "article"
    reason = (
        F.when(F.col("status") != "resolved", F.col("status"))
        .when(article & (F.trim(F.coalesce("place", F.lit(""))) == ""), "article_locator_missing")
        .when(article & F.col("p").isNull(), "invalid_article_locator")
        .when(article & (F.col("base_there").isNull() | F.col("place_there").isNull()), "target_article_not_found")
    )
    status = F.when(F.col("status") == "resolved", F.when(reason.isNull(), "resolved").otherwise("unresolved")).otherwise(F.col("status"))
    found = found.select(*scope, "source", "source_article", "kind", "ref", "target", F.coalesce("want_place", "place").alias("place"), status.alias("status"), reason.alias("reason"), "n_candidates", "record_id")
    same = [*scope, "source", "source_article", "kind", F.when(F.col("target").isNull(), F.col("ref")).alias("ref"), "target", "place", "status", "reason", "n_candidates"]
    return units, found.groupBy(*same).agg(F.count("*").alias("mentions"), F.min("record_id").alias("evidence"))


def references_of(edges: DataFrame, allowed: DataFrame, unit: str, direction: str = "both", status: str | None = None, candidates: DataFrame | None = None, page: int = 1, size: int = 100) -> DataFrame:
    """Edges from or to a unit that the caller may see: source, target and, of ambiguous ones, every candidate (ref, unit_id) are allowed. `size` a page, 100 at the most."""
    if direction not in ("incoming", "outgoing", "both"):
        raise ValueError(f"no such direction: {direction}")
    out, into = F.col("source") == unit, F.coalesce(F.col("target") == unit, F.lit(False))
    rows = edges.filter({"outgoing": out, "incoming": into, "both": out | into}[direction])
    if status:
        rows = rows.filter(F.col("status") == status)
    ok = allowed.select(F.col("unit_id").alias("source")).distinct()
    rows = rows.join(ok, "source", "left_semi")
    rows = rows.filter("target is null").unionByName(rows.filter("target is not null").join(ok.withColumnRenamed("source", "target"), "target", "left_semi").select(*rows.columns))
    if candidates is not None:
        denied = candidates.join(allowed.select("unit_id"), "unit_id", "left_anti").select("ref").distinct()
        rows = rows.join(denied, "ref", "left_anti")
    size = max(1, min(100, size))
    return rows.orderBy("source", "target", "ref", "place", "evidence").offset((page - 1) * size).limit(size)


def cycles_of(members: DataFrame, allowed: DataFrame, page: int = 1, size: int = 100) -> DataFrame:
    """(cycle_id, size, members) of cycles (node, cycle_id, size) all of whose units are allowed."""
    denied = members.join(allowed.select(F.col("unit_id").alias("node")), "node", "left_anti").select("cycle_id").distinct()
    whole = members.join(denied, "cycle_id", "left_anti").groupBy("cycle_id").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("node")).alias("members"))
    size = max(1, min(100, size))
    return whole.orderBy("cycle_id").offset((page - 1) * size).limit(size)


def article_status(citations: DataFrame, articles: DataFrame, scope: list[str]) -> DataFrame:
    """citations (scope, place) with target and status: exact, base (only the article is there) or missing. articles: scope, article_no, id, order_index."""
    flat = articles.withColumn("p", locator(F.col("article_no"))).filter("p is not null")
    first = lambda c: flat.groupBy(*scope, F.col(f"p.{c}").alias("k")).agg(F.min_by("id", F.struct("order_index", "id")).alias("id"))
    rows = citations.withColumn("p", locator(F.col("place"))).withColumn("k1", F.col("p.locator")).withColumn("k2", F.col("p.article"))
    rows = rows.join(first("locator").withColumnsRenamed({"k": "k1", "id": "id1"}), [*scope, "k1"], "left").join(first("article").withColumnsRenamed({"k": "k2", "id": "id2"}), [*scope, "k2"], "left")
    status = F.when(F.col("id1").isNotNull(), "exact").when(F.col("id2").isNotNull(), "base").otherwise("missing")
    return rows.select(*citations.columns, F.coalesce("id1", "id2").alias("target"), status.alias("status"))
