"""Which regulation a record belongs to: one stable unit per regulation over documents, renamings and renumberings.

Five steps, each a join or an aggregation of records or of the segments (regulations within a document) they form:

1. A document's records are parted by their regulation number; a record without one goes to the only number there is, or to the one number whose title
   matches its own, or stays by its title.
2. A segment takes the title, number and profile that most of its records have.
3. Records made with a canonical title are one unit by that title alone; numbers part it where the title has several, and the document does where several
   documents have it without a number.
4. A regulation id joins segments, and "replaces document X" joins two, unless a veto stands against it (see `id_links` and `replacements`).
5. Joined segments are a component; it takes the identity of its first: the one that replaces none, else the earliest.

Components take rounds in the logarithm of the longest chain. A title is compared with the titles of its own document only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.operators.graph import components
from statuta.session import shared_folder, written

#: Titles and parts of ids that name a collection of regulations, not one; structural places that are no regulation numbers.
COLLECTION_TITLES = ("규정", "규정모음", "규정집", "내부규정집", "통합규정집")
COLLECTION_END = "규정집"
COLLECTION_IDS = ("binder", "catalog", "container", "regulationbook", "규정집", "규정모음", "통합규정")
PLACE = r"^\s*제?\s*\d+(?:\s*의\s*\d+)?\s*(?:편|장|절|관|조|항)"
DATE = r"^(?:19|20)\d{2}[-./]\d{1,2}[-./]\d{1,2}$"

LATEST = "9999-12-31"
SEGMENT = ["document_id", "segment"]


def folded(value: Column) -> Column:
    return F.lower(F.trim(F.coalesce(value.cast("string"), F.lit(""))))


def title_key(value: Column) -> Column:
    return F.regexp_replace(folded(value), "[^0-9a-z가-힣]", "")


def number_key(value: Column) -> Column:
    """제 3-2 호, 3.2 and 3/2 are one number; anything else stays as it is, without spaces and other signs."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(folded(value), "[‐-―−]", "-"), r"\s+", ""), "[^0-9a-z가-힣./-]", "")
    number = F.regexp_extract(plain, r"^제?(\d+(?:[-./]\d+)*)호?$", 1)
    return F.when(number != "", F.regexp_replace(number, "[./]", "-")).otherwise(plain)


def plausible_number(number: Column, title: Column) -> Column:
    """The key of a regulation number; empty for places, dates, the title itself and what has no digit."""
    key, text = number_key(number), F.trim(F.coalesce(number, F.lit("")))
    wrong = ~key.rlike("[0-9]") | (F.length(key) > 80) | text.rlike(PLACE) | (title_key(number) == title_key(title)) | text.rlike(DATE)
    return F.when(wrong, "").otherwise(key)


def collection(title: Column) -> Column:
    return title_key(title).isin(*COLLECTION_TITLES) | title_key(title).endswith(COLLECTION_END)


def same_title(a: Column, b: Column) -> Column:
    """Keys that are equal, or of which the shorter (four characters or more) is in the longer."""
    return (a != "") & (b != "") & ((a == b) | ((F.least(F.length(a), F.length(b)) >= 4) & (a.contains(b) | b.contains(a))))


def consensus(rows: DataFrame, keys: list[str], value: str, key: Column) -> DataFrame:
    """keys and value: the spelling that is met most often of the value that most rows have; ties go to the longer, then to the later in order."""
    met = rows.select(*keys, F.trim(F.coalesce(value, F.lit(""))).alias("value"), key.alias("norm")).filter("norm <> ''").groupBy(*keys, "norm", "value").agg(F.count("*").alias("n"))
    forms = met.groupBy(*keys, "norm").agg(F.sum("n").alias("n"), F.max_by("value", F.struct("n", F.length("value"), "value")).alias("value"))
    return forms.groupBy(*keys).agg(F.max_by("value", F.struct("n", F.length("norm"), "norm")).alias(value))


def unit_of(profile: Column, title: Column, number: Column) -> Column:
    """The id of a regulation by its profile, title and number."""
    t, n = title_key(title), number_key(number)
    identity = F.when((t != "") & (n != ""), F.concat(F.lit("title:"), t, F.lit("\nno:"), n)).when(t != "", t).when(n != "", n).otherwise("unknown-regulation")
    return F.concat(F.lit("regunit-"), F.substring(F.sha2(F.concat(folded(profile), F.lit("\n"), identity), 256), 1, 20))


def parted(records: DataFrame) -> DataFrame:
    """Step 1: records with segment. A number's title, for the comparison, is the consensus of its records."""
    title = F.when(F.trim(F.coalesce("regulation_title", F.lit(""))) != "", F.col("regulation_title")).otherwise(F.col("document_name"))
    rows = records.filter("document_id is not null and document_id <> ''").withColumn("title_norm", title_key(title))
    rows = rows.withColumn("no_norm", plausible_number(F.col("regulation_no"), title))
    numbered = rows.filter("no_norm <> ''")
    counts = numbered.groupBy("document_id").agg(F.count_distinct("no_norm").alias("numbers"), F.min("no_norm").alias("only"))
    titles = canonical_titles(numbered.withColumn("one_name", F.lit(False)), ["document_id", "no_norm"]).select("document_id", F.col("no_norm").alias("match"), title_key(F.col("title")).alias("of"))
    open_titles = rows.filter("no_norm = ''").select("document_id", "title_norm").distinct()
    met = open_titles.join(counts.filter("numbers > 1").select("document_id"), "document_id", "left_semi").join(titles, "document_id").filter(same_title(F.col("title_norm"), F.col("of")))
    single = met.groupBy("document_id", "title_norm").agg(F.count("*").alias("k"), F.min("match").alias("match")).filter("k = 1").drop("k")
    both = rows.join(counts, "document_id", "left").join(single, ["document_id", "title_norm"], "left")
    by_title = F.concat(F.lit("title:"), F.when(F.col("title_norm") != "", F.col("title_norm")).otherwise("unknown"))
    segment = F.when(F.col("no_norm") != "", F.col("no_norm")).when(F.col("numbers") == 1, F.col("only")).otherwise(F.coalesce("match", by_title))
    return both.withColumn("segment", segment).withColumn("one_name", F.coalesce("numbers", F.lit(0)) <= 1).drop("match", "only", "numbers", "title_norm")


def canonical_titles(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and title: the consensus of regulation titles; the document's name in its place where that spells it out, or where there is none, unless it names a collection.
    rows: keys, regulation_title, document_name, one_name (the document is one regulation, so its name may be a longer form of the title)."""
    title, name = consensus(rows, keys, "regulation_title", title_key(F.col("regulation_title"))), consensus(rows, keys, "document_name", title_key(F.col("document_name")))
    given = rows.groupBy(*keys).agg(F.collect_set(title_key(F.col("regulation_title"))).alias("given"), F.bool_and("one_name").alias("one_name"))
    both = given.join(title, keys, "left").join(name, keys, "left")
    t, n = title_key(F.col("regulation_title")), title_key(F.col("document_name"))
    longer = F.col("one_name") & (t != "") & n.contains(t) & (F.length(n) > F.length(t))
    take = (n != "") & ~collection(F.col("document_name")) & ((t == "") | F.array_contains("given", n) | longer)
    return both.select(*keys, F.when(take, F.col("document_name")).otherwise(F.coalesce("regulation_title", "document_name", F.lit(""))).alias("title"))


def segments_of(rows: DataFrame, profile: str) -> DataFrame:
    """Steps 2 and 3: one row per segment: its identity (title, number, profile), unit, and what links it to others."""
    title = canonical_titles(rows, SEGMENT)
    number = consensus(rows, SEGMENT, "regulation_no", F.col("no_norm"))
    owner = consensus(rows, SEGMENT, "profile_id", folded(F.col("profile_id")))
    one = lambda c, key: F.when(F.count_distinct(F.nullif(key, F.lit(""))) == 1, F.max(F.nullif(key, F.lit("")))).alias(c)
    links = rows.groupBy(*SEGMENT).agg(
        one("stable_id", F.regexp_replace(folded(F.col("regulation_id")), r"\s+", " ")), one("replaces", F.trim(F.coalesce("supersedes_document_id", F.lit("")))),
        F.max("lineage_date").alias("date"), F.bool_or(collection(F.col("document_name"))).alias("in_collection"), F.max("canonical_title").alias("canonical"),
    )
    whole = links.join(title, SEGMENT, "left").join(number, SEGMENT, "left").join(owner, SEGMENT, "left")
    whole = whole.withColumns({"regulation_no": F.coalesce("regulation_no", F.lit("")), "profile_id": F.coalesce("profile_id", F.lit(profile)), "canonical_norm": title_key(F.col("canonical"))})
    whole = whole.withColumn("owner", folded(F.col("profile_id"))).withColumn("no_norm", number_key(F.col("regulation_no")))
    bare = F.when(F.col("no_norm") == "", F.col("document_id"))
    uses = whole.filter("canonical_norm <> ''").groupBy("owner", "canonical_norm").agg(F.count_distinct(F.nullif("no_norm", F.lit(""))).alias("numbers"), F.count_distinct(bare).alias("bare"))
    whole = whole.join(uses, ["owner", "canonical_norm"], "left")
    source = F.concat(F.lit("source-"), F.substring(F.sha2("document_id", 256), 1, 16))
    told = F.when(F.col("numbers").isNull(), F.col("regulation_no")).when((F.col("bare") > 1) & (F.col("no_norm") == ""), source).when(F.col("numbers") > 1, F.col("regulation_no")).otherwise("")
    shown = F.when(F.col("numbers").isNull() | (F.col("numbers") > 1), F.col("regulation_no")).otherwise("")
    whole = whole.withColumn("unit", unit_of(F.col("profile_id"), F.col("title"), told)).withColumn("regulation_no", shown)
    return whole.select(*SEGMENT, "owner", "title", "regulation_no", "profile_id", "unit", "stable_id", "replaces", "date", "in_collection")


def id_links(parts: DataFrame) -> DataFrame:
    """Step 4: (a, b) of segments with one regulation id. Units that differ stay apart if the id names a collection, a document has several units, a document is a
    collection, a segment has no date, or two units have one date (they are in force side by side)."""
    known = parts.filter("stable_id is not null")
    dated = known.groupBy("owner", "stable_id", "date").agg(F.count_distinct("unit").alias("at_once"), F.min("unit").alias("least"), F.max("unit").alias("most"), F.max("in_document").alias("in_document"), F.bool_or("in_collection").alias("in_collection"), F.min("part").alias("first"))
    groups = dated.groupBy("owner", "stable_id").agg(
        (F.min("least") < F.max("most")).alias("differ"), F.max("at_once").alias("at_once"), F.max("in_document").alias("in_document"), F.bool_or("in_collection").alias("in_collection"),
        F.bool_or(F.coalesce("date", F.lit("")) == "").alias("undated"), F.min("first").alias("a"),
    )
    names_collection = title_key(F.col("stable_id")).rlike("|".join(COLLECTION_IDS))
    veto = names_collection | (F.col("in_document") > 1) | F.col("in_collection") | F.col("undated") | (F.col("at_once") > 1)
    kept = groups.filter(~F.col("differ") | ~veto).select("owner", "stable_id", "a")
    return known.join(kept, ["owner", "stable_id"]).select("a", F.col("part").alias("b")).filter("a <> b")


def replacements(parts: DataFrame, folder: str) -> DataFrame:
    """Step 4: (a, b) of segments where a replaces b: both are all of their documents, a is not the earlier, neither is in another such pair on that side, and the chain
    does not end in itself. Pairs without branches are paths or rings, and a ring has as many arcs as nodes."""
    alone = parts.filter("in_document = 1")
    older = alone.select("owner", F.col("document_id").alias("replaces"), F.col("part").alias("b"), F.col("date").alias("b_date"))
    pairs = alone.filter("replaces is not null").select("owner", "replaces", F.col("part").alias("a"), F.col("date").alias("a_date")).join(older, ["owner", "replaces"])
    backward = (F.coalesce("a_date", F.lit("")) != "") & (F.coalesce("b_date", F.lit("")) != "") & (F.col("a_date") < F.col("b_date"))
    pairs = pairs.filter((F.col("a") != F.col("b")) & ~backward).select("a", "b")
    once = lambda c: pairs.groupBy(c).agg(F.count("*").alias("k")).filter("k = 1").select(c)
    pairs = written(pairs.join(once("a"), "a", "left_semi").join(once("b"), "b", "left_semi"), folder, "replacements")
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    label = components(nodes, pairs, f"{folder}/chains")
    arcs = pairs.join(label.withColumnRenamed("node", "a"), "a").groupBy("anchor").agg(F.count("*").alias("arcs"))
    rings = label.groupBy("anchor").agg(F.count("*").alias("nodes")).join(arcs, "anchor").filter("arcs >= nodes").select("anchor")
    inside = label.join(rings, "anchor", "left_semi").select(F.col("node").alias("a"))
    return pairs.join(inside, "a", "left_anti")


def identities(records: DataFrame, profile: str = "", folder: str | None = None) -> DataFrame:
    """(record_id, document_id, title, regulation_no, profile_id, unit_id) of every record that has a document.

    records: record_id, document_id, profile_id, regulation_title, regulation_no, document_name, canonical_title, regulation_id, supersedes_document_id and
    lineage_date (yyyy-mm-dd); all strings, any of them null. profile: for records without one."""
    folder = folder or shared_folder(records.sparkSession)
    rows = written(parted(records), folder, "records")
    parts = segments_of(rows, profile)
    several = parts.groupBy("owner", "document_id").agg(F.count_distinct("unit").alias("in_document"))
    parts = written(parts.join(several, ["owner", "document_id"]).withColumn("part", F.concat_ws("\n", "owner", "document_id", "unit")), folder, "segments")
    nodes = parts.groupBy("part", "owner", "document_id", "unit", "in_document").agg(
        F.when(F.count_distinct("stable_id") == 1, F.max("stable_id")).alias("stable_id"), F.when(F.count_distinct("replaces") == 1, F.max("replaces")).alias("replaces"),
        F.max("date").alias("date"), F.bool_or("in_collection").alias("in_collection"),
    )
    nodes = written(nodes, folder, "nodes")
    newer = replacements(nodes, folder)
    first = nodes.groupBy("owner", "unit").agg(F.min("part").alias("a"))
    same = nodes.join(first, ["owner", "unit"]).select("a", F.col("part").alias("b")).filter("a <> b")
    label = components(nodes.select(F.col("part").alias("node")), written(same.unionByName(id_links(nodes)).unionByName(newer), folder, "links"), f"{folder}/units")
    root = newer.select(F.col("b").alias("part")).join(newer.select(F.col("a").alias("part")), "part", "left_anti").withColumn("is_root", F.lit(True))
    order = F.struct(F.when(F.coalesce("date", F.lit("")) == "", LATEST).otherwise(F.col("date")), "unit", "document_id")
    met = nodes.join(label.withColumnRenamed("node", "part"), "part").join(root, "part", "left")
    best = met.groupBy("anchor").agg(F.coalesce(F.min_by("unit", F.when(F.col("is_root"), order)), F.min_by("unit", order)).alias("unit_id"))
    units = met.select("part", "anchor").join(best, "anchor").drop("anchor")
    known = parts.join(units, "part").select(*SEGMENT, "title", F.col("regulation_no").alias("number"), F.col("profile_id").alias("owner_id"), "unit_id")
    return rows.select("record_id", *SEGMENT).join(known, SEGMENT).select("record_id", "document_id", "title", F.col("number").alias("regulation_no"), F.col("owner_id").alias("profile_id"), "unit_id")
