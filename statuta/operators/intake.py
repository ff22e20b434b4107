"""What a new file is: title, regulation, version, dates and predecessor, from its name, its text and the documents that are there.

A value comes from the text where the text says it, else from the name, else from what follows from other values; every value is given with its source. The
predecessor is the newest approved document of the same regulation (by id, or by a title that is the same without dates and editions). Documents are summed up
per regulation before they meet a file, so a regulation with very many versions is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statuta.functions.dates import all_dates, leading_history, near_dates

#: What a file name holds besides a title; each is replaced in turn.
NAME_NOISE = (
    (r"^\s*\d+(?:\s*-\s*\d+){1,5}\s*[.)]?\s*", ""),  # classification numbers
    (r"(?<!\d)(?:19|20)\d{2}\s*[.\-/년]\s*(?:0?[1-9]|1[0-2])\s*[.\-/월]\s*(?:0?[1-9]|[12]\d|3[01])\s*일?(?!\d)", " "),
    (r"(?<!\d)(?:(?:19|20)\d{6}|\d{6})(?!\d)", " "),
    (r"(?i)(?:^|[\s_\-(\[])(?:v|ver(?:sion)?)\s*\d+(?:\.\d+)*", " "),
    (r"제\s*\d+\s*차\s*(?:일부\s*|전부\s*)?개정", " "),
    (r"(?:일부|전부)?\s*개정(?:본|판|안)?|통합본|(?:최종|최신)(?:본|안)?", " "),
    (r"(?i)\b(?:final|latest|revised|revision|copy)\b", " "),
    (r"\(\s*\d+\s*\)$", " "), (r"[\[\](){}]", " "), (r"[_\-]+", " "), (r"\s+", " "), (r"^[ ._-]+|[ ._-]+$", ""),
    (r"((?:규정|규칙|지침|요령|예규|기준|지침서|강령|규약))\s*\d+$", "$1"), (r"(?:일부|전부)$", ""),
)
TITLE_END = r"(?:규정|규칙|지침|요령|세칙|정관|내규|기준|편람|강령|규약)$"
NO_TITLE = r"^(?:제정|개정|시행|부칙|제1조)"
VERSION = r"(?i)(?:^|[\s_\-(\[])(?:v|ver(?:sion)?)\s*(\d+(?:\.\d+)*)"
SEQUENCE = r"제\s*(\d+)\s*차\s*(?:일부\s*|전부\s*)?개정"
REVISED = ("개정", "일부개정", "전문개정", "전부개정", "타규정개정")
IN_FORCE = ("시행일", "시행", "효력", "적용일")
TITLE_LINES = 80
VERSION_CHARS = 5000
MOST_ID = 64


def stem(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"^.*[/\\]", ""), r"(?<=.)\.[^.]*$", "")


def name_title(name: Column) -> Column:
    """The title in a file name; the name itself where nothing else is left."""
    whole = F.trim(stem(name))
    out = whole
    for pattern, instead in NAME_NOISE:
        out = F.regexp_replace(out, pattern, instead)
    out = F.trim(out)
    return F.when(whole == "", "regulation").when(out == "", whole).otherwise(out)


def text_title(text: Column) -> Column:
    """The first line near the head of a text that ends as titles of regulations do."""
    lines = F.slice(F.split(F.coalesce(text, F.lit("")), r"\r\n?|\n"), 1, TITLE_LINES)
    bare = F.transform(lines, lambda x: F.btrim(F.regexp_replace(F.trim(x), r"\s+", " "), F.lit(" -·:[]()")))
    return F.get(F.filter(bare, lambda x: F.length(x).between(2, 100) & ~x.rlike(NO_TITLE) & x.rlike(TITLE_END)), 0)


def regulation_id(title: Column) -> Column:
    """A key of a title: its letters and digits joined by '-', ended by a hash where it is long."""
    key = F.regexp_replace(F.regexp_replace(F.lower(F.trim(title)), "[^0-9a-z가-힣]+", "-"), "^-+|-+$", "")
    key = F.when(key == "", F.substring(F.sha2(title, 256), 1, 16)).otherwise(key)
    short = F.concat(F.regexp_replace(F.substring(key, 1, MOST_ID - 11), "-+$", ""), F.lit("-"), F.substring(F.sha2(key, 256), 1, 10))
    return F.concat(F.lit("reg-"), F.when(F.length(key) > MOST_ID, short).otherwise(key))


def family_key(title: Column) -> Column:
    """The same for all editions of a regulation."""
    return F.regexp_replace(F.lower(name_title(title)), "[^0-9a-z가-힣]+", "")


def name_dates(name: Column) -> Column:
    """Calendar dates of a file name in the order they stand: written ones, eight digits, six digits (to 69 of this century)."""
    digits = r"(?<!\d)(?:(?:19|20)\d{6}|\d{6})(?!\d)"
    written = r"\d{4}\s*(?:[.\-/]|년)\s*\d{1,2}\s*(?:[.\-/]|월)\s*\d{1,2}"
    found = F.regexp_extract_all(stem(name), F.lit(f"({written}|{digits})"), 1)
    century = lambda x: F.when(F.substring(x, 1, 2).cast("int") <= 69, "20").otherwise("19")
    plain = lambda x: F.try_to_date(F.when(F.length(x) == 8, x).otherwise(F.concat(century(x), x)), "yyyyMMdd")
    dates = F.transform(found, lambda x: F.when(x.rlike(r"^(?:\d{8}|\d{6})$"), plain(x)).otherwise(F.get(all_dates(x), 0)))
    return F.array_distinct(F.filter(dates, lambda x: x.isNotNull()))


def explicit_version(text: Column) -> Column:
    """rev-N of the Nth revision, or vN."""
    nth, v = F.regexp_extract(text, SEQUENCE, 1), F.regexp_extract(text, VERSION, 1)
    return F.when(nth != "", F.concat(F.lit("rev-"), nth.cast("long").cast("string"))), F.when(v != "", F.concat(F.lit("v"), v))


def numbers(version: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(version, F.lit("")), F.lit(r"(\d+)"), 1), lambda x: x.cast("long"))


def regulations(documents: DataFrame) -> DataFrame:
    """(key, owner, tenant, newest, highest): for every regulation, by id and by title, its newest approved document and the highest first number of a version; owner and
    tenant null: over all of them. documents: document_id, document_name, filename, regulation_id, regulation_version, regulation_status, effective_from, revision_date,
    created_at, profile_id, tenant_id."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    title = family_key(F.coalesce(F.nullif("document_name", F.lit("")), "filename"))
    keys = F.array(F.when(low("regulation_id") != "", F.concat(F.lit("id:"), low("regulation_id"))), F.when(title != "", F.concat(F.lit("title:"), title)))
    day = F.coalesce(F.nullif("effective_from", F.lit("")), "revision_date", F.lit(""))
    order = F.named_struct(F.lit("day"), day, F.lit("numbers"), numbers(F.col("regulation_version")), F.lit("created_at"), F.col("created_at"), F.lit("document_id"), F.col("document_id"))
    approved = F.when(low("regulation_status") == "approved", F.named_struct(F.lit("order"), order, F.lit("id"), F.trim(F.coalesce("regulation_id", F.lit("")))))
    rows = documents.select(F.explode(F.array_compact(F.array_distinct(keys))).alias("key"), low("profile_id").alias("owner"), low("tenant_id").alias("tenant"), approved.alias("approved"), F.get(numbers(F.col("regulation_version")), 0).alias("first"))
    return rows.cube("key", "owner", "tenant").agg(F.max("approved").alias("newest"), F.coalesce(F.max("first"), F.lit(0).cast("long")).alias("highest")).filter("key is not null")


def inferred(files: DataFrame, documents: DataFrame, today: str) -> DataFrame:
    """files with document_name, regulation_id, regulation_version, revision_date, effective_from, supersedes_document_id, title_source, revision_date_source,
    effective_from_source and version_source. files: file_id, filename, text, profile_id, tenant_id."""
    history = leading_history(F.col("text"))
    of_name, of_text = F.array_max(F.slice(F.reverse(name_dates(F.col("filename"))), 1, 1)), F.array_max(all_dates(F.coalesce("text", F.lit(""))))
    told = lambda part, words: F.coalesce(F.array_max(part), F.array_max(near_dates(F.coalesce("text", F.lit("")), words)))
    rows = files.withColumns({
        "in_text": text_title(F.col("text")), "in_name": name_title(F.col("filename")), "revised": told(history["revised"], REVISED), "in_force": told(history["in_force"], IN_FORCE),
        "text_day": of_text, "name_day": of_name,
    })
    rows = rows.withColumn("title", F.coalesce("in_text", "in_name"))
    day, from_text = F.to_date(F.lit(today)), F.col("revised").isNotNull() | F.col("text_day").isNotNull()
    rows = rows.withColumns({
        "revision_date": F.coalesce("revised", "text_day", "name_day", day), "effective_from": F.coalesce("in_force", "revised", "text_day", "name_day", day),
        "revision_date_source": F.when(from_text, "content").when(F.col("name_day").isNotNull(), "filename").otherwise("upload_date"),
        "effective_from_source": F.when(F.col("in_force").isNotNull() | from_text, "content").when(F.col("name_day").isNotNull(), "filename").otherwise("revision_date"),
    })
    asked = lambda c: F.nullif(F.lower(F.trim(F.coalesce(c, F.lit("")))), F.lit(""))
    keys = F.array(F.concat(F.lit("id:"), F.lower(regulation_id(F.col("title")))), F.concat(F.lit("title:"), family_key(F.col("title"))))
    wanted = rows.select("file_id", F.explode(keys).alias("key"), asked("profile_id").alias("owner"), asked("tenant_id").alias("tenant")).alias("w")
    known = regulations(documents).alias("k")
    same = (F.col("w.key") == F.col("k.key")) & F.col("w.owner").eqNullSafe(F.col("k.owner")) & F.col("w.tenant").eqNullSafe(F.col("k.tenant"))
    before = wanted.join(known, same).groupBy("file_id").agg(F.max("newest").alias("newest"), F.max("highest").alias("highest"))
    rows = rows.join(before, "file_id", "left")
    head = F.substring(F.coalesce("text", F.lit("")), 1, VERSION_CHARS)
    (nth, v), (name_nth, name_v) = explicit_version(head), explicit_version(stem(F.col("filename")))
    dated = F.when(F.col("revision_date_source") != "upload_date", F.concat(F.lit("rev-"), F.date_format("revision_date", "yyyyMMdd")))
    version = F.coalesce(nth, v, name_v, name_nth, dated, F.concat(F.lit("v"), (F.coalesce("highest", F.lit(0)) + 1).cast("string")))
    source = F.when(F.coalesce(nth, v).isNotNull(), "content").when(F.coalesce(name_v, name_nth).isNotNull(), "filename").when(dated.isNotNull(), F.col("revision_date_source")).otherwise("sequence")
    return rows.select(
        *files.columns, F.col("title").alias("document_name"), F.coalesce(F.nullif("newest.id", F.lit("")), regulation_id(F.col("title"))).alias("regulation_id"), version.alias("regulation_version"),
        F.col("revision_date").cast("string").alias("revision_date"), F.col("effective_from").cast("string").alias("effective_from"), F.col("newest.order.document_id").alias("supersedes_document_id"),
        F.when(F.col("in_text").isNotNull(), "content").otherwise("filename").alias("title_source"), "revision_date_source", "effective_from_source", source.alias("version_source"),
    )


def chained(files: DataFrame) -> DataFrame:
    """Files of one upload (with the columns of `inferred`) with the file that each follows, before_file_id: of its regulation, profile and tenant, the latest that comes into force
    earlier; null where two come into force on that day, since it is then not known which."""
    family = [family_key(F.col("document_name")).alias("family"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("profile_id", "tenant_id")]]
    days = files.groupBy(*family, "effective_from").agg(F.count("*").alias("n"), F.min("file_id").alias("one"))
    by = Window.partitionBy("family", "profile_id", "tenant_id").orderBy("effective_from")
    earlier = days.withColumn("before_file_id", F.when(F.lag("n").over(by) == 1, F.lag("one").over(by))).drop("n", "one")
    keyed = files.withColumn("family", family_key(F.col("document_name"))).alias("f")
    same = [F.col("f.family") == F.col("e.family"), F.col("f.effective_from") == F.col("e.effective_from"), *[F.coalesce(f"f.{c}", F.lit("")) == F.col(f"e.{c}") for c in ("profile_id", "tenant_id")]]
    return keyed.join(earlier.alias("e"), same).select(*[f"f.{c}" for c in files.columns], "e.before_file_id")
