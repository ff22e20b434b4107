"""Operator 11: lines that repeat across documents.

Every text is split at line feeds. A line's key is the line without ASCII white space at its ends, A-Z in lower case; keys of at least
MIN_CHARS characters that are in at least MIN_DOCUMENTS documents lose all their lines but those of the least doc_id that has them.

The lines are exploded into hashes of their keys and aggregated per hash (partial sums first, so a line that a third of all documents
have is a row per task); the repeated hashes are written and joined back to the exploded hashes, which gives the places to drop of each
text, and the text is put together again from the places left. Lines themselves are never shuffled, texts once. Both joins read written
tables on their smaller side, so that adaptive execution can split a hot hash or a hot document. Hashes have 96 bits. DataFrame
functions only.

Defined results: null and empty texts are one empty line, which stays; a text that loses every line becomes empty. Keys shorter
than MIN_CHARS are never dropped. Rows of one doc_id are one document, whose lines all stay or go alike; rows with a null doc_id are one
document too, after all others. An empty table gives no rows. Very long texts are handled whole: the places of one text are the
largest thing that is gathered. Extra columns of any name do not matter.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.llm.common import pick
from statuta.session import shared_folder, table, written

MIN_CHARS = 10
MIN_DOCUMENTS = 2
BLANKS = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """lower() does more than A-Z, but not to ASCII."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def exploded(base: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, version, place, h, g) of every line whose key is long enough; version tells apart texts of one doc_id."""
    rows = base.select("doc_id", F.xxhash64("text").alias("version"), F.posexplode(lines_of(F.col("text"))).alias("place", "line"))
    keyed = rows.select("doc_id", "version", "place", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    return keyed.select("doc_id", "version", "place", F.xxhash64("key").alias("h"), F.hash("key").alias("g"))


def repeated_keys(lines: DataFrame, min_documents: int) -> DataFrame:
    """(h, g, first): keys of enough documents and the least doc_id that has each. Two documents show in the least and greatest id,
    which needs neither a list of ids nor a second shuffle; for more, ids are counted."""
    if min_documents > 2:
        lines = lines.select("h", "g", "doc_id").distinct()
    many = (F.min("doc_id") < F.max("doc_id")) | (F.bool_or(F.col("doc_id").isNull()) & F.min("doc_id").isNotNull())
    enough = F.lit(True) if min_documents < 2 else many if min_documents == 2 else F.count("*") >= min_documents
    return lines.groupBy("h", "g").agg(F.min("doc_id").alias("first"), enough.alias("enough")).filter(F.coalesce("enough", F.lit(False))).drop("enough")


def dedup_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_chars: int = MIN_CHARS, doc_id: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, text without repeated lines, n_lines before, n_dropped."""
    folder = folder or shared_folder(docs.sparkSession)
    base = pick(docs, doc_id=doc_id, text=text)
    lines = exploded(base, min_chars)
    repeated = written(repeated_keys(lines, min_documents), folder, "repeated-lines")
    late = lines.join(repeated, ["h", "g"]).filter(~F.col("doc_id").eqNullSafe(F.col("first")))
    drops = written(late.groupBy("doc_id", "version").agg(F.collect_set("place").alias("places")), folder, "dropped-lines")
    drops = drops.select(F.col("doc_id").alias("drop_id"), F.col("version").alias("drop_version"), "places")
    versions = base.withColumn("version", F.xxhash64("text"))
    met = versions.join(drops, versions.doc_id.eqNullSafe(drops.drop_id) & (versions.version == drops.drop_version), "left")
    split = met.select("doc_id", "text", "places", lines_of(F.col("text")).alias("lines"))
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    kept = F.array_join(F.transform(F.array_except(every, "places"), lambda i: F.get("lines", i)), "\n")
    return split.select(
        F.col("doc_id").alias(doc_id),
        F.when(F.col("places").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept).alias(text),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rn, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS key FROM l),
r AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCUMENTS}),
j AS (SELECT k.*, coalesce(r.first <> doc_id, false) AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY rn, doc_id"""
