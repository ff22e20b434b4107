"""Operator 9: sharding by extendible hashing.

A document's key and text give a string of 60 hash bits. The directory starts with one bucket; a bucket whose bytes
exceed the limit splits on its next bit, and only such buckets split. A shard is therefore the shortest
prefix whose bytes fit. The directory is found without a loop over splits: bytes are summed per hash prefix
of a fixed depth, rolled up to every shorter prefix, and each prefix cell takes its shortest fitting prefix.
Prefixes that still exceed the limit go on, the same way, with further bits.

No step brings a hot prefix together: sums are partial first, and a step rolls up at most 2**STEP_BITS cells under an open prefix.

Defined results: an empty table gives no rows. A null key hashes like any value; a null text has 0 bytes; one row larger than the limit is
a shard of its own (oversized). Rows whose key and text are all equal cannot be parted by a hash: when their
bucket still exceeds the limit at the last bit, it gets overflow pages, each within the limit, numbered from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statuta.llm.common import pick
from statuta.session import shared_folder, table, written

SHARD_BYTES = 4 * 1024 * 1024
STEP_BITS = 12
LAST_BIT = 60


def prefix(bits: Column, depth: Column | int) -> Column:
    return F.substring(bits, F.lit(1), depth if isinstance(depth, Column) else F.lit(depth))


def hash_bits(value: Column, digits: int) -> Column:
    """The first hex digits of a value's md5 as bits; null counts as a value of its own."""
    whole = F.md5(F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("")))
    return F.lpad(F.conv(F.substring(whole, 1, digits), 16, 2), 4 * digits, "0")


def split_cells(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """The directory for cells (cell, bytes, n) whose first low bits don't fit: (cell, depth); depth null: still too large."""
    depths = F.sequence(F.lit(low), F.lit(high))
    ups = cells.select("cell", "bytes", "n", F.explode(depths).alias("depth"))
    ups = ups.select("cell", "bytes", "n", "depth", prefix(F.col("cell"), F.col("depth")).alias("up"))
    sums = ups.groupBy("depth", "up").agg(F.sum("bytes").alias("up_bytes"), F.sum("n").alias("up_n"))
    fits = sums.filter((F.col("up_bytes") <= limit) | (F.col("up_n") <= 1)).select("depth", "up")
    found = ups.join(fits, ["depth", "up"]).groupBy("cell").agg(F.min("depth").alias("depth"))
    return cells.select("cell").join(found, "cell", "left")


def shard(
    rows: DataFrame, key: str = "doc_id", text: str = "text", limit: int = SHARD_BYTES, step: int = STEP_BITS, folder: str | None = None
) -> DataFrame:
    """One row per input row: key, n_bytes, shard_id (bits, '-' and page), depth, page, oversized."""
    base = pick(rows, key=key, text=text).select(
        "key",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.concat(hash_bits(F.col("key"), 11), hash_bits(F.col("text"), 4)).alias("bits"),
    )
    spark = rows.sparkSession
    folder = folder or shared_folder(spark)
    base = written(base, folder, "sizes")
    low, directories, open_rows = 0, [], base
    while low <= LAST_BIT:
        high = min(LAST_BIT, low + step)
        cells = open_rows.groupBy(prefix(F.col("bits"), high).alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n"))
        found = written(split_cells(cells, low, high, limit), folder, f"directory{low}")
        directories.append((high, found))
        rest = found.filter(F.col("depth").isNull()).select("cell")
        if high == LAST_BIT or rest.isEmpty():
            break
        open_rows = base.withColumn("cell", prefix(F.col("bits"), high)).join(rest, "cell", "left_semi").drop("cell")
        low = high + 1
    placed = base.withColumn("depth", F.lit(None).cast("int"))
    for high, found in directories:
        cell = found.select(F.col("cell"), F.col("depth").alias("found"))
        placed = placed.withColumn("cell", prefix(F.col("bits"), high)).join(cell, "cell", "left")
        placed = placed.select("key", "n_bytes", "bits", F.coalesce("depth", "found").cast("int").alias("depth"))
    fitting = placed.filter(F.col("depth").isNotNull()).withColumn("page", F.lit(0))
    # Rows that no bit parts are paged by their number: rows are counted per partition of what is written, so none are brought together.
    over = written(placed.filter(F.col("depth").isNull()).withColumn("part", F.spark_partition_id()), folder, "overflow")
    counts = over.groupBy("bits", "part").agg(F.count("*").alias("n"), F.max("n_bytes").alias("longest"))
    parts = Window.partitionBy("bits").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    longest = F.max("longest").over(Window.partitionBy("bits"))
    places = counts.select("bits", "part", F.coalesce(F.sum("n").over(parts), F.lit(0)).alias("before"), longest.alias("longest"))
    number = F.col("before") + F.row_number().over(Window.partitionBy("bits", "part").orderBy("n_bytes", "key")) - 1
    per_page = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.lit(1), F.col("longest"))))
    over = over.join(places, ["bits", "part"]).withColumn("page", (1 + F.floor(number / per_page)).cast("int"))
    over = over.withColumn("depth", F.lit(LAST_BIT)).select("key", "n_bytes", "bits", "depth", "page")
    return fitting.unionByName(over).select(
        F.col("key").alias(key),
        "n_bytes",
        F.concat_ws("-", prefix(F.col("bits"), F.col("depth")), F.col("page")).alias("shard_id"),
        "depth",
        "page",
        (F.col("n_bytes") > limit).alias("oversized"),
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "shard_id", "depth", "page", "oversized")


OP9_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
    lpad(bin(('0x' || substr(md5(coalesce('=' || doc_id::VARCHAR, '')), 1, 11))::UBIGINT), 44, '0')
    || lpad(bin(('0x' || substr(md5(coalesce('=' || text, '')), 1, 4))::UBIGINT), 16, '0') AS bits FROM documents),
ups AS (SELECT rn, n_bytes, bits, unnest(generate_series(0, {LAST_BIT})) AS depth FROM d),
sums AS (SELECT depth, bits[1:depth] AS up FROM ups GROUP BY 1, 2 HAVING sum(n_bytes) <= {SHARD_BYTES} OR count(*) <= 1),
found AS (SELECT rn, min(u.depth) AS depth FROM ups u JOIN sums s ON s.depth = u.depth AND s.up = u.bits[1:u.depth] GROUP BY rn),
paged AS (SELECT d.*, depth, CASE WHEN depth IS NOT NULL THEN 0 ELSE 1 + (row_number() OVER (PARTITION BY bits ORDER BY n_bytes) - 1)
    // greatest(1, {SHARD_BYTES} // greatest(1, max(n_bytes) OVER (PARTITION BY bits))) END AS page FROM d LEFT JOIN found USING (rn))
SELECT doc_id, n_bytes, bits[1:coalesce(depth, {LAST_BIT})] || '-' || page AS shard_id, coalesce(depth, {LAST_BIT})::INT AS depth, page::INT AS page,
    n_bytes > {SHARD_BYTES} AS oversized FROM paged"""
