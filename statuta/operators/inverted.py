"""A segmented inverted index over records, kept in a `store.Store`.

A segment is a set of records: `forward` has their terms (by record), `postings` the same by term, in buckets of the term's hash and in order of the term within,
`terms` how many records each term gained or lost. Terms that begin as article numbers do share one bucket of their own, so a prefix of them is a range of it.
An update writes one segment with the records of the changed groups and marks the copies they replace as dead; the statistics in the manifest move by
the difference, and nothing else is written. `compact` writes buckets that updates have touched anew and leaves the others where they are.

A search reads the buckets of its terms. Term counts per field stay apart (`tfs`), so weights are the search's choice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.operators.store import Store

BUCKETS = 64
NUMBERS = BUCKETS  # the bucket of terms like article numbers
NUMBER_LIKE = "^제[0-9]"
POSTING = ["bucket", "term", "key", "unit", "segment", "tfs", "len"]

#: Makes (key, grp, unit, hash, len, terms: map of term to counts by field) of records.
Analysis = Callable[[DataFrame], DataFrame]


def bucket_of(term: Column) -> Column:
    return F.when(term.rlike(NUMBER_LIKE), NUMBERS).otherwise(F.pmod(F.xxhash64(term), F.lit(BUCKETS))).cast("int")


def prints(content: Column) -> list[Column]:
    """Two sums of independent 64-bit hashes: they do not depend on order and can be added to and taken from."""
    return [F.sum(F.coalesce(h.cast("decimal(20,0)"), F.lit(0))) for h in (F.xxhash64(content), F.xxhash64(F.lit(1), content))]


def fingerprint(records: DataFrame, content_hash: str = "content_hash") -> str:
    """An order-independent mark of all content hashes: their number and two sums; equal for an index over the same records."""
    row = records.agg(F.count("*").alias("n"), *[p.alias(f"s{k}") for k, p in enumerate(prints(F.col(content_hash)))]).first()
    return f"{row['n']}-{int(row['s0'] or 0)}-{int(row['s1'] or 0)}"


def totals(forward: DataFrame) -> tuple[int, int, int, int]:
    """(records, summed lengths, both fingerprint sums) in one row."""
    row = forward.agg(F.count("*").alias("n"), F.sum("len").alias("len"), *[p.alias(f"s{k}") for k, p in enumerate(prints(F.col("hash")))]).first()
    return row["n"], int(row["len"] or 0), int(row["s0"] or 0), int(row["s1"] or 0)


def term_changes(forward: DataFrame, sign: int) -> DataFrame:
    return forward.select(F.explode(F.map_keys("terms")).alias("term")).groupBy("term").agg((F.count("*") * sign).alias("df"))


def schemas_of(forward: DataFrame) -> dict[str, str]:
    """The schemas of an index's files, by the records' key; a segment without records has no files that tell."""
    key = forward.schema["key"].dataType.simpleString()
    return {
        "forward": f"key {key}, grp string, unit string, hash string, len int, terms map<string, array<int>>, segment string",
        "postings": f"term string, key {key}, unit string, segment string, tfs array<int>, len int, bucket int",
        "terms": "term string, df long, bucket int",
        "dead": f"key {key}, segment string",
    }


def stored(spark: SparkSession, manifest: dict, name: str, *paths: str) -> DataFrame:
    return spark.read.schema(manifest["schemas"][name]).parquet(*paths)


def write_segment(forward: DataFrame, data: str, segment: str, lost: DataFrame | None = None) -> dict:
    """forward: (key, grp, unit, hash, len, terms); lost: forward rows whose terms count no more."""
    forward.withColumn("segment", F.lit(segment)).write.parquet(f"{data}/forward")
    stored = forward.sparkSession.read.schema(schemas_of(forward)["forward"]).parquet(f"{data}/forward")
    rows = stored.select("key", "unit", "segment", "len", F.explode("terms").alias("term", "tfs")).withColumn("bucket", bucket_of(F.col("term")))
    write_postings(rows.select(*POSTING), f"{data}/postings")
    changes = term_changes(stored, 1) if lost is None else term_changes(stored, 1).unionByName(term_changes(lost, -1))
    write_terms(changes, f"{data}/terms")
    return {"id": segment, "forward": f"{data}/forward", "postings": f"{data}/postings", "terms": f"{data}/terms", "without": []}


def write_postings(rows: DataFrame, path: str) -> None:
    """Ranges of (bucket, term, key): a frequent term is many tasks' work, and within a file terms stand in order, so a filter on them skips row groups."""
    rows.repartitionByRange("bucket", "term", "key").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(path)


def write_terms(changes: DataFrame, path: str) -> None:
    summed = changes.groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0").withColumn("bucket", bucket_of(F.col("term")))
    summed.repartitionByRange("bucket", "term").write.partitionBy("bucket").parquet(path)


def mark(n: int, s0: int, s1: int) -> str:
    return f"{n}-{s0}-{s1}"


def build(store: Store, records: DataFrame, analyse: Analysis, kind: str, tables: dict[str, DataFrame] | None = None) -> dict:
    """A new version that holds all records in one segment, and other tables (catalog, contents, references …) beside them."""
    before = store.read()
    data = store.new_data()
    forward = analyse(records)
    schemas = schemas_of(forward)
    segment = write_segment(forward, data, data[-32:])
    named = {}
    for name, rows in (tables or {}).items():
        rows.write.parquet(f"{data}/table-{name}")
        named[name] = f"{data}/table-{name}"
    n, length, s0, s1 = totals(store.spark.read.schema(schemas["forward"]).parquet(segment["forward"]))
    manifest = {"kind": kind, "schemas": schemas, "segments": [segment], "dead": [], "tables": named, "n": n, "length": length, "sums": [str(s0), str(s1)], "fingerprint": mark(n, s0, s1), "data": [data]}
    return store.commit(manifest, before and before["number"])


def forward_of(spark: SparkSession, manifest: dict) -> DataFrame:
    """(key, grp, unit, hash, len, terms, segment) of the records that count."""
    return without_dead(spark, manifest, stored(spark, manifest, "forward", *[s["forward"] for s in manifest["segments"] if s["forward"]]))


def without_dead(spark: SparkSession, manifest: dict, rows: DataFrame) -> DataFrame:
    if not manifest["dead"]:
        return rows
    return rows.join(stored(spark, manifest, "dead", *manifest["dead"]), ["key", "segment"], "left_anti")


def update(store: Store, changed: DataFrame, groups: DataFrame, analyse: Analysis, kind: str, whole: DataFrame, before_print: str | None = None) -> tuple[dict, bool]:
    """(manifest, incremental). changed: the records that groups (grp) have now; a group without records is removed. Without an index of this kind, or
    where before_print (the records' fingerprint before the change) is not the index's, everything is built anew from `whole`."""
    old = store.read()
    if old is None or old["kind"] != kind or (before_print is not None and before_print != old["fingerprint"]):
        return build(store, whole, analyse, kind, {name: store.spark.read.parquet(path) for name, path in (old or {"tables": {}})["tables"].items()}), False
    spark, data = store.spark, store.new_data()
    lost = forward_of(spark, old).join(groups.select("grp").distinct(), "grp", "left_semi")
    lost.write.parquet(f"{data}/lost")
    lost = stored(spark, old, "forward", f"{data}/lost")
    segment = write_segment(analyse(changed), data, data[-32:], lost)
    lost.select("key", "segment").write.parquet(f"{data}/dead")
    new, gone = totals(stored(spark, old, "forward", segment["forward"])), totals(lost)
    n, length, s0, s1 = (a + b - c for a, b, c in zip((old["n"], old["length"], *map(int, old["sums"])), new, gone, strict=True))
    manifest = old | {
        "segments": [*old["segments"], segment], "dead": [*old["dead"], f"{data}/dead"], "n": n, "length": length, "sums": [str(s0), str(s1)], "fingerprint": mark(n, s0, s1),
        "data": [*old["data"], data],
    }
    return store.commit(manifest, old["number"]), True


def compact(store: Store) -> dict:
    """A version in which every bucket that an update touched is one segment's again; other buckets keep their files."""
    old, spark = store.read(), store.spark
    later = [s for s in old["segments"][1:] if s["terms"]]
    touched = sorted({r[0] for s in later for r in stored(spark, old, "terms", s["terms"]).select("bucket").distinct().collect() if r[0] not in s["without"]})  # at most BUCKETS + 1 a segment
    if not touched:
        return old
    data = store.new_data()
    write_postings(live_postings(spark, old, touched).select(*POSTING), f"{data}/postings")
    write_terms(term_rows(spark, old, touched).select("term", "df"), f"{data}/terms")
    kept = [s | {"without": sorted({*s["without"], *touched})} for s in old["segments"]]
    made = {"id": data[-32:], "forward": None, "postings": f"{data}/postings", "terms": f"{data}/terms", "without": []}
    return store.commit(old | {"segments": [*kept, made], "data": [*old["data"], data]}, old["number"])


def part(spark: SparkSession, manifest: dict, name: str, buckets: list[int]) -> DataFrame | None:
    """Rows of some buckets, of every segment that has them."""
    parts = []
    for s in manifest["segments"]:
        wanted = [b for b in buckets if b not in s["without"]]
        if s[name] and wanted:
            parts.append(stored(spark, manifest, name, s[name]).filter(F.col("bucket").isin(wanted)))
    return reduce(DataFrame.unionByName, parts) if parts else None


def live_postings(spark: SparkSession, manifest: dict, buckets: list[int]) -> DataFrame:
    return without_dead(spark, manifest, part(spark, manifest, "postings", buckets))


def term_rows(spark: SparkSession, manifest: dict, buckets: list[int]) -> DataFrame:
    """(term, df) of some buckets, one row a segment."""
    return part(spark, manifest, "terms", buckets)


@dataclass(frozen=True)
class Inverted:
    """An index version, opened: its manifest is here, its rows stay where they are."""

    spark: SparkSession
    manifest: dict

    @classmethod
    def open(cls, spark: SparkSession, folder: str, number: int | None = None) -> Inverted:
        manifest = Store(spark, folder).read(number)
        if manifest is None:
            raise FileNotFoundError(f"no index in {folder}")
        return cls(spark, manifest)

    @property
    def n(self) -> int:
        return self.manifest["n"]

    @property
    def avg_len(self) -> float:
        return round(self.manifest["length"] / self.n, 6) if self.n else 0.0

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.manifest["tables"][name])

    def buckets(self, terms: list[str]) -> list[int]:
        rows = self.spark.createDataFrame([(t,) for t in terms], "term string")
        return sorted({r[0] for r in rows.select(bucket_of(F.col("term"))).collect()})  # of one query's terms

    def matches(self, terms: list[str], prefixes: list[str] = []) -> DataFrame:  # noqa: B006
        """(key, unit, len, term, tfs) of records that count; a prefix is given as the term. Only the terms' buckets are read, and the range of a prefix."""
        wanted = list(dict.fromkeys(terms))
        rows, exact = None, F.col("term").isin(wanted)
        if wanted:
            rows = live_postings(self.spark, self.manifest, self.buckets(wanted)).filter(exact)
        for p in dict.fromkeys(prefixes):
            after = p[:-1] + chr(ord(p[-1]) + 1)
            found = live_postings(self.spark, self.manifest, self.buckets([p])).filter((F.col("term") >= p) & (F.col("term") < after)).withColumn("term", F.lit(p))
            rows = found if rows is None else rows.unionByName(found)
        return rows.select("key", "unit", "len", "term", "tfs")

    def frequencies(self, terms: list[str]) -> dict[str, int]:
        """In how many records each term is; terms in none are left out."""
        wanted = list(dict.fromkeys(terms))
        rows = term_rows(self.spark, self.manifest, self.buckets(wanted)).filter(F.col("term").isin(wanted)).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
        return {r["term"]: r["df"] for r in rows.collect()}  # at most a row for each query term
