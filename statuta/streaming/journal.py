"""The review journal as state: each document's chunk keeps its newest decision, and what that changes in its approval goes out.

Events may come late and in any order: the state holds the newest time, how many events have it and whether an event without tenant or time voids the chunk, so that after all
events it is the same for every cut of the journal into batches. An event that comes twice counts twice, as in the journal.

A batch is aggregated and joined to the states of its chunks; new states go to a folder for each batch beside the checkpoint, which a batch that is run again replaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("document_id", "chunk_id", "tenant_id", "approval_id", "approved_content_hash", "at", "decision")
STATE = (
    "document_id string, chunk_id string, void boolean, at string, n long, tenant_id string, approval_id string, approved_content_hash string, decision string, "
    "change long, approved boolean, changed boolean"
)
CHANGE = "document_id string, chunk_id string, change long, approved boolean, tenant_id string, approval_id string, approved_content_hash string"


def filled(name: str) -> Column:
    return F.coalesce(F.trim(F.col(name)) != "", F.lit(False))


def newest_events(events: DataFrame) -> DataFrame:
    """(document_id, chunk_id, void, at, n, the other fields): one row for each chunk of some events, with how many have the newest time."""
    good = filled("tenant_id") & filled("at")
    rows = events.select(*FIELDS[:2], F.when(good, F.col("at")).alias("at"), F.when(good, F.struct(*[c for c in FIELDS[2:] if c != "at"])).alias("said"))
    rows = rows.groupBy(*FIELDS[:2], "at").agg(F.count("*").alias("n"), F.min("said").alias("said"))
    last = F.max(F.when(F.col("at").isNotNull(), F.struct("at", "n", "said"))).alias("last")
    rows = rows.groupBy(*FIELDS[:2]).agg(F.max(F.col("at").isNull()).alias("void"), last)
    return rows.select(*FIELDS[:2], "void", "last.at", F.coalesce("last.n", F.lit(0)).alias("n"), "last.said.*")


def merged(fresh: DataFrame, held: DataFrame) -> DataFrame:
    """The states of chunks with new events (newest_events) after the states they had; changed: the approval is another than before, or rests on another event."""
    old = held.select(*FIELDS[:2], F.struct(*[c for c in held.columns if c not in FIELDS[:2]]).alias("old"))
    both = fresh.select(*FIELDS[:2], F.struct(*[c for c in fresh.columns if c not in FIELDS[:2]]).alias("new")).join(old, list(FIELDS[:2]), "left")
    later = F.col("old.at").isNull() | F.coalesce(F.col("new.at") > F.col("old.at"), F.lit(False))
    equal = F.coalesce(F.col("new.at") == F.col("old.at"), F.lit(False))
    take = lambda c: F.when(later, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c)
    n = F.when(later, F.col("new.n")).when(equal, F.col("new.n") + F.col("old.n")).otherwise(F.col("old.n"))
    void = F.col("new.void") | F.coalesce("old.void", F.lit(False))
    proof = ("tenant_id", "approval_id", "approved_content_hash")
    rows = both.select(*FIELDS[:2], "old", void.alias("void"), take("at"), n.alias("n"), *[take(c) for c in (*proof, "decision")])
    approved = ~F.col("void") & (F.col("n") == 1) & F.coalesce(F.col("decision") == "approved", F.lit(False)) & filled(proof[0]) & filled(proof[1]) & filled(proof[2])
    was = F.coalesce("old.approved", F.lit(False))
    rows = rows.withColumn("approved", approved)
    other = ~F.struct(*proof).eqNullSafe(F.struct(*[F.col(f"old.{c}") for c in proof]))
    rows = rows.withColumn("changed", (F.col("approved") != was) | (F.col("approved") & other))
    return rows.withColumn("change", F.coalesce("old.change", F.lit(0)) + F.col("changed").cast("long")).select(*[c.split()[0] for c in STATE.split(", ")])


def approvals(changes: DataFrame) -> DataFrame:
    """What is approved after all changes so far: each chunk's last one, if it approves. A change that was written twice counts once."""
    last = F.row_number().over(Window.partitionBy("document_id", "chunk_id").orderBy(F.desc("change")))
    return changes.withColumn("last", last).filter("last = 1 and approved").drop("last", "change", "approved")


def write_changes(journal: DataFrame, out: str, checkpoint: str) -> None:
    """All events available now; each batch's changes (CHANGE: every change of a chunk's approval, numbered for each chunk) go to a folder of its own. journal: a stream with FIELDS."""
    events = journal.select(*[F.col(c).cast("string").alias(c) for c in FIELDS]).filter("document_id is not null and chunk_id is not null")
    states = f"{checkpoint}/chunk_states"

    def put(batch: DataFrame, number: int) -> None:
        spark, keys = batch.sparkSession, list(FIELDS[:2])
        fresh = newest_events(batch)
        held = spark.createDataFrame([], STATE)
        if number:
            past = spark.read.schema(f"{STATE}, batch long").parquet(states).filter(F.col("batch") < number)
            own = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("batch")))
            held = past.withColumn("own", own).filter("own = 1").drop("own", "batch")
        merged(fresh, held).write.mode("overwrite").parquet(f"{states}/batch={number}")
        after = spark.read.schema(STATE).parquet(f"{states}/batch={number}").filter("changed")
        said = [F.when(F.col("approved"), F.col(c)).alias(c) for c in ("tenant_id", "approval_id", "approved_content_hash")]
        after.select(*keys, "change", "approved", *said).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
