"""The journal stream against the journal read at once, for any cut into batches."""

import random

from statuta.operators import governance
from statuta.streaming import journal

KEYS = "document_id string, chunk_id string, tenant_id string, approval_id string, approved_content_hash string"
EVENT = f"{KEYS}, at string, decision string"


def streamed(spark, path, rows, cuts):
    events = spark.createDataFrame(rows, EVENT)
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        spark.createDataFrame(rows[a:b], EVENT).coalesce(1).write.parquet(f"{path}/in/{i}")
        stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").parquet(f"{path}/in")
        journal.write_changes(stream, f"{path}/out", f"{path}/checkpoint")
    return spark.read.schema(journal.CHANGE).option("recursiveFileLookup", "true").parquet(f"{path}/out")


def test_every_cut_ends_alike(spark, tmp_path):
    r = random.Random(5)
    rows = [("d", f"c{r.randrange(12)}", r.choice(["t", "t", "t", "t", "t", ""]), "a", f"h{r.randrange(2)}", f"2024-01-{r.randrange(1, 9):02d}", r.choice(["approved", "approved", "rejected"])) for _ in range(40)]
    chunks = spark.createDataFrame([("d", f"c{i}", "t", "a", f"h{j}", "Approved") for i in range(12) for j in range(2)], f"{KEYS}, approval_status string")
    whole = {(x["chunk_id"], x["approved_content_hash"]) for x in governance.journal_approved(chunks, spark.createDataFrame(rows, EVENT)).collect()}
    assert whole
    for k, cuts in enumerate(([], [3, 21])):
        changes = streamed(spark, str(tmp_path / str(k)), rows, cuts)
        assert {(x["chunk_id"], x["approved_content_hash"]) for x in journal.approvals(changes).collect()} == whole


def test_changes_go_out(spark, tmp_path):
    one = lambda at, decision, content="h": ("d", "c", "t", "a", content, at, decision)
    rows = [one("1", "approved"), one("3", "rejected"), one("2", "approved"), one("4", "approved", "g"), one("4", "approved", "g"), (None, "c", "t", "a", "h", "9", "approved")]
    changes = streamed(spark, str(tmp_path), rows, [1, 2, 3, 4]).orderBy("change").collect()
    # approved, rejected, (a late one changes nothing), approved again, voided by a second event at one time
    assert [(c["approved"], c["approved_content_hash"]) for c in changes] == [(True, "h"), (False, None), (True, "g"), (False, None)]


def test_states_are_made_by_spark(spark):
    events = spark.createDataFrame([("d", "c", "t", "a", "h", at, "approved") for at in ("1", "2", "2", "")], EVENT)
    held = spark.createDataFrame([("d", "c", False, "2", 1, "t", "a", "h", "approved", 4, True, True), ("d", "b", False, "2", 1, "t", "a", "h", "approved", 4, True, True)], journal.STATE)
    state = journal.merged(journal.newest_events(events), held)
    assert "Python" not in state._jdf.queryExecution().toString() and "Pandas" not in state._jdf.queryExecution().toString()
    assert [(r["chunk_id"], r["void"], r["at"], r["n"], r["change"], r["approved"], r["changed"]) for r in state.collect()] == [("c", True, "2", 3, 5, False, True)]
