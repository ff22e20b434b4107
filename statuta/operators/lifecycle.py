"""Versions and lifecycle: what is in force on a day, derived ends, current flags, transitions, diffs and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statuta.functions.dates import effective_on

# Manual transitions of a regulation's status.
TRANSITIONS = {"draft": ["pending_approval"], "pending_approval": ["draft"], "approved": ["superseded", "repealed"], "superseded": ["repealed"], "repealed": []}
DEAD = ("superseded", "repealed", "rejected")


def latest_in_force(versions: DataFrame, unit: str, day: Column, start: str, end: Column, repealed: Column, order: list[Column]) -> DataFrame:
    """The first version by `order` of those in force on a day, one for each unit."""
    live = versions.filter(effective_on(day, F.col(start), end, repealed))
    place = Window.partitionBy(unit).orderBy(*order)
    return live.withColumn("place", F.row_number().over(place)).filter("place = 1").drop("place")


def derived_ends(versions: DataFrame, unit: str, start: str, end: str | None, key: str) -> DataFrame:
    """effective_to: the day before the unit's next version starts, if that is earlier than its own end."""
    follow = F.date_sub(F.lead(start).over(Window.partitionBy(unit).orderBy(start, key)), 1)
    own = F.col(end) if end else F.lit(None).cast("date")
    return versions.withColumn("effective_to", F.least(own, follow))


def current_flags(versions: DataFrame, unit: str, day: Column, start: str, key: str) -> DataFrame:
    """is_current for the version with the latest start not after the day (ties: the larger key)."""
    best = F.max(F.when(F.col(start) <= day, F.struct(start, key))).over(Window.partitionBy(unit))
    return versions.withColumn("is_current", F.coalesce(F.struct(start, key) == best, F.lit(False)))


def transition_errors(events: DataFrame, current: str, target: str, reason: str) -> DataFrame:
    """events with `error` (null: allowed): unknown target, no change, not a transition, no reason for an end."""
    allowed = F.create_map(*[F.lit(x) for k, v in TRANSITIONS.items() for x in (k, ",".join(v))])
    ways = F.split(F.coalesce(F.try_element_at(allowed, F.col(current)), F.lit("")), ",")
    known = F.col(target).isin("draft", "pending_approval", "superseded", "repealed")
    error = (
        F.when(~known, "unknown target")
        .when(F.col(target) == F.col(current), "no change")
        .when(~F.array_contains(ways, F.col(target)), "invalid transition")
        .when(F.col(target).isin("superseded", "repealed") & (F.trim(F.coalesce(F.col(reason), F.lit(""))) == ""), "reason required")
    )
    return events.withColumn("error", error)


def diff(before: DataFrame, after: DataFrame, key: str, content: str) -> DataFrame:
    """(key, change): added, removed, changed or unchanged by the content's hash. Rows of one key pair one to one, those of equal content first, so a key that
    repeats has as many changes as the longer side has rows."""
    side = lambda df, a, b: df.select(key, F.sha2(F.col(content).cast("string"), 256).alias("h"), F.lit(a).alias("n0"), F.lit(b).alias("n1"))
    rows = side(before, 1, 0).unionByName(side(after, 0, 1)).groupBy(key, "h").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    same = F.least("n0", "n1")
    sums = rows.groupBy(key).agg(F.sum(same).alias("same"), F.sum(F.col("n0") - same).alias("old"), F.sum(F.col("n1") - same).alias("new"))
    paired = F.least("old", "new")
    parts = {"unchanged": F.col("same"), "changed": paired, "removed": F.col("old") - paired, "added": F.col("new") - paired}
    changes = F.concat(*[F.array_repeat(F.lit(name), n.cast("int")) for name, n in parts.items()])
    return sums.select(key, F.explode(changes).alias("change"))


def upsert(stored: DataFrame, incoming: DataFrame, key: str, content: str, kept: str) -> DataFrame:
    """Rows after an upsert with `action` (insert, update, unchanged, removed); `kept` (an embedding, say) stays while the content does."""
    s, i = stored.alias("s"), incoming.alias("i")
    both = s.join(i, F.col(f"s.{key}") == F.col(f"i.{key}"), "full_outer")
    same = F.col(f"s.{content}").eqNullSafe(F.col(f"i.{content}"))
    action = F.when(F.col(f"s.{key}").isNull(), "insert").when(F.col(f"i.{key}").isNull(), "removed").when(same, "unchanged").otherwise("update")
    return both.select(
        F.coalesce(f"i.{key}", f"s.{key}").alias(key),
        F.coalesce(f"i.{content}", f"s.{content}").alias(content),
        F.when(same, F.coalesce(f"i.{kept}", f"s.{kept}")).otherwise(F.col(f"i.{kept}")).alias(kept),
        action.alias("action"),
    )


def unit_id(profile: Column, title: Column) -> Column:
    return F.concat(F.lit("regunit-"), F.substring(F.sha2(F.concat_ws("\n", profile, title), 256), 1, 20))


def newest_decision(journal: DataFrame, keys: list[str], at: str, decision: str) -> DataFrame:
    """The newest decision of each key; two rows at the newest time void it (null)."""
    place = F.rank().over(Window.partitionBy(*keys).orderBy(F.desc(at)))
    newest = journal.withColumn("place", place).filter("place = 1").groupBy(*keys)
    return newest.agg(F.when(F.count("*") == 1, F.first(decision)).alias("decision"), F.count("*").alias("n_newest"))
