"""Reference graphs: resolution of references, edges with evidence, cycles, co-occurrence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statuta.session import shared_folder, written


def resolve(references: DataFrame, units: DataFrame, scope: list[str], ref: str, keys: list[str], unit: str) -> DataFrame:
    """references with n_candidates, target and status: resolved (one unit by the first key that knows the name), ambiguous, unresolved.

    keys are columns of units in order of precedence (number, title, alias)."""
    named = None
    for rank, key in enumerate(keys):
        part = units.filter(F.col(key).isNotNull()).select(*scope, F.col(key).alias(ref), F.lit(rank).alias("rank"), unit)
        named = part if named is None else named.unionByName(part)
    by_name = named.distinct().groupBy(*scope, ref, "rank").agg(F.count("*").alias("n_candidates"), F.min(unit).alias("target"))
    first = by_name.withColumn("place", F.row_number().over(Window.partitionBy(*scope, ref).orderBy("rank"))).filter("place = 1").drop("place", "rank")
    out = references.join(first, [*scope, ref], "left")
    status = F.when(F.col("n_candidates") == 1, "resolved").when(F.col("n_candidates") > 1, "ambiguous").otherwise("unresolved")
    return out.select(
        *references.columns, F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), F.when(F.col("n_candidates") == 1, F.col("target")).alias("target"), status.alias("status")
    )


def merged_edges(edges: DataFrame, source: str, target: str, evidence: str) -> DataFrame:
    """One row per (source, target): mentions and the first evidence by order."""
    return edges.groupBy(source, target).agg(F.count("*").alias("mentions"), F.min(evidence).alias("evidence"))


MOST_ARCS = 1_000_000


def components_of(arcs: list[tuple]) -> list[tuple]:
    """(node, least node of its component, size) of strongly connected components of two nodes or more and of self loops, in linear time."""
    ways: dict = {}
    for u, v in arcs:
        ways.setdefault(u, []).append(v)
        ways.setdefault(v, [])
    number, low, held, stack, out = {}, {}, set(), [], []
    for start in ways:
        if start in number:
            continue
        number[start] = low[start] = len(number)
        stack.append(start)
        held.add(start)
        path = [(start, iter(ways[start]))]
        while path:
            node, rest = path[-1]
            step = next(rest, None)
            if step is None:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[node])
                if low[node] == number[node]:
                    part = []
                    while not part or part[-1] != node:
                        part.append(stack.pop())
                        held.discard(part[-1])
                    if len(part) > 1 or node in ways[node]:
                        least = min(part)
                        out += [(n, least, len(part)) for n in part]
            elif step not in number:
                number[step] = low[step] = len(number)
                stack.append(step)
                held.add(step)
                path.append((step, iter(ways[step])))
            elif step in held:
                low[node] = min(low[node], number[step])
    return out


def walked(arcs: DataFrame) -> DataFrame:
    """(scope, node, cycle_id, size) of arcs (scope, u, v), one group a scope."""
    kinds = dict(arcs.dtypes)

    def walk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = components_of(list(zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True)))
        return pd.DataFrame([(key[0], *f) for f in found], columns=["scope", "node", "cycle_id", "size"])

    return arcs.groupBy("scope").applyInPandas(walk, f"scope {kinds['scope']}, node {kinds['u']}, cycle_id {kinds['u']}, size long")


def cycles(edges: DataFrame, source: str, target: str, scope: str | None = None, most: int = MOST_ARCS) -> DataFrame:
    """(scope,) node, cycle_id, size: strongly connected components of two nodes or more, and self loops. cycle_id: the least node.

    Arcs of a scope (an institution's units, thousands) are one group, walked in linear time; a scope with more than `most` arcs loses those that lead nowhere and
    is coloured if it still has more: labels spread forward and back in rounds that are written, so no larger graph meets in one task."""
    kind = dict(edges.dtypes)[source]
    rows = edges.select((F.col(scope) if scope else F.lit(0)).alias("scope"), F.col(source).alias("u"), F.col(target).alias("v")).distinct()
    sizes = rows.groupBy("scope").agg(F.count("*").alias("arcs"))
    large = sizes.filter(F.col("arcs") > most).select("scope")

    out = walked(rows.join(large, "scope", "left_anti"))
    if not large.isEmpty():
        out = out.unionByName(coloured(rows.join(large, "scope", "left_semi"), most))
    return out.withColumnRenamed("scope", scope) if scope else out.drop("scope")


def trimmed(arcs: DataFrame, folder: str, turn: int, most: int) -> tuple[DataFrame, int]:
    """arcs without those to or from a node that no arc enters or leaves, again and again: such nodes are in no cycle. Ends when that changes nothing or no scope
    has more than `most` arcs; the second value is how many the largest scope has."""

    def sizes() -> tuple[int, int]:
        row = arcs.groupBy("scope").count().agg(F.sum("count"), F.max("count")).first()
        return row[0] or 0, row[1] or 0

    (n, largest), step = sizes(), 0
    while largest > most:
        step += 1
        enters, leaves = arcs.select("scope", F.col("v").alias("u")).distinct(), arcs.select("scope", F.col("u").alias("v")).distinct()
        arcs = written(arcs.join(enters, ["scope", "u"], "left_semi").join(leaves, ["scope", "v"], "left_semi").select("scope", "u", "v"), folder, f"trim{turn}-{step}")
        after, largest = sizes()
        if after == n:
            break
        n = after
    return arcs, largest


def coloured(arcs: DataFrame, most: int = 0) -> DataFrame:
    """The same for graphs of any size. Every node takes the least label that reaches it; the nodes of one label that reach its root are a component; they leave,
    with all arcs between labels, and what is left goes round again, until no scope has more than `most` arcs: those are walked."""
    folder, found, turn = shared_folder(arcs.sparkSession), None, 0
    left = written(arcs, folder, "arcs0")
    own = written(left.filter("u = v").select("scope", F.col("u").alias("node")), folder, "loops")
    left = left.filter("u <> v")
    while True:
        turn += 1
        left, largest = trimmed(left, folder, turn, most)
        if largest <= most:
            if largest:
                rest = written(walked(left).select("scope", "node", F.col("cycle_id").alias("label")), folder, "walked")
                found = rest if found is None else found.unionByName(rest)
            break
        nodes = left.select("scope", F.col("u").alias("node")).unionByName(left.select("scope", F.col("v").alias("node"))).distinct()
        labels, step = written(nodes.withColumn("label", F.col("node")), folder, f"label{turn}-0"), 0
        while True:  # forward
            step += 1
            come = left.join(labels.withColumnRenamed("node", "u"), ["scope", "u"]).groupBy("scope", F.col("v").alias("node")).agg(F.min("label").alias("other"))
            fresh = labels.join(come, ["scope", "node"], "left").select("scope", "node", F.col("label").alias("old"), F.least("label", F.coalesce("other", "label")).alias("label"))
            fresh = written(fresh, folder, f"label{turn}-{step}")
            labels = fresh.select("scope", "node", "label")
            if fresh.filter("old <> label").isEmpty():
                break
        inner = left.join(labels.withColumnsRenamed({"node": "u", "label": "lu"}), ["scope", "u"]).join(labels.withColumnsRenamed({"node": "v", "label": "lv"}), ["scope", "v"]).filter("lu = lv").select("scope", "u", "v", F.col("lu").alias("label"))
        inner = written(inner, folder, f"inner{turn}")
        back, n, step = written(labels.filter("node = label"), folder, f"back{turn}-0"), -1, 0
        while True:  # back from the roots
            step += 1
            more = inner.join(back.withColumnRenamed("node", "v"), ["scope", "v", "label"]).select("scope", F.col("u").alias("node"), "label")
            back = written(back.unionByName(more).distinct(), folder, f"back{turn}-{step}")
            count = back.count()
            if count == n:
                break
            n = count
        found = back if found is None else found.unionByName(back)
        gone = back.select("scope", "node")
        left = left.join(gone.withColumnRenamed("node", "u"), ["scope", "u"], "left_anti").join(gone.withColumnRenamed("node", "v"), ["scope", "v"], "left_anti").select("scope", "u", "v")
        left = written(left, folder, f"arcs{turn}")
    if found is None:
        found = own.withColumn("label", F.col("node")).limit(0)
    found = found.unionByName(own.join(found, ["scope", "node"], "left_anti").withColumn("label", F.col("node")))
    sizes = found.groupBy("scope", "label").agg(F.count("*").alias("size"))
    whole = found.join(sizes, ["scope", "label"])
    loops = own.withColumn("loop", F.lit(True))
    whole = whole.join(loops, ["scope", "node"], "left").filter("size > 1 or loop")
    return whole.select("scope", "node", F.col("label").alias("cycle_id"), "size")


def top_terms(weights: DataFrame, key: str, term: str, weight: str, most: int = 12) -> DataFrame:
    """The `most` heaviest terms of each key; ties: the longer, then by name."""
    order = Window.partitionBy(key).orderBy(F.desc(weight), F.desc(F.length(term)), term)
    return weights.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def cooccurrence(terms: DataFrame, key: str, term: str) -> DataFrame:
    """(a, b, weight) of terms that share keys; each key has a bounded number of terms (see top_terms)."""
    a, b = terms.select(key, F.col(term).alias("a")), terms.select(key, F.col(term).alias("b"))
    return a.join(b, key).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("weight"))


def first_of_each(edges: list[DataFrame], edge_id: str, order: str) -> DataFrame:
    """Union of edge families; of edges with one id the first stays."""
    union = edges[0]
    for more in edges[1:]:
        union = union.unionByName(more)
    return union.withColumn("place", F.row_number().over(Window.partitionBy(edge_id).orderBy(order))).filter("place = 1").drop("place")


def components(nodes: DataFrame, links: DataFrame, folder: str) -> DataFrame:
    """(node, anchor): the least node that links (a, b) reach, whatever their direction. By repeated least labels: a round joins every label with those
    of its neighbours and of its own label, so rounds grow with the logarithm of the longest chain."""
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), folder, "pairs")
    labels, step = written(nodes.select(F.col("node").alias("a"), F.col("node").alias("anchor")), folder, "labels0"), 0
    while True:
        step += 1
        near = both.join(labels.select(F.col("a").alias("b"), "anchor"), "b").groupBy("a").agg(F.min("anchor").alias("other"))
        low = labels.join(near, "a", "left").select("a", F.col("anchor").alias("old"), F.least("anchor", F.coalesce("other", "anchor")).alias("anchor"))
        # A label's own label may be lower by now, and who lends a label out hears of lower ones.
        heard = low.groupBy(F.col("old").alias("a")).agg(F.min("anchor").alias("told"))
        low = low.join(heard, "a", "left").select("a", "old", F.least("anchor", F.coalesce("told", "anchor")).alias("anchor"))
        jump = low.select(F.col("a").alias("anchor"), F.col("anchor").alias("further"))
        fresh = written(low.join(jump, "anchor", "left").select("a", "old", F.least("anchor", F.coalesce("further", "anchor")).alias("anchor")), folder, f"labels{step}")
        if fresh.filter("old <> anchor").isEmpty():
            return fresh.select(F.col("a").alias("node"), "anchor")
        labels = fresh.select("a", "anchor")


def lineage(documents: DataFrame, supersedes: DataFrame, key: str) -> DataFrame:
    """(key, anchor): documents that supersede one another in a chain share the least of their keys.

    supersedes: (newer, older). Only one-to-one edges count."""
    once = lambda c: supersedes.groupBy(c).agg(F.count("*").alias("k")).filter("k = 1").select(c)
    pairs = supersedes.join(once("newer"), "newer", "left_semi").join(once("older"), "older", "left_semi")
    found = components(documents.select(F.col(key).alias("node")), pairs.select(F.col("newer").alias("a"), F.col("older").alias("b")), shared_folder(documents.sparkSession))
    return found.withColumnRenamed("node", key)
