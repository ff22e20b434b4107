"""Operator 13: the trie of all prefixes of conversations, with the sums over every subtree.

Turns are numbered without bringing a conversation into one task and become labels: 128 hash bits of role and text and the text's bytes. Each
conversation is cut into segments of SEGMENT labels, known by the hash of all before them, and equal segments after an equal beginning are one
row with a count, so thousands of copies of a conversation weigh as one.

A segment's rows are dealt into prefix shards: by the first label, and where the rows below a prefix hold over HEAVY labels, by the
first two, four, eight and so on. A shard is complete below its prefixes. numpy builds its trie in level order, a bitvector (for every node
a one per child, then a zero) beside arrays of labels; parents come from the ranks of the ones, and sums go up level by level in reverse with
add.at. The heavy upper levels, which many shards share, are merged by a grouping of what the shards' tops and the upper nodes themselves add to
each prefix above them. Segments are taken from the last to the first; what lies below a segment's end enters as sums of that node. What only one
conversation holds beyond a segment's start is a chain, which needs no trie.

Ids of the conversations that end at a node are hashed in order from a sorted stream, so memory stays small; a node at which many conversations end
is one task's work, since sha256 takes its bytes in one order.

Defined results: null roles and texts are empty. Turns are in order of turn (null first), then role, then text. Rows with a null conv_id belong to no
conversation. Repeated rows are repeated turns. An empty table gives no nodes. Long texts are read once, by their hashes. Other columns of any name
do not matter. Segments that several conversations share after equal beginnings take one round of jobs for each SEGMENT turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statuta.llm.common import pick
from statuta.operators.numbering import running
from statuta.session import shared_folder, table, written

SEGMENT = 128
HEAVY = 20_000
SHARD = 50_000
NO_ENDS = hashlib.sha256(b"").hexdigest()

NODES = (
    "least long, depth long, parent long, n long, children long, leaves long, saved long, sha string, "
    "p1 long, p2 long, top int, labels array<struct<a: long, b: long, z: long>>"
)
ENDS = "e1 long, e2 long, sha string"


@dataclass
class Louds:
    """A forest in level order: bits has a one for each child and a zero after them, for an unseen root and then for every node."""

    bits: np.ndarray
    levels: np.ndarray  # where each level's nodes start, and their number
    z: np.ndarray
    tops: np.ndarray  # a row of each node of the first level
    ends: np.ndarray  # the node at which each row ends

    def parents(self) -> np.ndarray:
        """-1 for nodes of the first level: zeros before a node's one, less the unseen root's."""
        return np.cumsum(~self.bits)[self.bits] - 1

    def degrees(self) -> np.ndarray:
        return np.diff(np.flatnonzero(~self.bits)) - 1


def grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group number of each row, a row of each group), groups in the order of the keys, the first key first."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new]


def build(g1: np.ndarray, g2: np.ndarray, top: np.ndarray, starts: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray, z: np.ndarray) -> Louds:
    """The forest of rows whose first `top` labels are one node of the first level, known by (g1, g2)."""
    at, first = grouped(g1, g2)
    sizes, degrees, values = [0, len(first)], [np.array([len(first)])], [z[starts[first] + top[first] - 1]]
    rows, level = np.arange(len(at)), 0
    while len(rows := rows[lengths[rows] - top[rows] > level]):
        label = starts[rows] + top[rows] + level
        number, some = grouped(at[rows], a[label], b[label])
        degrees.append(np.bincount(at[rows[some]] - sizes[-2], minlength=sizes[-1] - sizes[-2]))
        values.append(z[label[some]])
        at[rows] = sizes[-1] + number
        sizes.append(sizes[-1] + len(some))
        level += 1
    degrees.append(np.zeros(sizes[-1] - sizes[-2], np.int64))
    counts = np.concatenate(degrees)
    bits = np.ones(int(counts.sum()) + len(counts), bool)
    bits[np.cumsum(counts + 1) - 1] = False
    return Louds(bits, np.array(sizes), np.concatenate(values), first, at)


def shard_nodes(offset: int):
    """A function from the rows of some shards to their nodes; offset: the depth at which their segment starts."""

    def nodes(rows: pa.Table) -> pa.Table:
        column = lambda name, null=0: rows.column(name).fill_null(null).to_numpy().astype(np.int64)
        labels = rows.column("labels").combine_chunks()
        labels = labels.chunk(0) if isinstance(labels, pa.ChunkedArray) else labels
        lengths = labels.value_lengths().to_numpy().astype(np.int64)
        flat = labels.flatten()
        top = column("top")
        trie = build(column("g1"), column("g2"), top, np.cumsum(lengths) - lengths, lengths, *(flat.field(k).to_numpy() for k in range(3)))
        size, parent = len(trie.z), trie.parents()
        n, least = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max)
        np.add.at(n, trie.ends, column("n"))
        np.minimum.at(least, trie.ends, column("least"))
        steps = [slice(lo, hi) for lo, hi in zip(trie.levels[-2:0:-1].tolist(), trie.levels[:1:-1].tolist(), strict=True)]
        for s in steps:
            np.add.at(n, parent[s], n[s])
            np.minimum.at(least, parent[s], least[s])
        children, leaves, saved = trie.degrees(), np.zeros(size, np.int64), (n - 1) * trie.z
        np.add.at(children, trie.ends, column("below_children"))
        np.add.at(leaves, trie.ends, column("below_leaves"))
        np.add.at(saved, trie.ends, column("below_saved"))
        leaves += children == 0
        for s in steps:
            np.add.at(leaves, parent[s], leaves[s])
            np.add.at(saved, parent[s], saved[s])
        depth = np.zeros(size, np.int64)
        depth[: trie.levels[1]] = offset + top[trie.tops]
        for s in reversed(steps):
            depth[s] = depth[parent[s]] + 1
        row = np.zeros(size, np.int64)
        row[trie.ends] = np.arange(1, len(trie.ends) + 1)  # distinct rows end at distinct nodes
        sha = rows.column("sha").take(pa.array(row - 1, mask=row == 0))
        above = pa.array(np.where(parent >= 0, least[parent], 0), mask=parent < 0)
        from_top = lambda name: rows.column(name).take(pa.array(np.pad(trie.tops, (0, size - len(trie.tops))), mask=parent >= 0))
        columns = [pa.array(least), pa.array(depth), above, pa.array(n), pa.array(children), pa.array(leaves), pa.array(saved), sha]
        names = ["least", "depth", "parent", "n", "children", "leaves", "saved", "sha", "p1", "p2", "top", "labels"]
        return pa.table(columns + [from_top(k) for k in names[8:]], names=names)

    return nodes


def end_hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per (e1, e2) of sorted rows: the sha256 of its ids, comma-joined."""

    def out(keys: list, texts: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(texts, pa.string())], names=["e1", "e2", "sha"])

    key, digest = None, None
    for batch in batches:
        e1, e2, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("e1", "e2", "conv_id"))
        cuts = [0, *(np.flatnonzero((np.diff(e1) != 0) | (np.diff(e2) != 0)) + 1).tolist(), len(ids)]
        keys, texts = [], []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo == hi:
                continue
            now = (int(e1[lo]), int(e2[lo]))
            text = ",".join(map(str, ids[lo:hi].tolist())).encode()
            if now == key:
                digest.update(b"," + text)
                continue
            if key is not None:
                keys.append(key)
                texts.append(digest.hexdigest())
            key, digest = now, hashlib.sha256(text)
        yield out(keys, texts)
    if key is not None:
        yield out([key], [digest.hexdigest()])


def labelled(conversations: DataFrame, folder: str, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, place, a, b, z) of every turn: its number from 1 and its label."""
    rows = pick(conversations, conv_id=conv_id, turn=turn, role=role, text=text).filter(F.col("conv_id").isNotNull())
    rows = rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("role", "text")})
    placed = running(rows, ["conv_id"], ["turn", "role", "text"], None, "place", folder)
    a, b = F.xxhash64("role", "text"), F.xxhash64(F.lit(1), F.col("text"), F.col("role"))
    return written(placed.select("conv_id", "place", a.alias("a"), b.alias("b"), F.octet_length("text").cast("long").alias("z")), folder, "labels")


def key_pair(*values: Column) -> tuple[Column, Column]:
    return F.xxhash64(*values), F.xxhash64(F.lit(1), *values)


def segments_of(turns: DataFrame, segment: int) -> DataFrame:
    """(seg, p1, p2, e1, e2, labels, conv_id, last): p is the hash of all before a segment, e that of all up to its end."""
    label = F.transform(F.sort_array(F.collect_list(F.struct("place", "a", "b", "z"))), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), x["z"].alias("z")))
    parts = turns.groupBy("conv_id", F.floor((F.col("place") - 1) / segment).cast("int").alias("seg")).agg(label.alias("labels"))
    own = [x.cast("decimal(20,0)") for x in key_pair(F.col("seg"), F.col("labels"))]
    before = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("decimal(30,0)")
    parts = parts.withColumn("last", F.lead("seg").over(Window.partitionBy("conv_id").orderBy("seg")).isNull())
    parts = parts.withColumns({f"s{k}": F.coalesce(F.sum(x).over(before), zero) for k, x in enumerate(own)})
    p = key_pair(F.col("seg"), F.col("s0"), F.col("s1"))
    e = key_pair(F.col("seg") + 1, *[(F.col(f"s{k}") + x).cast("decimal(30,0)") for k, x in enumerate(own)])
    return parts.select("seg", p[0].alias("p1"), p[1].alias("p2"), e[0].alias("e1"), e[1].alias("e2"), "labels", "conv_id", "last")


def head(labels: Column, n: Column | int) -> Column:
    return F.slice(labels, 1, n)


def dealt(rows: DataFrame, folder: str, heavy: int, segment: int) -> tuple[DataFrame, DataFrame]:
    """(rows with top, the number of labels that name their shard; rows that end above every shard)."""
    rows = written(rows, folder, "rows")
    shards, ended, t = [], [rows.limit(0)], 1
    while True:
        if t > 1:
            ended.append(rows.filter(F.size("labels") < t))
            rows = rows.filter(F.size("labels") >= t)
        keyed = rows.withColumn("path", head(F.col("labels"), t))
        weights = keyed.groupBy("p1", "p2", "path").agg(F.sum(F.size("labels")).alias("weight"), F.count("*").alias("many"))
        hot = written(weights.filter((F.col("weight") > heavy) & (F.col("many") > 1)).select("p1", "p2", "path", F.lit(True).alias("hot")), folder, f"heavy{t}")
        if hot.isEmpty():
            shards.append(rows.withColumn("top", F.lit(t)))
            break
        marked = written(keyed.join(hot, ["p1", "p2", "path"], "left").drop("path"), folder, f"open{t}")
        shards.append(marked.filter(F.col("hot").isNull()).drop("hot").withColumn("top", F.lit(t)))
        rows, t = marked.filter("hot").drop("hot"), min(2 * t, segment)
    return reduce(DataFrame.unionByName, shards), reduce(DataFrame.unionByName, ended)


def upper_nodes(tops: DataFrame, ended: DataFrame, folder: str) -> DataFrame:
    """(p1, p2, prefix, n, least, children, leaves, saved, sha) of the nodes above all shards, the segment's start (an empty prefix) included."""
    none = F.lit(None).cast("string")
    adds = tops.select("p1", "p2", head(F.col("labels"), F.col("top")).alias("path"), F.lit(1).alias("is_top"), "n", "least", "leaves", "saved", none.alias("sha"))
    zero = F.lit(0).cast("long")
    adds = adds.unionByName(ended.select("p1", "p2", F.col("labels").alias("path"), F.lit(0).alias("is_top"), "n", "least", zero.alias("leaves"), zero.alias("saved"), "sha"))
    adds = adds.withColumn("reach", F.size("path") - F.col("is_top"))
    each = adds.select("p1", "p2", "path", "is_top", "n", "least", "leaves", "saved", "sha", "reach", F.explode(F.sequence(F.lit(0), F.col("reach"))).alias("d"))
    here = F.col("d") == F.col("reach")
    sums = each.groupBy("p1", "p2", head(F.col("path"), F.col("d")).alias("prefix")).agg(
        *[F.sum(c).alias(c) for c in ("n", "leaves", "saved")], F.min("least").alias("least"),
        F.sum(F.when(here, F.col("is_top")).otherwise(0)).alias("children"), F.max(F.when(here, F.col("sha"))).alias("sha"),
    )
    sums = written(sums, folder, "upper")
    keys = ["p1", "p2", "prefix"]
    kids = sums.filter(F.size("prefix") > 0).groupBy("p1", "p2", head(F.col("prefix"), F.size("prefix") - 1).alias("prefix")).agg(F.count("*").alias("kids"))
    full = sums.join(kids, keys, "left").withColumn("children", F.col("children") + F.coalesce("kids", F.lit(0)))
    full = full.withColumn("own", F.when(F.size("prefix") > 0, (F.col("n") - 1) * F.element_at("prefix", -1)["z"]).otherwise(0)).withColumn("leaf", (F.col("children") == 0).cast("long"))
    up = full.select("p1", "p2", "prefix", "own", "leaf", F.explode(F.sequence(F.lit(0), F.size("prefix"))).alias("d"))
    up = up.groupBy("p1", "p2", head(F.col("prefix"), F.col("d")).alias("prefix")).agg(F.sum("own").alias("owns"), F.sum("leaf").alias("leafs"))
    found = full.join(up, keys).select(*keys, "n", "least", "children", (F.col("leaves") + F.col("leafs")).alias("leaves"), (F.col("saved") + F.col("owns")).alias("saved"), "sha")
    return written(found, folder, "upper-sums")


def level(rows: DataFrame, offset: int, folder: str, segment: int, heavy: int, shard: int) -> tuple[DataFrame, DataFrame]:
    """(nodes of one segment, sums of what lies below each segment's start: p1, p2, below_children, below_leaves, below_saved)."""
    rows, ended = dealt(rows, folder, heavy, segment)
    total = rows.agg(F.sum(F.size("labels"))).first()[0] or 0
    g = key_pair(F.col("p1"), F.col("p2"), head(F.col("labels"), F.col("top")))
    keyed = rows.withColumns({"g1": g[0], "g2": g[1]}).withColumn("bucket", F.pmod(F.col("g1"), F.lit(1 + total // shard)))
    nodes = written(keyed.groupBy("bucket").applyInArrow(shard_nodes(offset), NODES), folder, "nodes")
    tops = nodes.filter(F.col("top").isNotNull())
    upper = upper_nodes(tops, ended, folder)
    starts = rows.select("p1", "p2", "entry").unionByName(ended.select("p1", "p2", "entry")).distinct()
    size = F.size("prefix")
    over = upper.join(starts, ["p1", "p2"]).select("p1", "p2", F.col("prefix").alias("above"), F.when(size == 0, F.col("entry")).otherwise(F.col("least")).alias("parent"))
    sums = ["least", "depth", "n", "children", "leaves", "saved", "sha"]
    deep = upper.filter(size > 0).select("p1", "p2", head(F.col("prefix"), size - 1).alias("above"), "least", (offset + size).cast("long").alias("depth"), *sums[2:])
    deep = deep.unionByName(tops.select("p1", "p2", head(F.col("labels"), F.col("top") - 1).alias("above"), *sums))
    whole = deep.join(over, ["p1", "p2", "above"]).select(*sums, "parent")
    below = upper.filter(size == 0).select("p1", "p2", *[F.col(c).alias(f"below_{c}") for c in ("children", "leaves", "saved")])
    return nodes.filter(F.col("top").isNull()).select(*sums, "parent").unionByName(whole), below


def chains(rows: DataFrame, segment: int) -> DataFrame:
    """Nodes of segments that only one conversation holds from their start on."""
    each = rows.select("*", F.posexplode("labels").alias("at", "label"))
    end = (F.col("at") == F.size("labels") - 1) & (F.col("n_end") > 0)
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    return each.select(
        "least", (F.col("seg") * segment + F.col("at") + 1).cast("long").alias("depth"), one.alias("n"), F.when(end, none).otherwise(one).alias("children"), one.alias("leaves"),
        none.alias("saved"), F.when(end, F.col("sha")).alias("sha"), F.when(F.col("at") == 0, F.col("entry")).otherwise(F.col("least")).alias("parent"),
    )


def prefix_trie(turns: DataFrame, ids: DataFrame, folder: str, segment: int = SEGMENT, heavy: int = HEAVY, shard: int = SHARD) -> DataFrame:
    """One row per node of the trie of turns (conv_id, place from 1, a, b, z); ids: every conversation (conv_id), those without turns too.

    Columns: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    parts = written(segments_of(turns, segment), folder, "segments")
    root = key_pair(F.lit(-1))
    bare = ids.join(parts.select("conv_id").distinct(), "conv_id", "left_anti").select(root[0].alias("e1"), root[1].alias("e2"), "conv_id")
    ends = parts.filter("last").select("e1", "e2", "conv_id").unionByName(bare)
    ends = written(ends.repartition("e1", "e2").sortWithinPartitions("e1", "e2", "conv_id").mapInArrow(end_hashes, ENDS), folder, "ends")
    same = parts.groupBy("seg", "p1", "p2", "e1", "e2", "labels").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), F.sum(F.col("last").cast("int")).alias("n_end"))
    same = written(same.join(ends, ["e1", "e2"], "left"), folder, "distinct")
    deepest = same.agg(F.max("seg")).first()[0] or 0
    whole = ids.agg(F.count("*").alias("n"), F.min("conv_id").alias("least")).filter("n > 0")
    first = whole.first()
    entry = F.lit(first["least"] if first else None).cast("long")
    found, below = [], None
    if deepest:
        befores = same.select(F.col("e1").alias("p1"), F.col("e2").alias("p2"), F.col("least").alias("entry"))
        members = same.filter("seg > 0").groupBy("p1", "p2").agg(F.sum("n").alias("members"))
        later = written(same.filter("seg > 0").join(members, ["p1", "p2"]).join(befores, ["p1", "p2"]), folder, "later")
        alone = later.filter("members = 1")
        found.append(chains(alone, segment))
        one = F.lit(1).cast("long")
        below = alone.select("p1", "p2", one.alias("below_children"), one.alias("below_leaves"), F.lit(0).cast("long").alias("below_saved"))
        shared = later.filter("members > 1").agg(F.max("seg")).first()[0] or 0
    for j in range(shared if deepest else 0, -1, -1):
        rows = later.filter((F.col("members") > 1) & (F.col("seg") == j)).drop("members") if j else same.filter("seg = 0").withColumn("entry", entry)
        if below is not None:
            rows = rows.join(below.withColumnsRenamed({"p1": "e1", "p2": "e2"}), ["e1", "e2"], "left")
        else:
            rows = rows.withColumns({c: F.lit(None).cast("long") for c in ("below_children", "below_leaves", "below_saved")})
        nodes, now = level(rows.drop("n_end"), j * segment, f"{folder}/level{j}", segment, heavy, shard)
        found.append(nodes)
        below = now if j == 0 or below is None else now.unionByName(below)
    zero = F.lit(0).cast("long")
    sums = whole.crossJoin(F.broadcast(below.agg(*[F.sum(f"below_{c}").alias(c) for c in ("children", "leaves", "saved")])))  # one row each
    top = sums.select("least", zero.alias("depth"), "n", *[F.coalesce(c, zero).alias(c) for c in ("children", "leaves", "saved")], root[0].alias("e1"), root[1].alias("e2"))
    top = top.join(ends, ["e1", "e2"], "left").drop("e1", "e2").withColumn("parent", F.lit(None).cast("long")).withColumn("leaves", F.greatest("leaves", F.lit(1)))
    return reduce(DataFrame.unionByName, found, top).select(
        F.col("least").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("sha", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, folder: str | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of a table of turns."""
    folder = folder or shared_folder(conversations.sparkSession)
    turns = labelled(conversations, folder, conv_id, turn, role, text)
    return prefix_trie(turns, turns.select("conv_id").distinct(), folder)


def rebuilt(turns: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """The query's conversations: the first h turns are those of conversation c - c % 5, h being crc32(c) % 9; (turns, ids)."""
    h = (F.crc32(F.col("conv_id").cast("string")) % 9).alias("h")
    heads = turns.filter("place <= 8")
    counts = heads.groupBy(F.col("conv_id").alias("base")).agg(F.max("place").alias("heads"))
    ids = turns.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), h)
    ids = written(ids.join(counts, "base", "left").withColumn("m", F.coalesce(F.least("h", "heads"), F.lit(0).cast("long"))).drop("heads"), folder, "ids")
    own = turns.join(ids.drop("base"), "conv_id").filter("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("m")).alias("place"), "a", "b", "z")
    borrowed = ids.join(heads.withColumnRenamed("conv_id", "base"), "base").filter("place <= m").select("conv_id", "place", "a", "b", "z")
    return own.unionByName(borrowed), ids.select("conv_id")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    turns, ids = rebuilt(labelled(table(spark, sf_dir, "conversations"), folder), folder)
    return prefix_trie(turns, ids, folder)


#: crc32 of a decimal number: for every byte, the byte and eight shifts.
CRC_SQL = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''),
    lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"""

OP13_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list([role, text] ORDER BY turn NULLS FIRST, role, text) AS said FROM t GROUP BY conv_id),
cut AS (SELECT conv_id, said, conv_id - conv_id % 5 AS base, {CRC_SQL} % 9 AS h FROM own),
whole AS (SELECT c.conv_id, list_concat(coalesce(b.said[1:c.h], []), c.said[c.h + 1:]) AS said FROM cut c LEFT JOIN own b ON b.conv_id = c.base),
pre AS (SELECT conv_id, len(said) AS ends, d, said[1:d] AS path FROM (SELECT conv_id, said, unnest(range(len(said) + 1)) AS d FROM whole)),
nodes AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends = d), '')) AS sha
    FROM pre GROUP BY path, d),
kids AS (SELECT path[1:d - 1] AS path, d - 1 AS d, count(*) AS k FROM nodes WHERE d > 0 GROUP BY 1, 2),
full_nodes AS (SELECT n.*, coalesce(k, 0) AS k, CASE WHEN n.d = 0 THEN 0 ELSE (n - 1) * strlen(n.path[n.d][2]) END AS own
    FROM nodes n LEFT JOIN kids ON kids.d = n.d AND kids.path = n.path),
up AS (SELECT path[1:e] AS path, e AS d, sum(own) AS saved, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) AS leaves
    FROM (SELECT *, unnest(range(d + 1)) AS e FROM full_nodes) GROUP BY 1, 2)
SELECT f.conv_id, f.d::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n::BIGINT AS n_convs, f.k::BIGINT AS n_children, up.leaves::BIGINT AS n_leaves,
    up.saved::BIGINT AS saved_tokens, f.sha AS ends_sha256
FROM full_nodes f JOIN up ON up.d = f.d AND up.path = f.path LEFT JOIN nodes p ON p.d = f.d - 1 AND p.path = f.path[1:f.d - 1] AND f.d > 0"""
