"""Operator 3: n-gram Jaccard join with set-relation skipping.

A document's set is its distinct word shingles, held as 64-bit fingerprints. Two documents link when
7 * |intersection| >= 3 * (|a| + |b|), the integer form of Jaccard >= 0.75. The result is exact: every link of the
whole table is in it or implied by links in it.

1. Equal sets are one class (128-bit digest), so copies are joined once.
2. Prefix index: shingles have one global order, those found often in a sample last. A set of n enters the lists of its
   first n - ceil(3n/4) + 1 shingles; sets that link share one of them. Lists hold position and size.
3. Answers of a similar set: each list compares its members with its pivot set only (a list of more than SHORT_LIST with
   PIVOTS of them, so that a large group of near copies hangs together). Members of one component need no
   further comparison. For two members x, y of different components the answer follows incrementally from the pivot's answers:
   |x & y| is at most |p & y| + |x - p| and at least |p & x| + |p & y| - |p|. All in integers, so pairs at exactly 3/4 are decided rightly.
4. Block skipping: what is left of a long list is cut into blocks by ranges of size (from the histogram of the list, so no list is ordered in
   one task), with their ranges of size and position; pairs of blocks whose ranges rule a link out are skipped whole, the rest are filtered pair by pair.
5. A candidate pair is first bounded by sketches (how many shingles fall in each of as many cells as there are shingles: the
   smaller of two cells bounds what they share), then what is left is verified by whole sets.

No list, class or component is collected: lists are sorted runs, blocks have at most BLOCK members.
The order of shingles changes speed only. It comes from a hash sample of documents (1 in SAMPLE), and at most HOT_SHINGLES of the
most frequent go to every task.

Defined results: null and blank texts have an empty set, link with nothing and are their own component. A null id stays
null; its component is the least id that it reaches, null if there is none. Rows that repeat an id are rows like any others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statuta.llm.common import pick, slices
from statuta.llm.components import components
from statuta.llm.hashing import shingles
from statuta.session import shared_folder, table, written

WIDTH = 5
SAMPLE = 16
HOT_SHINGLES = 1_000_000
BLOCK = 256
SHORT_LIST = 64
PIVOTS = 20
MOST_CELLS = 4096
BROADCAST_IDS = 2_000_000


def digest_of(fps: np.ndarray) -> bytes:
    return hashlib.blake2b(fps.tobytes(), digest_size=16).digest()


def class_of(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def prefix_length(n: int) -> int:
    return n - -(-3 * n // 4) + 1


def ordered(fps: np.ndarray, hot: np.ndarray, often: np.ndarray) -> np.ndarray:
    """A set in the global order: rare shingles by value, then the often found ones, rarer first."""
    if not len(hot):
        return fps
    at = np.minimum(np.searchsorted(hot, fps), len(hot) - 1)
    rank = np.where(hot[at] == fps, often[at], 0)
    return fps[np.lexsort((fps, rank))]


def sketch_of(fps: np.ndarray) -> bytes:
    """Shingles in each cell, as bytes; a power of two of cells, about as many as shingles. 255 means 255 or more."""
    cells = min(MOST_CELLS, 1 << max(3, int(len(fps) - 1).bit_length()))
    return np.minimum(np.bincount((fps & np.uint64(cells - 1)).astype(np.int64), minlength=cells), 255).astype(np.uint8).tobytes()


def most_common(x: bytes, y: bytes, least: int) -> int:
    """An upper bound of the intersection of two sets by their sketches; cells of the larger one are folded."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    full = a.max() == 255 or b.max() == 255
    a, b = a.astype(np.int64), b.astype(np.int64)
    if len(a) > len(b):
        a = a.reshape(-1, len(b)).sum(axis=0)
    elif len(b) > len(a):
        b = b.reshape(-1, len(a)).sum(axis=0)
    return least if full else int(np.minimum(a, b).sum())


def scanned(base: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, digest, sketch) of every row; an empty set has neither digest nor sketch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches):
            sets = [shingles(t, width) for t in pdf["text"]]
            digests = [digest_of(s) if len(s) else None for s in sets]
            sketches = [sketch_of(s) if len(s) else None for s in sets]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_shingles": [len(s) for s in sets], "digest": digests, "sketch": sketches})

    return base.mapInPandas(run, "doc_id long, n_shingles long, digest binary, sketch binary")


def frequent(base: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles found twice or more in a sample of documents, sorted by value, with their counts; at most HOT_SHINGLES."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches):
            sets = [shingles(t, width) for t in pdf["text"].drop_duplicates()]
            if sets:
                fps, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pd.DataFrame({"h": fps.view(np.int64), "n": n})

    part = base.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(SAMPLE)) == 0)
    counts = part.mapInPandas(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1")
    top = counts.orderBy(F.desc("n"), "h").limit(HOT_SHINGLES).toPandas()
    fps, n = top["h"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    by = np.argsort(fps)
    return fps[by], n[by]


def prefixes(base: DataFrame, width: int, hot: np.ndarray, often: np.ndarray) -> DataFrame:
    """Index entries (h, cid, size, pos); a class enters once a task."""
    shared = base.sparkSession.sparkContext.broadcast((hot, often))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hot, often = shared.value
        seen: set[int] = set()
        for pdf in slices(batches):
            hs, cids, sizes = [], [], []
            for t in pdf["text"]:
                fps = shingles(t, width)
                cid = class_of(digest_of(fps)) if len(fps) else None
                if cid is None or cid in seen:
                    continue
                seen.add(cid)
                hs.append(ordered(fps, hot, often)[: prefix_length(len(fps))])
                cids.append(cid)
                sizes.append(len(fps))
            if hs:
                lengths = [len(h) for h in hs]
                yield pd.DataFrame(
                    {
                        "h": np.concatenate(hs).view(np.int64),
                        "cid": np.repeat(np.array(cids, np.int64), lengths),
                        "size": np.repeat(np.array(sizes, np.int32), lengths),
                        "pos": np.concatenate([np.arange(n, dtype=np.int32) for n in lengths]),
                    }
                )

    return base.mapInPandas(run, "h long, cid long, size int, pos int")


def shared_lists(entries: DataFrame) -> DataFrame:
    """Entries of lists with two classes or more, each once, with its rank in the list from 0. Partitions come sorted, so
    this streams with one row of memory."""
    columns = entries.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, rank = None, 0  # the last row and its rank
        for pdf in batches:
            if last is not None:
                pdf = pd.concat([last, pdf], ignore_index=True)
            h, cid = pdf["h"].to_numpy(), pdf["cid"].to_numpy()
            new = np.ones(len(pdf), bool)
            new[1:] = (h[1:] != h[:-1]) | (cid[1:] != cid[:-1])
            pdf, h = pdf[new], h[new]
            starts = np.ones(len(h), bool)
            starts[1:] = h[1:] != h[:-1]
            at = np.arange(len(h))
            ranks = at - np.maximum.accumulate(np.where(starts, at, 0))
            ranks[np.cumsum(starts) == 1] += rank
            keep = ranks > 0
            keep[:-1] |= ranks[1:] > 0
            pdf = pdf.assign(rank=ranks)
            last, rank = pdf.iloc[-1:][columns], int(ranks[-1])
            yield pdf[:-1][keep[:-1]]
        if last is not None and rank:
            yield last.assign(rank=rank)

    return entries.repartition("h").sortWithinPartitions("h", "cid").mapInPandas(run, "h long, cid long, size int, pos int, rank long")


def may_link(s1: Column, p1: Column, s2: Column, p2: Column) -> Column:
    """Size and position allow a link whose first common shingle is at these positions."""
    return 7 * (1 + F.least(s1 - p1 - 1, s2 - p2 - 1)) >= 3 * (s1 + s2)


def set_rows(base: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(cid, digest, fps) of the documents whose ids are wanted (one for each class)."""
    ids = wanted.select(F.col("rep").alias("doc_id"))
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    rows = base.alias("b").join((F.broadcast(ids) if few else ids).alias("i"), F.col("b.doc_id").eqNullSafe(F.col("i.doc_id")), "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches):
            sets = [s for s in (shingles(t, width) for t in pdf["text"]) if len(s)]
            digests = [digest_of(s) for s in sets]
            yield pd.DataFrame({"cid": [class_of(d) for d in digests], "digest": digests, "fps": [s.tobytes() for s in sets]})

    return rows.mapInPandas(run, "cid long, digest binary, fps binary")


def bounded(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, most, open): most bounds the common shingles by sketches; open: a link is possible."""
    side = lambda k: classes.select(F.col("cid").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches):
            na, nb = pdf["na"].to_numpy(), pdf["nb"].to_numpy()
            least = np.minimum(na, nb)
            most = np.array([min(m, most_common(x, y, m)) for x, y, m in zip(pdf["sa"], pdf["sb"], least, strict=True)], np.int64)
            yield pdf[["a", "b"]].assign(most=most, open=7 * most >= 3 * (na + nb))

    return both.select("a", "b", "na", "nb", "sa", "sb").mapInPandas(run, "a long, b long, most long, open boolean")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, da, db, common, total): exact sizes of intersection and union of each pair of classes."""
    second = pairs.select("a", "b").join(sets.select(F.col("cid").alias("b"), F.col("digest").alias("db"), F.col("fps").alias("fb")), "b")
    both = second.join(sets.select(F.col("cid").alias("a"), F.col("digest").alias("da"), F.col("fps").alias("fa")), "a")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches):
            common, total = [], []
            for x, y in zip(pdf["fa"], pdf["fb"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                joint = np.sort(np.concatenate([x, y]), kind="stable")
                n = int((joint[1:] == joint[:-1]).sum())
                common.append(n)
                total.append(len(x) + len(y) - n)
            yield pdf[["a", "b", "da", "db"]].assign(common=common, total=total)

    columns = "a long, b long, da binary, db binary, common long, total long"
    return both.select("a", "b", "da", "db", "fa", "fb").mapInPandas(run, columns)


def derived(x: str, y: str) -> tuple[Column, Column]:
    """Least and most common shingles of two sets, derived from what each shares with the pivot: at most what one shares and the
    other has besides, at least what both share less the pivot's size."""
    of = lambda s, c: F.col(f"{s}.{c}")
    most = F.least(of(x, "high") + of(y, "size") - of(y, "low"), of(y, "high") + of(x, "size") - of(x, "low"))
    return of(x, "low") + of(y, "low") - of(x, "psize"), most


def short_pairs(lists: DataFrame) -> DataFrame:
    """Pairs (a, b, known) that sizes, positions, components and the pivot's answers leave open, over short lists; known: these
    answers alone make it a link."""
    x, y = lists.alias("x"), lists.alias("y")
    least, most = derived("x", "y")
    need = 3 * (F.col("x.size") + F.col("y.size"))
    met = x.join(
        y,
        (F.col("x.h") == F.col("y.h"))
        & (F.col("x.cid") < F.col("y.cid"))
        & (F.col("x.root") != F.col("y.root"))
        & may_link(F.col("x.size"), F.col("x.pos"), F.col("y.size"), F.col("y.pos"))
        & (7 * most >= need),
    )
    return met.select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"), (7 * least >= need).alias("known"))


def cut_lists(lists: DataFrame) -> DataFrame:
    """Long lists with a block each row: ranges of size with about BLOCK members. Only the histogram of a list (one row for each size) is
    ordered; sizes with more members than BLOCK are spread over salts, so no list meets in one task."""
    sizes = lists.groupBy("h", "size").count()
    before = F.sum("count").over(Window.partitionBy("h").orderBy("size").rowsBetween(Window.unboundedPreceding, -1))
    slots = sizes.select("h", "size", F.floor(F.coalesce(before, F.lit(0)) / BLOCK).alias("slot"), F.ceil(F.col("count") / BLOCK).alias("salts"))
    salt = F.pmod(F.xxhash64("cid"), F.col("salts"))
    return lists.join(slots, ["h", "size"]).withColumn("block", F.col("slot") * (1 << 20) + salt).drop("slot", "salts")


def block_pairs(lists: DataFrame, classes: DataFrame) -> DataFrame:
    """The same over long lists, by blocks; only pairs that their sketches leave open come out."""
    parts = ("cid", "size", "pos", "root", "low", "high", "sketch")
    blocks = cut_lists(lists).join(classes.select("cid", "sketch"), "cid").groupBy("h", "block").agg(
        *[F.collect_list(c).alias(c) for c in parts],  # about BLOCK each
        F.first("psize").alias("psize"),
        F.min("size").alias("size0"),
        F.max("size").alias("size1"),
        F.min("pos").alias("first"),
        F.min("root").alias("root0"),
        F.max("root").alias("root1"),
    )
    x, y = blocks.alias("x"), blocks.alias("y")
    # blocks are in the order of size, but for those of one size, which any order suits
    met = x.join(
        y,
        (F.col("x.h") == F.col("y.h"))
        & (F.col("x.block") <= F.col("y.block"))
        & (4 * F.col("x.size1") >= 3 * F.col("y.size0"))
        & (7 * (F.least(F.col("x.size1") - F.col("x.first"), F.col("y.size1") - F.col("y.first"))) >= 3 * (F.col("x.size0") + F.col("y.size0")))
        & ((F.col("x.root0") != F.col("x.root1")) | (F.col("y.root0") != F.col("y.root1")) | (F.col("x.root0") != F.col("y.root0"))),
    )
    met = met.select(*[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "xy" for c in parts], "x.psize", (F.col("x.block") == F.col("y.block")).alias("own"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                left = lambda c: np.asarray(getattr(row, f"x_{c}"))[:, None]  # noqa: B023, E731
                right = lambda c: np.asarray(getattr(row, f"y_{c}"))[None, :]  # noqa: B023, E731
                need = 3 * (left("size") + right("size"))
                ok = 7 * np.minimum(left("size") - left("pos"), right("size") - right("pos")) >= need
                ok &= left("root") != right("root")
                ok &= 7 * np.minimum(left("high") + right("size") - right("low"), right("high") + left("size") - left("low")) >= need
                if row.own:
                    ok &= np.tri(*ok.shape, k=-1, dtype=bool).T
                i, j = np.nonzero(ok)
                least = np.minimum(left("size")[i, 0], right("size")[0, j])
                most = [most_common(row.x_sketch[x], row.y_sketch[y], m) for x, y, m in zip(i, j, least, strict=True)]
                open_pairs = 7 * np.array(most, np.int64) >= need[i, j]
                i, j = i[open_pairs], j[open_pairs]
                a, b = left("cid")[i, 0], right("cid")[0, j]
                known = 7 * (left("low")[i, 0] + right("low")[0, j] - row.psize) >= need[i, j]
                yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "known": known})

    return met.mapInPandas(run, "a long, b long, known boolean").filter("a <> b")


def jaccard_components(
    docs: DataFrame, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text", folder: str | None = None
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, digest of its set (null: empty), component_id (the least id it reaches)."""
    folder = folder or shared_folder(docs.sparkSession)
    base = pick(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = written(scanned(base, width), folder, "rows")
    kinds = rows.filter("digest is not null").groupBy("digest")
    classes = kinds.agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    classes = written(classes.withColumn("cid", F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long")), folder, "classes")
    hot, often = frequent(base, width)
    lists = written(shared_lists(prefixes(base, width, hot, often)), folder, "lists")

    def nodes_of(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()

    def whole_sets(nodes: DataFrame, name: str) -> DataFrame:
        wanted = classes.select("cid", "rep").join(nodes, "cid", "left_semi")
        return written(set_rows(base, wanted, width).dropDuplicates(["digest"]), folder, name)

    # Each list asks its pivots, the first members by class.
    long_lists = lists.filter(F.col("rank") == SHORT_LIST).select("h", F.lit(True).alias("long"))
    pivots = lists.filter(F.col("rank") < PIVOTS).join(long_lists, "h", "left").filter("rank = 0 or long").drop("long")
    x, p = lists.alias("x"), pivots.alias("p")
    asked = (F.col("x.h") == F.col("p.h")) & (F.col("x.rank") > F.col("p.rank")) & may_link(F.col("x.size"), F.col("x.pos"), F.col("p.size"), F.col("p.pos"))
    stars = x.join(p, asked).select(F.col("p.cid").alias("a"), F.col("x.cid").alias("b")).distinct()
    pairs = written(bounded(stars, classes), folder, "stars")
    likely = pairs.filter("open")
    nodes = nodes_of(likely)
    sets = whole_sets(nodes, "sets")
    answers = written(verified(likely, sets), folder, "answers")
    linked = answers.filter("7 * common >= 3 * (common + total)")
    roots = components(linked.select(F.col("a").alias("u"), F.col("b").alias("v")), folder, "first")

    # Lists that still hold two components: other pairs, less what pivots and components tell.
    known = lists.join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    open_lists = known.groupBy("h").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("n"), F.min("cid").alias("p"))
    open_lists = open_lists.filter("r0 <> r1 and n > 2").select("h", "p", "n")
    exact = answers.groupBy("a", "b").agg(F.max("common").alias("c"))
    dist = pairs.join(exact, ["a", "b"], "left").join(classes.select(F.col("cid").alias("a"), F.col("n").alias("psize")), "a").select(
        F.col("a").alias("p"), F.col("b").alias("cid"), "psize", F.coalesce("c", F.lit(0)).alias("low"), F.coalesce("c", "most").alias("high")
    )
    rest = known.join(open_lists, "h").filter("cid <> p").join(dist, ["p", "cid"], "left")
    # low and high: the least and the most that a member can share with the pivot
    rest = rest.withColumn("low", F.coalesce("low", F.lit(0))).withColumn("high", F.coalesce("high", "size")).withColumn("psize", F.coalesce("psize", F.lit(1 << 40)))
    rest = rest.filter((F.col("n") <= SHORT_LIST) | (F.col("rank") >= PIVOTS))  # pivots of long lists have asked all members
    rest = written(rest.select("h", "cid", F.col("size").cast("long").alias("size"), F.col("pos").cast("long").alias("pos"), "root", "low", "high", "psize", "n"), folder, "rest")
    more = short_pairs(rest.filter(F.col("n") <= SHORT_LIST)).unionByName(block_pairs(rest.filter(F.col("n") > SHORT_LIST), classes))
    more = more.groupBy("a", "b").agg(F.max("known").alias("known")).join(pairs, ["a", "b"], "left_anti")
    more = written(more, folder, "open")
    told = more.filter("known")
    more = written(bounded(more.filter("not known").select("a", "b"), classes).filter("open"), folder, "more")
    more_sets = whole_sets(nodes_of(more).join(nodes, "cid", "left_anti"), "more_sets")
    late = verified(more, sets.unionByName(more_sets)).filter("7 * common >= 3 * (common + total)")

    links = linked.select(F.col("da").alias("u"), F.col("db").alias("v")).unionByName(late.select(F.col("da").alias("u"), F.col("db").alias("v")))
    named = lambda c, out: classes.select(F.col("cid").alias(c), F.col("digest").alias(out))
    links = links.unionByName(told.join(named("a", "u"), "a").join(named("b", "v"), "b").select("u", "v"))
    members = components(links, folder, "all")
    reach = classes.join(members.withColumnRenamed("node", "digest"), "digest")
    least = reach.groupBy("root").agg(F.min("rep").alias("component_id"))
    grouped = reach.join(least, "root").select("digest", "component_id")
    named = classes.join(grouped, "digest", "left").select("digest", F.coalesce("component_id", "rep").alias("component_id"))
    out = rows.join(named, "digest", "left")
    return out.select("doc_id", "n_shingles", "digest", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """docs with one row of each component: that of the least id, of rows with one id the first. Rows are numbered and written once, so null and
    repeated ids and columns of any type lose no other document; blank texts link with nothing and all stay."""
    folder = folder or shared_folder(docs.sparkSession)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("key"))
    keyed = written(keyed, folder, "numbered")
    field = lambda name: F.col("row").getField(name)
    found = jaccard_components(keyed.select("key", field(text).alias("text")), width, "key", "text", folder)
    placed = found.select(F.col("doc_id").alias("key"), "component_id").join(keyed.select("key", field(doc_id).alias("id")), "key")
    first = F.min(F.struct(F.col("id").isNull().alias("blank"), "id", "key"))
    best = placed.groupBy("component_id").agg(first["key"].alias("best"), F.count("*").alias("n")).filter("n > 1")
    gone = written(placed.join(best, "component_id").filter("key <> best").select("key"), folder, "gone")
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return keyed.join(F.broadcast(gone) if few else gone, "key", "left_anti").select("row.*")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP3_SQL = r"""
WITH worded AS (SELECT row_number() OVER () AS rn, doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
sets AS (SELECT rn, doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(words) - 4), lambda i: array_to_string(words[i:i + 4], ' '))) END AS grams FROM worded),
items AS (SELECT rn, hash(unnest(grams)) AS g FROM sets),
sizes AS (SELECT rn, doc_id, len(grams)::BIGINT AS n FROM sets),
met AS (SELECT a.rn AS x, b.rn AS y, count(*) AS c FROM items a JOIN items b ON a.g = b.g AND a.rn < b.rn GROUP BY 1, 2),
links AS (SELECT x, y FROM met JOIN sizes p ON p.rn = x JOIN sizes q ON q.rn = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
near AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
    WITH RECURSIVE walk(rn, other) AS (SELECT rn, rn FROM sizes UNION SELECT w.rn, n.y FROM walk w JOIN near n ON n.x = w.other)
    SELECT walk.rn AS rn, min(s.doc_id) AS component_id FROM walk JOIN sizes s ON s.rn = other GROUP BY walk.rn)
SELECT doc_id, n AS n_shingles, component_id FROM sizes JOIN reach USING (rn)
"""
