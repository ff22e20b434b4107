"""Operator 2: conflict-constrained best-fit packing of documents into training sequences.

A bin is one sequence of `capacity` words. Each bin carries a bitmap of the sources it holds and one of
the duplicate clusters (documents with the same words, by a 64-bit digest; near copies are clusters of their own); a piece may
enter only a bin whose maps do not meet its own. Sources and clusters are numbered within their group, a bit each. Open
bins are kept in order of residual room: best fit starts at the smallest residual that holds the piece and goes
on to its successors until a compatible bin is found, else it opens a new bin.

A document longer than the capacity gives full pieces, each a bin of its own, and a tail that is packed.
Documents are dealt into groups of about `group_rows` by a hash of their id and content, one group a task, so no
source or cluster, however large, meets in one task; bins never span groups.

Defined results: a null or blank text has no words and gives one piece of length 0 with a null bin. A null
source never conflicts; a null id is kept. Repeated rows are pieces like any others (one cluster, so
different bins). The rows within a group are ordered by length, id and digest, so results do not depend on partitioning.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.llm.common import pick, words_of
from statuta.session import table

CAPACITY = 2048
GROUP_ROWS = 8192

SCHEMA = "doc_id long, piece int, start long, length long, bin string, bin_offset long"


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item, taken in the given order. Maps are one-bit integers, 0 for no constraint."""
    room: list[tuple[int, int]] = []  # (residual, bin), ascending
    maps: list[list[int]] = []
    placed = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        at = bisect_left(room, (size, -1))
        while at < len(room):
            own = maps[room[at][1]]
            if not (own[0] & source or own[1] & cluster):
                break
            at += 1
        if at < len(room):
            left, number = room.pop(at)
        else:
            left, number = capacity, len(maps)
            maps.append([0, 0])
        maps[number][0] |= source
        maps[number][1] |= cluster
        placed.append((number, capacity - left))
        if left > size:
            insort(room, (left - size, number))
    return placed


def one_bits(values: list) -> list[int]:
    """A bit for each value that occurs more than once, 0 for null and for what can meet nothing."""
    seen = Counter(v for v in values if v is not None)
    bits = {v: 1 << i for i, (v, n) in enumerate(seen.most_common()) if n > 1}
    return [bits.get(v, 0) for v in values]


def pack_group(pdf: pd.DataFrame, capacity: int, group: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["n_words", "doc_id", "digest"], ascending=[False, True, True], kind="stable", na_position="last")
    rows, tails = [], []
    full = 0
    for doc_id, n, source, digest in zip(pdf.doc_id, pdf.n_words, pdf.source, pdf.digest, strict=True):
        doc = None if pd.isna(doc_id) else int(doc_id)
        pieces = int(n) // capacity
        for k in range(pieces):
            rows.append((doc, k, k * capacity, capacity, f"{group}-f{full}", 0))
            full += 1
        tail = int(n) - pieces * capacity
        if tail:
            tails.append((tail, doc, pieces, None if pd.isna(source) else source, int(digest)))
        elif not pieces:
            rows.append((doc, 0, 0, 0, None, None))
    tails.sort(key=lambda t: -t[0])
    sources, clusters = one_bits([t[3] for t in tails]), one_bits([t[4] for t in tails])
    for (size, doc, k, _, _), (number, offset) in zip(tails, best_fit([t[0] for t in tails], sources, clusters, capacity), strict=True):
        rows.append((doc, k, k * capacity, size, f"{group}-{number}", offset))
    out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "bin", "bin_offset"])
    return out.astype({"doc_id": "Int64", "piece": "int32", "start": "int64", "length": "int64", "bin_offset": "Int64"})


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    group_rows: int = GROUP_ROWS,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """One row per piece: doc_id, piece, start and length in words, bin, bin_offset."""
    base = pick(docs, doc_id=doc_id, text=text, source=source)
    words = words_of(F.col("text"))
    sized = base.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.size(words).cast("long").alias("n_words"),
        F.xxhash64(words).alias("digest"),
        F.col("source").cast("string").alias("source"),
    )
    groups = max(1, -(-docs.count() // group_rows))
    # pieces of one document follow one another in its own group; the id is salted by content against repeated ids
    dealt = sized.withColumn("grp", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(groups)).cast("int"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pack_group(pdf, capacity, int(key[0]))

    return dealt.groupBy("grp").applyInPandas(run, SCHEMA)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
