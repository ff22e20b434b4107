"""Operator 12: runs, that is stretches of words that repeat with a period at least four times.

A run is a stretch of words with smallest period q and at least max(6, 4 * q) words that no neighbouring word extends keeping q.

Block matching: for every scale b = 1, 2, 4, ... the aligned blocks of b words are keys of an integer-sequence automaton, searched
across the document; copies of a block 4 * b to 8 * b - 1 words on (1 to 7 at the first scale) seed the runs with such a period. Neighbouring
blocks with one distance are joined, what is too short for a run goes, and the rest is extended word by word to both sides. A stretch that
also has a smaller period was found whole at that period's scale; per stretch the smallest stays.

Before a scale is searched, its places are narrowed to stretches that can hold such a run: 12 * b words in line (five at the first scale)
each of which comes again within 8 * b - 1 words. Nothing else of a document can be inside a run, and most of a document is settled by that.

Words of a run found before, with a period of at most b / 4, are told apart by their place in that run, so no key repeats itself and a search
never walks long chains of shorter matches. A run of period d shares less than d + q words with a run of a smaller period q that sticks out of
it, so of its 4 * d words at least 2 * d - 2 * q are marked alike in all copies: more than a block and its copy need. Automata hold at most BLOCKS
keys, so memory follows the longest period and time is near to linear in the text.

One pass over the documents without a shuffle: a lost task is computed again from its own rows.

Defined results: null, empty and blank texts have no words and no runs. Extra columns of any name do not matter; each row is taken for
itself, repeated rows and all. An empty table gives no rows. Very long texts are searched whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.llm.common import pick, words_of
from statuta.session import table

SHORTEST = 6
REPEATS = 4
NEAREST, FARTHEST = 4, 8
BLOCKS = 1024
ROWS = 200

SCHEMA = "doc_id long, text string, n_words long, runs array<struct<start: long, length: long, period: long>>"


def next_distances(ids: np.ndarray) -> np.ndarray:
    """How far on each word comes again; the text's length if it does not."""
    order = np.argsort(ids, kind="stable")
    same = ids[order[1:]] == ids[order[:-1]]
    out = np.full(len(ids), len(ids), np.int64)
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def stretches(mask: np.ndarray, least: int) -> list[tuple[int, int]]:
    """[from, to) of at least `least` set places in line."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]])))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= least
    return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))


def block_copies(ids: np.ndarray, lo: int, hi: int, b: int, nearest: int) -> np.ndarray:
    """Rows (distance, start) of aligned blocks in [lo, hi) whose words come again nearest * b to FARTHEST * b - 1 words on."""
    found = [np.zeros((0, 2), np.int64)]
    for first in range(-(-lo // b) * b, hi - b + 1, b * BLOCKS):
        starts = range(first, min(first + b * BLOCKS, hi - b + 1), b)
        words = tuple(ids[first : starts[-1] + (FARTHEST + 1) * b].tolist())
        keys = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        content = []
        for k, s in enumerate(starts):
            block = words[s - first : s - first + b]
            c = keys.get(block, -1)
            if c < 0:
                keys.add_word(block, c := k)
            content.append(c)
        keys.make_automaton()
        hits = np.fromiter((x for hit in keys.iter(words) for x in hit), np.int64).reshape(-1, 2)
        of = np.array(content, np.int64)
        at = hits[:, 0] - (b - 1)
        for back in range(nearest, FARTHEST):
            block = at // b - back
            known = np.flatnonzero((block >= 0) & (block < len(of)))
            same = known[of[block[known]] == hits[known, 1]]
            found.append(np.stack([at[same] - block[same] * b, first + block[same] * b], axis=1))
    return np.concatenate(found)


def placed(ids: np.ndarray, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """The words of runs told apart by their place in the run; where runs overlap, in that of the greatest period."""
    place = np.zeros(len(ids), np.int64)
    for _, start, end in sorted(runs):
        place[start:end] = np.arange(1, end - start + 1)
    return np.unique(ids * (len(ids) + 1) + place, return_inverse=True)[1].astype(np.int64)


def first_difference(ids: np.ndarray, at: int, distance: int, step: int) -> int:
    """Going from `at` by step (1 or -1), the first place whose word differs from that `distance` on, or the end of the text."""
    size, last = 64, len(ids) - distance
    while 0 <= at < last:
        a, z = (at, min(last, at + size)) if step > 0 else (max(0, at - size + 1), at + 1)
        differ = np.flatnonzero(ids[a:z] != ids[a + distance : z + distance])
        if len(differ):
            return a + int(differ[0 if step > 0 else -1])
        at, size = (z if step > 0 else a - 1), size * 2
    return at


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period. ids are numbered from 0."""
    n, found = len(ids), {}
    if n < SHORTEST:
        return []
    again = next_distances(ids)
    holder = np.full(n, -1, np.int64)
    runs: list[tuple[int, int, int]] = []  # (period, start, end)
    b = 1
    while b == 1 or REPEATS * NEAREST * b <= n:
        nearest = 1 if b == 1 else NEAREST
        need = max(SHORTEST, REPEATS * nearest * b) - nearest * b
        parts = stretches(again < FARTHEST * b, need)
        small = [r for r in runs if 4 * r[0] <= b] if parts else []
        words = placed(ids, small) if small else ids
        least = 2 if small else (need - b + 1) // b
        for lo, hi in parts:
            copies = block_copies(words, lo, hi, b, nearest)
            copies = copies[np.lexsort((copies[:, 1], copies[:, 0]))]
            breaks = (np.diff(copies[:, 0]) != 0) | (np.diff(copies[:, 1]) != b)
            heads = np.flatnonzero(np.concatenate([[True], breaks])) if len(copies) else np.zeros(0, np.int64)
            counts = np.diff(np.append(heads, len(copies)))
            for k in np.flatnonzero(counts >= least):
                d, s = copies[heads[k]].tolist()
                e = s + int(counts[k]) * b
                if holder[s] >= 0 and runs[holder[s]][2] >= e + d and d % runs[holder[s]][0] == 0:
                    continue  # the stretch of a run found before
                start, end = first_difference(ids, s - 1, d, -1) + 1, first_difference(ids, e, d, 1) + d
                if end - start >= max(SHORTEST, REPEATS * d):
                    found[start, end] = min(d, found.get((start, end), d))
                    holder[start:end] = len(runs)
                    runs.append((d, start, end))
        b *= 2
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by spaces."""
    if not runs:
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    keep = np.cumsum(depth[:-1]) == 0
    return b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k)


def scan_text(text: str | None) -> tuple[str, int, list[tuple[int, int, int]]]:
    words = (text or "").encode("utf-8", "surrogatepass").split()
    codes: dict[bytes, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
    runs = find_runs(ids)
    return collapsed(words, runs).decode("utf-8", "surrogatepass"), len(words), runs


def scan_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    names = ("start", "length", "period")
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            rows = [scan_text(t) for t in part.column("text").to_pylist()]
            runs = [[dict(zip(names, r, strict=True)) for r in x[2]] for x in rows]
            columns = [part.column("doc_id"), pa.array([x[0] for x in rows], pa.string()), pa.array([x[1] for x in rows], pa.int64()), pa.array(runs, pa.list_(run))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "n_words", "runs"])


def collapse_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id (long), text (its words without the repeats of runs), n_words before, runs by start, then period."""
    rows = pick(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(scan_batches, SCHEMA).select(F.col("doc_id").alias(doc_id), F.col("text").alias(text), "n_words", "runs")


def steepest(runs: Column) -> Column:
    """The run with the greatest length/period, compared as products; of equal ones the first."""
    higher = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    return F.aggregate(runs, none, lambda best, r: F.when(higher(best, r), r).otherwise(best))


def with_periods(docs: DataFrame) -> DataFrame:
    """The query's input: in a tenth of the documents, by crc32 of the id, the words from one on repeat with a period. A null id has no crc32."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(h % 10 == 0, words_of(F.col("text")))
    base = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("words")).withColumn("n", F.size("words").cast("long"))
    a = F.col("g") % F.col("n")
    base = base.withColumn("a", F.when(F.col("n") > 0, a)).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    again = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("words", place(i)))
    return base.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op12_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = collapse_runs(with_periods(table(spark, sf_dir, "documents"))).withColumn("best", steepest(F.col("runs")))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )
