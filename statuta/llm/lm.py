"""Operator 8: language-model scoring with stupid backoff, computed relationally.

Documents are dealt into blocks by a hash. A block explodes its texts into n-grams of every order and sends, per hash
partition, each distinct n-gram once with its count there. Every partition is one part of the count table: it adds the
counts of all blocks and joins them back to the n-grams that asked. The block then holds the corpus count of each of
its n-grams and sums, over the words of a document, log S(w | history):

    S(w_i | w_{i-n+1..i-1}) = c(w_{i-n+1..i}) / c(w_{i-n+1..i-1})  if that n-gram is in the table, else 0.4 S(w_i | shorter history)

The table leaves out n-grams of two words or more seen fewer than MIN_COUNT times in the corpus, else every n-gram of the corpus itself
would be in it and nothing would back off. N-grams are held as 64-bit fingerprints. Counts cover all documents.

Words and pairs are asked for first. Of each longer order, in rounds, a block asks only for n-grams whose first and last n - 1 words
are in the table: no other n-gram can occur MIN_COUNT times, so this leaves out nothing. Fingerprints are sent
sorted, as differences; parts are ranges of fingerprints.

A frequent n-gram travels once per block, not once per occurrence, so no key is hot. Defined results: a null or blank
text has n_words 0, log_score 0.0 and perplexity null. Repeated rows count and are scored each.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.llm.common import pick
from statuta.llm.hashing import ngram_hashes, words_of
from statuta.session import table

ORDER = 3
BACKOFF = 0.4
MIN_COUNT = 2
BLOCK_BYTES = 12 << 20
PART_BYTES = 24 << 20


def block_grams(texts: list[str | None], order: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per order, the fingerprints of all n-grams of the texts, in order, and how many each text has."""
    grams, sizes = [[] for _ in range(order)], [[] for _ in range(order)]
    for text in texts:
        words = words_of(text)
        for k in range(order):
            h = ngram_hashes(words, k + 1)
            grams[k].append(h)
            sizes[k].append(len(h))
    return [np.concatenate(g) if g else np.zeros(0, np.uint64) for g in grams], [np.array(s) for s in sizes]


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


PLAIN = 5  # low bytes of a difference, which do not compress


def coded(values: np.ndarray, plain: int = 0) -> bytes:
    """Values of one width by byte places, the lowest `plain` places as they are and the others compressed."""
    places = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return places[:plain].tobytes() + zlib.compress(places[plain:].tobytes(), 1)


def decoded(data: bytes, n: int, dtype: type, plain: int = 0) -> np.ndarray:
    places = np.frombuffer(data[: plain * n] + zlib.decompress(data[plain * n :]), np.uint8)
    return np.ascontiguousarray(places.reshape(-1, n).T).view(dtype).ravel()


def possible(counts: np.ndarray, shorter: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Which n-grams can be in the table, by the counts of those one word shorter; both in order, with sizes per text."""
    first = np.arange(own.sum()) + np.repeat(np.cumsum(shorter) - shorter - np.cumsum(own) + own, own)
    return (counts[first] > 0) & (counts[first + 1] > 0) if len(first) else np.zeros(0, bool)


def sent(block: int, n: int, grams: np.ndarray, parts: int) -> list[tuple]:
    """The rows (part, block, n, size, hashes, counts) that ask for each distinct n-gram once."""
    unique, counts = np.unique(grams, return_counts=True)
    cuts = np.searchsorted(part_of(unique, parts), np.arange(parts + 1))
    rows = []
    for p in np.flatnonzero(np.diff(cuts)):
        own = unique[cuts[p] : cuts[p + 1]]
        steps = np.diff(own, prepend=np.uint64(0))
        rows.append((int(p), block, n, len(own), coded(steps, PLAIN), coded(counts[cuts[p] : cuts[p + 1]].astype(np.uint32))))
    return rows


QUESTION = ["part", "block", "n", "size", "hashes", "counts"]


def asked(block: int, texts: list[str | None], order: int, parts: int) -> pd.DataFrame:
    """What a block asks for at first: words and pairs."""
    grams = block_grams(texts, min(order, 2))[0]
    return pd.DataFrame([r for k, g in enumerate(grams) for r in sent(block, k + 1, g, parts)], columns=QUESTION)


def asked_longer(block: int, texts: list[str | None], answers: pd.DataFrame, n: int, parts: int) -> pd.DataFrame:
    """What a block asks for of order n, with the answers to all shorter ones."""
    grams, sizes = block_grams(texts, n)
    counts = table_counts(grams[:-1], sizes, answers, parts)
    return pd.DataFrame(sent(block, n, grams[-1][possible(counts[-1], sizes[-2], sizes[-1])], parts), columns=QUESTION)


def answered(pdf: pd.DataFrame, min_count: int) -> pd.DataFrame:
    """Adds up one part of the count table and gives each asking block its counts (0: not in the table)."""
    out = []
    for n, rows in pdf.groupby("n"):
        hashes = [np.cumsum(decoded(h, s, np.uint64, PLAIN), dtype=np.uint64) for h, s in zip(rows["hashes"], rows["size"], strict=True)]
        counts = np.concatenate([decoded(c, s, np.uint32) for c, s in zip(rows["counts"], rows["size"], strict=True)])
        unique, back = np.unique(np.concatenate(hashes), return_inverse=True)
        totals = np.bincount(back, weights=counts, minlength=len(unique)).astype(np.int64)
        if n > 1:
            totals[totals < min_count] = 0
        answers = np.split(totals[back], np.cumsum([len(h) for h in hashes])[:-1])
        out += [(int(b), int(p), int(n), len(a), coded(a)) for b, p, a in zip(rows["block"], rows["part"], answers, strict=True)]
    return pd.DataFrame(out, columns=["block", "part", "n", "size", "counts"])


def table_counts(grams: list[np.ndarray], sizes: list[np.ndarray], answers: pd.DataFrame, parts: int) -> list[np.ndarray]:
    """Per order, the corpus counts of all n-grams of a block, in order (0: not in the table)."""
    counts: list[np.ndarray] = []
    for k, g in enumerate(grams):
        there = possible(counts[-1], sizes[k - 1], sizes[k]) if k > 1 else np.ones(len(g), bool)
        unique, back = np.unique(g[there], return_inverse=True)
        total = np.zeros(len(unique), np.int64)
        cuts = np.searchsorted(part_of(unique, parts), np.arange(parts + 1))
        own = answers[answers["n"] == k + 1]
        for p, size, c in zip(own["part"], own["size"], own["counts"], strict=True):
            total[cuts[p] : cuts[p + 1]] = decoded(c, size, np.int64)
        counts.append(np.zeros(len(g), np.int64))
        counts[k][there] = total[back]
    return counts


def scored(docs: pd.DataFrame, answers: pd.DataFrame, order: int, parts: int, tokens: int, backoff: float) -> pd.DataFrame:
    """Sums log S over the words of each document of a block."""
    grams, sizes = block_grams(list(docs["text"]), order)
    counts = table_counts(grams, sizes, answers, parts)
    rows = []
    at = [np.concatenate([[0], np.cumsum(s)]) for s in sizes]
    for i, doc in enumerate(docs["doc_id"]):
        c = [counts[k][at[k][i] : at[k][i + 1]] for k in range(order)]
        n = len(c[0])
        if not n:
            rows.append((doc, 0, 0.0, None))
            continue
        logs = np.log(c[0] / tokens)
        for k in range(1, min(order, n)):  # longer histories take over where their n-gram is in the table
            own = c[k] > 0
            longer = np.log(np.where(own, c[k], 1) / np.maximum(c[k - 1][: n - k], 1))
            logs[k:] = np.where(own, longer, math.log(backoff) + logs[k:])
        total = float(logs.sum())
        rows.append((doc, n, total, math.exp(min(700.0, -total / n))))
    return pd.DataFrame(rows, columns=["doc_id", "n_words", "log_score", "perplexity"])


def lm_scores(
    docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, min_count: int = MIN_COUNT, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: id, n_words, log_score, perplexity per word."""
    base = pick(docs, doc_id=doc_id, text=text)
    blank = r"[\x20\x09-\x0D]+"
    size = base.agg(
        F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b"),
        F.coalesce(F.sum(F.size(F.filter(F.split(F.coalesce("text", F.lit("")), blank), lambda w: w != ""))), F.lit(0)).alias("w"),
    ).first()
    blocks, parts, tokens = max(1, -(-size["b"] // BLOCK_BYTES)), max(1, -(-size["b"] // PART_BYTES)), max(1, size["w"])
    dealt = base.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    kind = dict(base.dtypes)["doc_id"]

    def ask(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return asked(int(key[0]), list(pdf["text"]), order, parts)

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        return answered(pdf, min_count)

    def ask_longer(n: int):
        def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            return asked_longer(int(key[0]), list(left["text"]), right, n, parts)

        return run

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return scored(left, right, order, parts, tokens, backoff)

    question = "part int, block int, n int, size int, hashes binary, counts binary"
    reply = "block int, part int, n int, size int, counts binary"
    answers = dealt.groupBy("block").applyInPandas(ask, question).groupBy("part").applyInPandas(answer, reply)
    for n in range(3, order + 1):
        questions = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(ask_longer(n), question)
        answers = answers.union(questions.groupBy("part").applyInPandas(answer, reply))
    out = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(
        score, f"doc_id {kind}, n_words long, log_score double, perplexity double"
    )
    return out.withColumnRenamed("doc_id", doc_id) if doc_id != "doc_id" else out


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The production order, 3."""
    return lm_scores(table(spark, sf_dir, "documents")).select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"))


def op8_lm_scoring_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order 2."""
    return lm_scores(table(spark, sf_dir, "documents"), order=2).select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"))


COUNTS_SQL = r"""
WITH worded AS (SELECT row_number() OVER () AS rn, doc_id,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
tokens AS (SELECT rn, unnest(words) AS w, unnest(generate_series(1, len(words))) AS i FROM worded),
grams AS (SELECT rn, i, w, lag(w) OVER (PARTITION BY rn ORDER BY i) AS h, lag(w, 2) OVER (PARTITION BY rn ORDER BY i) AS g FROM tokens),
one AS (SELECT w, count(*) AS c FROM tokens GROUP BY w),
two AS (SELECT h, w, count(*) AS c FROM grams WHERE h IS NOT NULL GROUP BY h, w HAVING count(*) >= 2),
three AS (SELECT g, h, w, count(*) AS c FROM grams WHERE g IS NOT NULL GROUP BY g, h, w HAVING count(*) >= 2),
total AS (SELECT count(*) AS n FROM tokens)"""
SHORT_SQL = "CASE WHEN h IS NULL THEN ln(one.c / total.n) WHEN two.c IS NOT NULL THEN ln(two.c / hist.c) ELSE ln(0.4) + ln(one.c / total.n) END"
SCORES_SQL = "SELECT doc_id, len(words)::BIGINT AS n_words, round(coalesce(sum(s), 0), 4) AS log_score FROM worded LEFT JOIN logs USING (rn) GROUP BY rn, doc_id, len(words)"
OP8_BIGRAMS_SQL = f"""{COUNTS_SQL},
logs AS (SELECT rn, {SHORT_SQL} AS s FROM grams JOIN one USING (w) CROSS JOIN total LEFT JOIN two USING (h, w) LEFT JOIN one hist ON hist.w = h)
{SCORES_SQL}"""
OP8_SQL = f"""{COUNTS_SQL},
logs AS (SELECT rn, CASE WHEN g IS NULL THEN {SHORT_SQL} WHEN three.c IS NOT NULL THEN ln(three.c / pair.c) ELSE ln(0.4) + {SHORT_SQL} END AS s
    FROM grams JOIN one USING (w) CROSS JOIN total LEFT JOIN two USING (h, w) LEFT JOIN one hist ON hist.w = h
    LEFT JOIN three USING (g, h, w) LEFT JOIN two pair ON pair.h = grams.g AND pair.w = grams.h)
{SCORES_SQL}"""
