"""Operator 12 against all pairs of words, with nested, touching and overlapping runs, nulls, long texts and clashing columns."""

import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from statuta.llm import periods


def brute(x):
    """Every period from the least on; a stretch that is there already has a smaller one."""
    found = {}
    for q in range(1, len(x) // 4 + 1):
        k = 0
        while k < len(x) - q:
            j = k
            while j < len(x) - q and x[j] == x[j + q]:
                j += 1
            if j + q - k >= max(6, 4 * q):
                found.setdefault((k, j + q), q)
            k = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def sequence(r):
    k = r.choice([1, 2, 2, 3, 5])
    parts = [r.randrange(k) for _ in range(r.randrange(60))]
    for _ in range(r.randrange(5)):
        word = [r.randrange(k + 1) for _ in range(r.randrange(1, 14))]
        if r.random() < 0.4:  # a run inside each period of another
            word = word[: r.randrange(len(word))] + word[-1:] * r.randrange(4, 40) + word[:2]
        parts += word * r.randrange(1, 9) + word[: r.randrange(len(word) + 1)]
        if r.random() < 0.3:
            parts *= r.randrange(1, 6)
    return parts[:400]


@pytest.mark.parametrize("blocks", [1024, 2])
def test_runs_against_all_pairs(monkeypatch, blocks):
    monkeypatch.setattr(periods, "BLOCKS", blocks)
    r = random.Random(blocks)
    for _ in range(250):
        x = sequence(r)
        assert periods.find_runs(np.array(x, np.int64)) == brute(x), x


def test_time_follows_the_text():
    fibonacci = [[0], [0, 1]]
    while len(fibonacci[-1]) < 20_000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    r = random.Random(1)
    for x in ([0] * 50_000, ([0] * 100 + [1]) * 500, fibonacci[-1], [r.randrange(3000) for _ in range(12_000)] * 4, [r.randrange(2) for _ in range(30_000)]):
        start = time.time()
        periods.find_runs(np.array(x, np.int64))
        assert time.time() - start < 15


def rows():
    r = random.Random(4)
    out = [(i, " ".join(f"w{c}" for c in sequence(r))) for i in range(-20, 120)]
    out += [(i, " ".join(r.choice("abcdefgh") + str(r.randrange(99)) for _ in range(r.randrange(0, 300)))) for i in range(200, 320)]
    return [*out, (130, None), (131, ""), (132, " \n\t"), (None, "a a a a a a b"), (5, "x\x0by x\ny x\ty x y é é é é é é"), (5, "x\x0by x\ny x\ty x y é é é é é é"), (133, "long word " * 20_000)]


def plain_query(i, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), None if i is None else zlib.crc32(str(i).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
    runs = [(0, n, 2)] if n > 30_000 else brute(words)
    best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=(None, None, None))
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    kept = " ".join(w for k, w in enumerate(words) if k not in gone)
    return (i, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(kept))


def test_query_of_runs_against_brute_force(spark, docs, tmp_path):
    docs(rows()).withColumn("runs", F.lit(1)).withColumn("n", F.lit(2)).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, periods.op12_period_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((plain_query(i, t) for i, t in rows()), key=str)
    assert periods.collapse_runs(docs(rows()).limit(0)).count() == 0
