"""Operator 13 against a plain trie, with nulls, ties, copies, long and turnless conversations and clashing columns."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from statuta.llm import tries
from statuta.session import shared_folder

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(said):
    """Nodes of {conv_id: [(role, text), ...]}."""
    members = defaultdict(list)
    for c, turns in said.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            kids[path[:-1]] += 1
    for path, of in members.items():
        own = (len(of) - 1) * len(path[-1][1].encode()) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not kids[path]
            saved[path[:d]] += own
    out = []
    for path, of in members.items():
        ends = ",".join(map(str, sorted(c for c in of if len(said[c]) == len(path))))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(of), len(path), parent, len(of), kids[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(rows):
    said = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            said[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v)] for c, v in said.items()}


def rows(seed=1):
    r = random.Random(seed)
    stem = [(r.choice(["user", "assistant"]), f"text é {r.randrange(5)}") for _ in range(9)]
    out = []
    for c in range(-6, 70):
        turns = stem[: r.randrange(10)] + [(r.choice(["user", None]), r.choice(["a", "bb", "", None, f"own {c}"])) for _ in range(r.randrange(6))]
        out += [(c * 3, None if k == 0 and r.random() < 0.3 else k, *x) for k, x in enumerate(turns)]
    out += [(1000 + c, k, "user", f"copy {k}") for c in range(25) for k in range(8)]
    out += [(2000 + c, k, "user", f"long {k}") for c in range(2) for k in range(150 + 60 * c)]
    return [*out, (None, 1, "user", "of nobody"), (2000, 7, "user", "tie"), (2000, 7, "user", "tie"), (2000, 7, None, "tie"), (5, 2, "", ""), (10**12, 1, "user", "x" * 100_000)]


@pytest.mark.parametrize(("segment", "heavy", "shard"), [(128, 20_000, 50_000), (3, 6, 40), (8, 30, 100)])
def test_trie_against_plain_version(spark, segment, heavy, shard):
    d = spark.createDataFrame(rows(), SCHEMA).withColumn("place", F.lit(1)).withColumn("value_", F.lit(2)).repartition(3)
    folder = shared_folder(spark)
    turns = tries.labelled(d, folder)
    if segment == 3:  # long chains take a round for each segment: fewer of them
        turns = turns.filter("conv_id < 2000")
    said = {c: t for c, t in conversations(rows()).items() if segment != 3 or c < 2000}
    found = tries.prefix_trie(turns, turns.select("conv_id").distinct(), folder, segment, heavy, shard)
    assert sorted(map(tuple, found.collect()), key=str) == plain(said)


def test_query_rebuilds_conversations(spark, tmp_path):
    spark.createDataFrame(rows(2), SCHEMA).repartition(2).write.parquet(f"{tmp_path}/conversations.parquet")
    own = conversations(rows(2))
    said = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = own.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])
        said[c] = base[:h] + turns[h:]
    assert sorted(map(tuple, tries.op13_conversation_trie(spark, str(tmp_path)).collect()), key=str) == plain(said)


def test_empty_table_and_turnless_conversations(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert tries.conversation_trie(none).count() == 0
    turns = tries.labelled(none, shared_folder(spark))
    ids = spark.createDataFrame([(7,), (-3,)], "conv_id long")
    assert list(map(tuple, tries.prefix_trie(turns, ids, shared_folder(spark)).collect())) == plain({7: [], -3: []})


def test_bits_of_a_small_trie():
    import numpy as np

    # rows: x, x y, x z z, w; first labels are the nodes of the first level
    a = np.array([1, 1, 2, 1, 3, 3, 9])
    lengths = np.array([1, 2, 3, 1])
    trie = tries.build(np.array([1, 1, 1, 9]), np.zeros(4, np.int64), np.ones(4, np.int64), np.cumsum(lengths) - lengths, lengths, a, a, a)
    assert "".join("01"[int(x)] for x in trie.bits) == "110" + "110" + "0" + "0" + "10" + "0"
    assert trie.parents().tolist() == [-1, -1, 0, 0, 3] and trie.degrees().tolist() == [2, 0, 0, 1, 0]
