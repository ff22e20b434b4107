"""Hard inputs of the operators: growth, exact bounds, empty tables, nulls, ties, clashing columns; brute force where there is no SQL."""

import itertools
import random
import re
import time
import tracemalloc
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from statuta.llm import ann, jaccard, lm, packing, pieces, secrets, sharding, toxicity, urls


@pytest.mark.parametrize(
    "text",
    ['a = "q8Zk!x92"\n' + "a = a + a\n" * 60 + "password = a\n", "=".join(f"k{i}" for i in range(60_000)), "name" + ":" * 500_000 + "x", "password=" * 50_000, 'secret = "ab"\n' + 'secret = secret + "a"\n' * 20_000,
     "a=" + '"x"+' * 250_000, "db_pwd=" + '"x"+' * 250_000, "password=" + '"9Z"+' * 200_000, "=k" * 400_000, "=".join(f"k{i}" for i in range(145_000))],
)
def test_secret_lexer_grows_with_the_text_only(text):
    start = time.time()
    secrets.scan_text(text)
    assert time.time() - start < 6
    tracemalloc.start()
    secrets.scan_text(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6


def plain_lexer(text):
    """Lines of `name = part + part`, parts quoted or names, with joined texts kept as they are."""
    known, found, at = {}, set(), 0
    for line in text.split("\n"):
        name, _, rest = line.partition(" = ")
        value, places, pos = "", [], at + len(name) + 3
        for part in rest.split(" + "):
            if part.startswith('"'):
                value, places = value + part[1:-1], [*places, (pos + 1, pos + len(part) - 1)]
            elif part in known:
                value, places = value + known[part][0], places + known[part][1]
            else:
                value, places = value + part, [*places, (pos, pos + len(part))]
            pos += len(part) + 3
        known[name] = (value, places)
        counts = {c: value.count(c) for c in value}
        strength = 0.0
        if len(value) >= 8 and "://" not in value and not re.fullmatch(r"(?i)x+|\*+|\.+|changeme|your[-_].*|<.*>|\$\{.*\}|%.*%", value):
            strength = min(1.0, -sum(n * np.log2(n / len(value)) for n in counts.values()) / 64) * (0.5 if value.isalpha() else 1)
        if secrets.sensitivity(name) * strength >= secrets.LEXED_SCORE:
            found.update((a, b) for a, b in places if a < b)  # an empty part has no span
        at += len(line) + 1
    return found


def test_secret_lexer_against_joined_texts():
    r = random.Random(8)
    names = ["a", "b", "user", "db_pwd", "session_id", "client_auth", "c.d"]
    parts = ['"Zx9!q"', '"aaaa"', '"xxxxxxxxx"', '"https:"', '"//h/p"', '"7f"', '""', '"<abcdefg>"', '"changeme"', '"word"', '"%zQ81_%"']
    for _ in range(300):
        lines = [f"{r.choice(names)} = " + " + ".join(r.choice(parts + names) for _ in range(r.randrange(1, 5))) for _ in range(8)]
        text = "\n".join(lines)
        assert {(a, b) for a, b, _ in secrets.lexed_spans(text)} == plain_lexer(text), text


def test_secret_stage_carries_any_column(spark, docs):
    d = docs([(1, 'x token = "04dbebab91ab85687d33eeaaf9ac699e"'), (None, None)])
    d = d.withColumn("a.b", F.lit(1)).withColumn("m", F.create_map(F.lit("k"), F.col("doc_id"))).withColumn("row", F.lit(2)).withColumn("clean", F.lit(3))
    out = secrets.redact_secrets(d)
    assert out.columns == d.columns and [r["m"]["k"] for r in out.orderBy("doc_id").collect()] == [None, 1]
    kept = jaccard.keep_one(d)
    assert kept.columns == d.columns and kept.count() == 2
    assert secrets.scan_secrets(d.limit(0)).count() == 0


def test_jaccard_at_exactly_three_quarters(docs):
    def words(*ranges):  # one shingle a word beyond the fourth
        return " ".join(f"w{i}" for lo, hi in ranges for i in range(lo, hi))

    # 3 of 4 shingles shared: linked; 2 of 3 and 5 of 7: not
    rows = [(1, words((0, 7))), (2, words((0, 8))), (3, words((100, 106))), (4, words((100, 107))), (5, words((200, 210))), (6, words((200, 209)) + " z z")]
    found = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs(rows)).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}


def test_jaccard_long_lists_are_cut(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "SHORT_LIST", 3)
    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    r = random.Random(4)
    rows = []
    for i in range(60):  # all share most of a frequent passage, in lengths that differ, some near enough to link
        own = [f"p{k}" for k in range(30 + i // 6)]
        rows.append((i, " ".join(own + [f"t{i // 3}x{k}" for k in range(r.randrange(14))])))
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    root = {i: i for i in sets}
    for _ in sets:
        for a, b in itertools.combinations(sets, 2):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    found = {x["doc_id"]: x["component_id"] for x in jaccard.jaccard_components(docs(rows).withColumn("cid", F.lit(0))).collect()}
    assert found == root


def test_packing_against_plain_best_fit():
    r = random.Random(6)
    for _ in range(30):
        n = 80
        sizes = sorted((r.randrange(1, 100) for _ in range(n)), reverse=True)
        sources = [r.randrange(6) if r.random() < 0.8 else None for _ in range(n)]
        clusters = [r.randrange(40) for _ in range(n)]
        got = packing.best_fit(sizes, packing.one_bits(sources), packing.one_bits(clusters), 100)
        bins = []  # (room, sources, clusters)
        for size, source, cluster, (number, offset) in zip(sizes, sources, clusters, got, strict=True):
            fit = [(room, k) for k, (room, ss, cs) in enumerate(bins) if room >= size and source not in ss and cluster not in cs]
            if fit:
                room, k = min(fit)
            else:
                room, k = 100, len(bins)
                bins.append((100, set(), set()))
            assert (number, offset) == (k, 100 - room)
            bins[k] = (room - size, bins[k][1] | ({source} if source is not None else set()), bins[k][2] | {cluster})


def test_sharding_against_splits_one_by_one(docs):
    rows = [(i % 90, "t" * (1 + i * 37 % 211)) for i in range(400)] + [(500, "y" * 900)] * 9 + [(None, None), (3, "z" * 5000)]
    d = docs(rows).withColumn("bits", F.lit("clash"))
    out = sharding.shard(d, limit=1500, step=4).collect()
    digits = lambda v, n: bin(int(__import__("hashlib").md5(("" if v is None else f"={v}").encode()).hexdigest()[:n], 16))[2:].zfill(4 * n)
    items = [(digits(k, 11) + digits(t, 4), len(t or "")) for k, t in rows]
    want = []

    def split(held, depth):
        if sum(n for _, n in held) <= 1500 or len(held) == 1:
            want.extend((b[:depth], n) for b, n in held)
        elif depth == sharding.LAST_BIT:
            want.extend((b[:depth], n) for b, n in held)
        else:
            for bit in "01":
                part = [x for x in held if x[0][depth] == bit]
                if part:
                    split(part, depth + 1)

    split(items, 0)
    assert sorted((r["shard_id"].split("-")[0], r["n_bytes"]) for r in out) == sorted(want)
    pages = defaultdict(int)
    for r in out:
        pages[r["shard_id"]] += r["n_bytes"]
    assert sorted(n for s, n in pages.items() if not s.endswith("-0")) == [900] * 9  # one row of 900 bytes fits a page of 1,500
    assert sharding.shard(d.limit(0)).count() == 0


def test_viterbi_against_all_paths():
    words = ["idiot", "moron", "stone", "stones", "light", "toil"]
    counts = defaultdict(int)
    for w in words:
        marked = "^^" + w + "^"
        for i in range(len(marked) - 2):
            counts[marked[i : i + 3]] += 3
    model = toxicity.CharModel(dict(counts))

    def best_path(token):
        best = None
        for path in itertools.product(*toxicity.lattice(token), [("^", 0.0)]):
            state, total, out = "^^", 0.0, ""
            for chars, price in path:
                total -= price
                for c in chars:
                    if c == "^" and state[1] == "^":
                        continue
                    total += model.log_p(state, c)
                    out += c
                    state = "^^" if c == "^" else state[1] + c
            if best is None or total > best[0] + 1e-12:
                best = (total, out)
        return [w for w in best[1].split("^") if w]

    for token in ["1d10t", "m0r0n", "s.t.o.n.e", "5t0nes", "liiight", "i d i o t", "l1ght", "@$", "700"]:
        assert toxicity.viterbi(token, model) == best_path(token), token
    assert toxicity.viterbi("1d10t", model) == ["idiot"]
    assert toxicity.Restorer(model).token("101") != ()  # digits alone are decoded too


def test_hosts_and_addresses(spark, monkeypatch):
    entries = spark.sql("select * from values ('2.3/', 'block', date'2024-01-01'), ('bad.com/', 'block', date'2024-01-01'), ('[2001:db8::1]/', 'block', date'2024-01-01'), ('10.1.2.4/', 'block', date'2024-01-01') as t(pattern, action, listed_on)")
    cases = [(1, "http://10.1.2.3/x", True), (2, "http://10.1.2.4:80/", False), (3, "http://bad.com./a", False), (4, "http://u@[2001:DB8::1]:8/", False), (5, "http://[2001:db8::2]/", True), (6, "http://BAD.com:99", False), (7, "http://notbad.com", True)]
    d = spark.createDataFrame([(i, u, "2024-02-02") for i, u, _ in cases], "page_id long, url string, fetched_at string").withColumn("fetched_at", F.col("fetched_at").cast("date"))
    d = d.withColumn("salt", F.lit(0)).withColumn("action", F.lit("x"))
    for most in (200_000, 0):
        monkeypatch.setattr(urls, "BROADCAST_ENTRIES", most)
        assert {r["page_id"]: r["kept"] for r in urls.filter_urls(d, entries).collect()} == {i: kept for i, _, kept in cases}
        assert urls.filter_urls(d.limit(0), entries).count() == 0
        assert urls.filter_urls(d, entries.limit(0)).filter("kept").count() == len(cases)


def test_empty_tables_and_clashing_columns(spark, docs):
    d = docs([(1, "one two three one two three"), (None, None), (3, "")])
    clash = d.withColumn("n_words", F.lit(1)).withColumn("ids", F.lit(1)).withColumn("block", F.lit(1)).withColumn("score", F.lit("x")).withColumn("h", F.lit(1)).withColumn("size", F.lit(1))
    assert pieces.encode_pieces(clash).count() == 3 and pieces.encode_pieces(d.limit(0)).count() == 0
    assert {r["doc_id"]: r["n_words"] for r in lm.lm_scores(clash).collect()} == {1: 6, None: 0, 3: 0} and lm.lm_scores(d.limit(0)).count() == 0
    assert packing.pack(clash).count() == 3 and jaccard.jaccard_components(clash).count() == 3
    model = toxicity.ToxicModel(toxicity.CharModel({}), {}, -1.0)
    scored = toxicity.score_toxicity(clash, model)
    assert scored.columns == clash.columns and all(r["score"] == pytest.approx(1 / (1 + np.e)) for r in scored.collect())
    v = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 2), (2, [0.0, -1.0], 3), (3, [0.0, 2.0], 4), (None, [1.0, 1.0], 5), (4, [-1.0, 0.0], 6)], "vec_id long, embedding array<double>, tab int")
    out = {r["rank"]: r["vec_id"] for r in ann.search(v.withColumn("key", F.lit(1)), v.filter("vec_id = 0")).collect()}
    assert out == {1: 1, 2: 2, 3: 3, 4: 4}  # all candidates: three ties at 0 by id, then the antipode
    assert ann.search(v.limit(0), v.limit(0)).count() == 0
