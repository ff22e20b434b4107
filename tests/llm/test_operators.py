"""The ten operators against brute force, with nulls, empty texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from statuta.llm import ann, jaccard, lm, packing, pieces, quality, secrets, sharding, toxicity, urls

rng = random.Random(5)
WORDS = "the of and to rain river stone light walk green seven under house paper cloud".split()


def text(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def odd_docs(docs):
    base = text(80, 1)
    near = base.split()
    near[40] = "changed"
    rows = [(1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (7, "one two"), (None, text(30, 9)), (8, text(60, 2) + "\n" + text(60, 2))]
    rows += [(10, base.upper()), (11, "x" * 50000), (12, "a b c d e f g h " * 30)]
    return docs(rows)


def brute_quality(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    wins = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    cover = {j for i in range(len(words) - 7) if wins[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)


def test_quality_counts(docs):
    d = odd_docs(docs).withColumn("words", F.lit(1)).withColumn("n_words", F.lit(2))
    got = sorted(tuple(r)[1:6] for r in quality.quality(d).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    assert got == sorted(brute_quality(r["text"]) for r in d.collect())
    assert quality.keep_quality(d).columns == d.columns
    assert {r["doc_id"] for r in quality.keep_quality(d).collect()} <= {1, 2, 3, 8, 10, None}
    assert quality.quality(d.limit(0)).count() == 0


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted(((k, len(sets[i]), least.get(find(i))) for i, (k, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("short", [64, 2])
def test_jaccard_components(docs, monkeypatch, short):
    monkeypatch.setattr(jaccard, "SHORT_LIST", short)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    r = random.Random(3)
    rows = [(x["doc_id"], x["text"]) for x in odd_docs(docs).collect()]
    shared = text(30, 77)
    for group in range(6):
        base = text(100, 100 + group).split()
        for k in range(8):
            w = list(base)
            for _ in range(r.randrange(6)):
                w[r.randrange(len(w))] = f"v{r.randrange(9)}"
            rows.append((1000 + 10 * group + k, " ".join(w) + " " + shared))
    got = jaccard.jaccard_components(docs(rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows)


def test_keep_one_of_each_group(docs):
    d = odd_docs(docs)
    kept = jaccard.keep_one(d).collect()
    ids = sorted((r["doc_id"] for r in kept), key=str)
    assert ids == sorted([1, 4, 5, 6, 7, None, 8, 11, 12], key=str)
    assert jaccard.keep_one(d.limit(0)).count() == 0


def brute_secrets(t):
    t, found = t or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(found)


def test_secret_spans(docs):
    key = hashlib.sha1(b"k").hexdigest()
    texts = [None, "", f'token = "{key}" and é AKIA{"A1" * 8} PassWord:short api_key=abcdefgh12', f"{key}{key}", 'k = "Zx9!qLw82#kd"\ndb_pwd = k', "plain: words here = 3", "secret= token=abcdefgh9"]
    rows = secrets.scan_secrets(docs(list(enumerate(texts))).withColumn("spans", F.lit(0))).collect()
    for r in rows:
        base = [(s["start"], secrets.KINDS.index(s["kind"]), s["end"]) for s in r["spans"] if s["kind"] != "lexed"]
        assert base == brute_secrets(texts[r["doc_id"]])
    flow = next(r["spans"] for r in rows if r["doc_id"] == 4)
    assert [(s["kind"], texts[4][s["start"] : s["end"]]) for s in flow] == [("lexed", "Zx9!qLw82#kd")]
    assert not next(r["spans"] for r in rows if r["doc_id"] == 5)
    clean = secrets.redact_secrets(docs(list(enumerate(texts))))
    out = {r["doc_id"]: r for r in clean.collect()}
    assert key not in out[2]["text"] and out[0]["text"] is None and out[5]["text"] == texts[5]
    assert clean.columns == ["doc_id", "text", "lang", "source", "n_chars"] and out[2]["n_chars"] == len(out[2]["text"])


def test_pieces_are_the_librarys(docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    texts = [None, "", " ", "a", "  two  blanks ", "line\nline\r\n", "▁mark ▁", "𝒳😀 ☃ \x00", "</s> <unk>", text(400, 4), "한국어 제1조"]
    rows = pieces.encode_pieces(docs(list(enumerate(texts)))).collect()
    for r in rows:
        t = texts[r["doc_id"]] or ""
        ids = library.encode(t, add_eos=True)
        assert list(r["ids"]) == ids and r["decoded"] == library.decode(ids)
        if t:
            assert r["begins"][0] == 0 and r["ends"][-1] == len(t.encode()) and list(r["begins"][1:]) == list(r["ends"][:-1])


def test_char_map_takes_the_longest_entry():
    # a double-array trie over "a" -> "x" and "ab" -> "yz", in the layout of compiled maps
    units = np.zeros(512, np.uint32)
    blob = b"x\0yz\0"

    def link(node, char, base):
        at = base ^ char
        return at

    root = 1 << 10  # children of the root sit at 1 ^ char
    units[0] = root
    a = 1 ^ ord("a")
    base_a = 256
    units[a] = ((base_a ^ a) << 10) | (1 << 8) | ord("a")
    units[base_a] = 0x80000000 | 0
    b = base_a ^ ord("b")
    base_b = 300
    units[b] = ((base_b ^ b) << 10) | (1 << 8) | ord("b")
    units[base_b] = 0x80000000 | 2
    data = units.astype("<u4").tobytes()
    chars = pieces.CharMap(len(data).to_bytes(4, "little") + data + blob)
    assert chars.longest(b"abc", 0) == (2, b"yz")
    assert chars.longest(b"ac", 0) == (1, b"x")
    assert chars.longest(b"c", 0) is None


def test_toxicity_restores_and_separates(spark, docs):
    bad, r = ["idiot", "moron"], random.Random(1)
    rows, marks = [], []
    for i in range(400):
        words = text(30, 1000 + i).split()
        if i % 4 == 0:
            words[r.randrange(30)] = r.choice(bad)
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(i % 4 == 0)))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs(rows), labels)
    probe = docs([(1, "you id10t there"), (2, "such an i d i o t here"), (3, "a stone house"), (4, None), (5, ""), (6, "what a mooooron you are")])
    got = {x["doc_id"]: x["score"] for x in toxicity.score_toxicity(probe, model).collect()}
    assert min(got[1], got[2], got[6]) > 0.5 > max(got[3], got[4], got[5])
    held = [x for x in toxicity.score_toxicity(docs(rows), model).withColumn("out", toxicity.held_out(F.col("doc_id"))).filter("out").collect()]
    assert sum((x["score"] >= 0.5) == (x["doc_id"] % 4 == 0) for x in held) >= 0.95 * len(held)
    empty = toxicity.train(docs(rows), labels.limit(0))
    assert toxicity.score_toxicity(probe, empty).filter("score > 0.01").count() == 0


@pytest.mark.parametrize("order", [2, 3])
def test_lm_scores(docs, order):
    d = odd_docs(docs)
    texts = [(r["doc_id"], r["text"]) for r in d.collect()]
    lower = [[w.lower() for w in (t or "").split()] for _, t in texts]
    counts = [Counter(tuple(w[i : i + k]) for w in lower for i in range(len(w) - k + 1)) for k in range(1, order + 1)]
    total = sum(map(len, lower))

    def log_s(words, i, k):
        gram = tuple(words[i - k + 1 : i + 1])
        if k == 1:
            return math.log(counts[0][gram] / total)
        if counts[k - 1][gram] >= 2:
            return math.log(counts[k - 1][gram] / counts[k - 2][gram[:-1]])
        return math.log(0.4) + log_s(words, i, k - 1)

    want = sorted((len(w), round(sum(log_s(w, i, min(order, i + 1)) for i in range(len(w))), 6)) for w in lower)
    got = sorted((r["n_words"], round(r["log_score"], 6)) for r in lm.lm_scores(d, order=order).collect())
    assert [n for n, _ in got] == [n for n, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-4)


def test_packing(docs):
    rows = [(i, text(rng.randrange(1, 120), i % 50), f"src{i % 3}" if i % 5 else None) for i in range(300)] + [(900, None), (901, ""), (902, text(500, 3))]
    d = docs(rows).withColumn("bin", F.lit("clash"))
    out = packing.pack(d, capacity=100, group_rows=120).collect()
    words = {k: len((t or "").split()) for k, t, *_ in rows}
    by_doc, bins = defaultdict(int), defaultdict(list)
    for r in out:
        by_doc[r["doc_id"]] += r["length"]
        if r["bin"]:
            bins[r["bin"]].append(r)
    assert dict(by_doc) == words
    source, content = {r[0]: (r[2] if len(r) > 2 else "src0") for r in rows}, {r[0]: r[1] for r in rows}
    for held in bins.values():
        spans = sorted((r["bin_offset"], r["bin_offset"] + r["length"]) for r in held)
        assert spans[-1][1] <= 100 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        named = [source[r["doc_id"]] for r in held if source[r["doc_id"]]]
        assert len(named) == len(set(named)) and len({content[r["doc_id"]] for r in held}) == len(held)
    assert packing.pack(d.limit(0)).count() == 0


def test_best_fit_takes_the_tightest_compatible_bin():
    placed = packing.best_fit([60, 70, 30, 30], [1, 2, 2, 0], [1, 2, 4, 8], 100)
    assert placed == [(0, 0), (1, 0), (0, 60), (1, 70)]  # 30 fits best in bin 1, whose source conflicts, so its successor takes it


def test_url_filters(spark, monkeypatch):
    entries = spark.sql(
        """select * from values ('bad.com/', 'block', date'2024-01-10'), ('bad.com/', 'drop', date'2024-02-01'), ('ok.bad.com/', 'allow', date'2024-01-01'),
        ('x.org/a/', 'block', date'2024-01-01'), (null, 'block', date'2024-01-01') as t(pattern, action, listed_on)"""
    )
    rows = [(1, "http://www.bad.com/p", "2024-01-10"), (2, "http://bad.com", "2024-01-09"), (3, "http://bad.com", "2024-02-01"), (4, "https://a.ok.bad.com/q", "2024-01-20"),
            (5, "http://x.org/a/b?c", "2024-03-01"), (6, "http://x.org/ab", "2024-03-01"), (7, None, "2024-03-01"), (8, "nohost", "2024-03-01"), (9, "http://bad.com/", None), (1, "http://www.bad.com/p", "2024-01-10")]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched_at string").withColumn("fetched_at", F.col("fetched_at").cast("date")).withColumn("pattern", F.lit("clash"))
    for most in (200_000, 0):  # broadcast, and the way beyond it
        monkeypatch.setattr(urls, "BROADCAST_ENTRIES", most)
        out = urls.filter_urls(captures, entries).collect()
        assert len(out) == len(rows)
        assert {r["page_id"] for r in out if not r["kept"]} == {1, 5}
        assert {r["page_id"]: r["pattern"] for r in out}[4] == "ok.bad.com/"


def test_sharding(docs):
    rows = [(i, text(1 + i % 40, i)) for i in range(500)] + [(7000, "x" * 9000), (None, None), (8000, "y" * 600), (8000, "y" * 600), (8000, "y" * 600), (8000, "y" * 600)]
    d = docs(rows)
    out = sharding.shard(d, limit=2000, step=3).collect()
    assert len(out) == len(rows)
    sizes, counts = Counter(), Counter()
    for r in out:
        sizes[r["shard_id"]] += r["n_bytes"]
        counts[r["shard_id"]] += 1
    assert all(sizes[s] <= 2000 or counts[s] == 1 for s in sizes)
    prefixes = {s.split("-")[0] for s in sizes}
    assert not any(a != b and b.startswith(a) for a in prefixes for b in prefixes)
    parents = Counter()
    for s, n in sizes.items():
        bits = s.split("-")[0]
        parents[bits[:-1]] += n if bits else 0
    whole = {r["shard_id"].split("-")[0]: 0 for r in out}
    for r in out:
        whole[r["shard_id"].split("-")[0]] += r["n_bytes"]
    for bits in whole:  # no bucket was split that would have fitted
        if bits:
            assert sum(n for b, n in whole.items() if b.startswith(bits[:-1])) > 2000


def test_nearest_neighbours(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(20, 32))
    vectors = [(i, (centres[i % 20] + 0.4 * r.normal(size=32)).tolist()) for i in range(1500)]
    bad = [(2000, None), (2050, [0.0] * 32), (2100, [float("nan")] * 32), (2150, []), (2200, [1.0, 2.0])]
    df = spark.createDataFrame(vectors + vectors[:3] + bad, "vec_id long, embedding array<double>")
    out = ann.search(df, df.filter("vec_id % 50 = 0"), group_rows=300).collect()
    got = defaultdict(dict)
    for x in out:
        got[x["query_id"]][x["rank"]] = (x["vec_id"], x["score"])
    data = np.array([v for _, v in vectors])
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 1500, 50):
        sims = unit @ unit[q]
        sims[q] = -2
        best = set(np.argsort(-sims)[:5].tolist())
        hits += len(best & {v for v, _ in got[q].values()})
        assert all(abs(sims[v] - s) < 1e-9 for v, s in got[q].values()) and sorted(got[q]) == list(range(1, len(got[q]) + 1))
    assert hits >= 0.9 * 5 * 30 and set(got) == set(range(0, 1500, 50))
