"""The line check of the gate against plain substring search."""

import random

from statuta.operators import gate


def test_held_lines_is_substring_search():
    r = random.Random(3)
    for _ in range(30):
        text = "".join(r.choice("ab가😀") for _ in range(400))
        lines = [text[a : a + r.randrange(4, 40)] for a in range(0, 360, 30)] + ["".join(r.choice("ab가😀") for _ in range(r.randrange(4, 9))) for _ in range(30)] + [text, text + "a"]
        assert gate.held_lines(text, lines, 4).tolist() == [x in text for x in lines]
    assert gate.held_lines("abc", ["abcd"], 4).tolist() == [False] and gate.held_lines("abcd", [], 4).tolist() == []


def test_lines_across_chunks_and_pieces(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randrange(0, 30)))
    parts, sources = [], []
    for d in range(4):
        own = [word() for _ in range(30)]
        parts += [(f"d{d}", i, t, f"[문서명] x\n[본문]\n{t} | {word()}") for i, t in enumerate(own)]
        whole = "".join(own)
        lines = [whole[a : a + r.randrange(8, 60)] for a in range(0, len(whole), 17)] + [word() + "z" for _ in range(9)] + [own[0] + " | --", "line one two three", own[3]] * 2
        sources.append((f"d{d}", "\r\n".join(lines)))
    sources += [("none", "a line that no chunk has"), ("null", None)]
    chunks = spark.createDataFrame(parts, "document_id string, order_index int, text string, retrieval_text string").selectExpr("*", "cast(null as string) as normalized_text", "false as table_promoted")
    bare = lambda t: "".join(c for c in t if not c.isspace() and c not in "|-")
    want = {}
    for d, text in sources:
        mine = [p for p in parts if p[0] == d]
        hay = "\n".join("".join(bare(p[k]) for p in mine) for k in (2, 3))
        lines = [x for x in (text or "").split("\r\n") if len("".join(x.split())) >= 12]
        want[d] = (len(lines), sum(len(bare(x)) >= 12 and bare(x) not in hay for x in lines))
    docs = spark.createDataFrame(sources, "document_id string, source_text string")
    for piece in (7, 1 << 21):
        got = gate.line_metrics(chunks, docs, piece).fillna(0).collect()
        assert {r["document_id"]: (r["source_lines_checked"], r["source_lines_missing_count"]) for r in got} == {k: v for k, v in want.items() if k != "null"}
    got = {r["document_id"]: (r["source_lines_checked"], r["source_lines_missing_count"]) for r in gate.coverage_metrics(chunks, docs).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 9
