"""The registered trigram scores against brute force: they use evidence beyond word pairs, over all documents."""

import math
from collections import Counter

import pytest

from statuta.llm import lm, registry


def test_trigrams_over_the_whole_corpus(docs, monkeypatch, tmp_path):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 200)
    monkeypatch.setattr(lm, "PART_BYTES", 100)  # several blocks and parts
    # both last texts have the same words and only pairs of the table; only the first one's triples are in it
    texts = ["a b c d", "a b c d", "x b y", "x b y", "z c d w", "z c d w", "a b c d", "x b c d"]
    texts += [f"u{i % 7} v{i % 3} t{i % 5} a b" for i in range(60)] + [None, "", "b", "a b"]
    d = docs(list(enumerate(texts)))
    d.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["log_score"] for r in registry.queries()["op8_lm_scoring"](d.sparkSession, str(tmp_path)).collect()}
    words = [(t or "").split() for t in texts]
    counts = Counter(tuple(w[i : i + k]) for w in words for k in (1, 2, 3) for i in range(len(w) - k + 1))
    total = sum(map(len, words))

    def log_s(w, i, k):
        gram = tuple(w[i - k + 1 : i + 1])
        if k == 1:
            return math.log(counts[gram] / total)
        return math.log(counts[gram] / counts[gram[:-1]]) if counts[gram] >= 2 else math.log(0.4) + log_s(w, i, k - 1)

    want = {j: sum(log_s(w, i, min(3, i + 1)) for i in range(len(w))) for j, w in enumerate(words)}
    assert got == pytest.approx(want, abs=1e-4)
    pairs = {j: sum(log_s(w, i, min(2, i + 1)) for i in range(len(w))) for j, w in enumerate(words)}
    assert abs(got[7] - pairs[7]) > 0.1
