"""Only pieces of one source or with the same words conflict: nothing is folded to 64 bits."""

from statuta.llm import packing


def test_unrelated_pieces_share_bins(docs):
    # 300 sources and 300 texts, no two alike: all bins must be full, which 64-bit maps never allow
    rows = [(i, f"word{i}", f"src{i}") for i in range(300)]
    out = packing.pack(docs(rows), capacity=100).collect()
    assert len(out) == 300 and len({r["bin"] for r in out}) == 3


def test_sources_whose_hashes_meet(docs):
    rows = [(k, f"a{k} b c", s) for k, s in enumerate(["src12", "src18"])]
    assert len({r["bin"] for r in packing.pack(docs(rows)).collect()}) == 1
    same = [(k, f"a{k} b c", "src12") for k in range(2)] + [(9, "a0 b c", "src3")]
    bins = {r["doc_id"]: r["bin"] for r in packing.pack(docs(same)).collect()}
    assert bins[0] != bins[1] and bins[9] != bins[0]
