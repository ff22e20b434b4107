"""Numbers and signs that stand for words, of any length; those that cannot be an entry are told without decoding."""

import random

from statuta.llm import toxicity


def model():
    words = "boobs boob tools glass total ease lies stone best table".split()
    counts = {}
    for w in words:
        marked = toxicity.EDGE * 2 + w + toxicity.EDGE
        for i in range(len(marked) - 2):
            counts[marked[i : i + 3]] = counts.get(marked[i : i + 3], 0) + 9
    return toxicity.CharModel(counts)


def test_numbers_count_whatever_their_length_and_signs():
    r = toxicity.Restorer(model(), {"boob*", "boobs", "tools"})
    assert r.features("8008") == set() and r.features("80085") == r.features("80085!") == {"boob*", "boobs"} and r.features("70015") == {"tools"}
    assert r.features("800085") >= {"boobs"} and r.features("8" * 5000) == set() and r.features("12 3456789 1999") == set()


def test_tokens_that_are_not_decoded_have_no_entry():
    chars, rng = model(), random.Random(5)
    skipped = decoded = 0
    for lexicon in ({"boob*", "tools", "ease", "lies", "best*", "glass", "b0ob", "to"}, set(), {"stone"}, {"total*", "as"}):
        quick, whole = toxicity.Restorer(chars, lexicon), toxicity.Restorer(chars, lexicon)
        whole.forms = None
        words = [w for e in lexicon for w in (e.rstrip("*"), e.rstrip("*") + "s")] or ["table"]
        back = {c: s for s, letters in toxicity.LOOKALIKES.items() for c in letters}
        for _ in range(1500):
            if rng.random() < 0.4:  # a word disguised
                t = "".join(back.get(c, c) if rng.random() < 0.4 else c * rng.choice([1, 1, 1, 2, 4]) for c in rng.choice(words))
                t = "".join(c + rng.choice(["", "", "", ".", "-", "!", "*", "%"]) for c in t)
            else:
                t = "".join(rng.choice("0013578869aeglost!@$|+(.-_*%~ßé") for _ in range(rng.randrange(2, 12)))
            assert quick.features(t) == whole.features(t), (t, lexicon)
            spaced = " ".join(t[:5])
            assert quick.features(spaced) == whole.features(spaced), (spaced, lexicon)
            hit = quick.forms.search(toxicity.folded(t)) is not None
            skipped, decoded = skipped + (not hit), decoded + hit
    assert skipped > 1500 and decoded > 500
