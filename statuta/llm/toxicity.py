"""Operator 7: toxicity by noisy-channel deobfuscation.

A character trigram model is counted over the words of all documents (a word once per row; equal rows each). A token that looks disguised (a letter
repeated three times or more, digits or signs among its letters, digits and signs alone, single letters spaced out) becomes a lattice: each
written character may stand for itself or for the letters it imitates, a repeated character for one or two,
a gap for nothing or a word end, each at a price. Viterbi decoding under the model finds the likeliest word. The
restored text is then scored: a logistic regression over a lexicon of words and word beginnings whose presence tells
the labels apart.

Training uses at most about TRAIN_ROWS labelled rows (a hash sample when there are more), never those whose
crc32(doc_id) mod 5 is 0; equal texts count once. The weights are fitted on the driver from the lexicon entries of those rows. Only text is ever an input of a score. The lexicon (words and beginnings
found in MIN_SHARE of a label's texts) and the trigram table (bounded by the alphabet) go to every task.

Defined results: null and empty texts get the score of a text without words. Without labelled rows, or with one label
only, every score is the share of label 1 (0 without rows). A null label or id does not train; repeated
rows give a row each.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statuta.llm.common import pick, slices
from statuta.session import table

TRAIN_ROWS = 20_000
MIN_TEXTS = 3  # a lexicon entry is in at least so many training texts
MIN_SHARE = 0.01  # and in at least this share of the texts of one label
MIN_G = 12.0  # and its log-likelihood ratio statistic is at least this
BEGINNINGS = (4, 5, 6, 7)  # letters of word beginnings
STEPS, RATE, RIDGE = 400, 0.3, 1.0

#: Letters that a written sign may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i",
    "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¢": "c", "§": "s", "ß": "b", "*": "",
}
SEPARATORS = " .-_*'~"
PRICE = {"lookalike": 0.7, "itself": 6.0, "dropped": 2.5, "shorter": 0.3, "gap": 0.5, "end": 1.5}
EDGE = "^"

EDGES = re.compile(r"^[\W_]+|[\W_]+$")
REPEATED = re.compile(r"(.)\1\1")
DISGUISE = re.compile(r"[^\W\d_].*[\d@$!|+(<€£¢§*._~-]|[\d@$!|+(<€£¢§*._~-].*[^\W\d_]")
SPACED = re.compile(r"(?<!\S)(?:[^\W_][ .\-_*]){2,}[^\W_](?!\S)")
WORDS = re.compile(r"[^\W_]+")
RUNS = re.compile(r"(.)\1+")


@dataclass
class CharModel:
    """log P(c | a b) with add-half smoothing over a fixed table of trigram counts."""

    counts: dict[str, int]
    heads: dict[str, int] = field(default_factory=dict)
    letters: int = 30

    def __post_init__(self) -> None:
        for gram, n in self.counts.items():
            self.heads[gram[:2]] = self.heads.get(gram[:2], 0) + n
        self.letters = max(2, len({g[2] for g in self.counts}))

    def log_p(self, head: str, char: str) -> float:
        return math.log((self.counts.get(head + char, 0) + 0.5) / (self.heads.get(head, 0) + 0.5 * self.letters))


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Per written character or run of one: what it may stand for, and at what price."""
    steps = []
    for m in re.finditer(r"(?s)(.)\1*", token):
        char, run = m[1], m.end() - m.start()
        if char in SEPARATORS:
            steps.append([("", PRICE["gap"]), (EDGE, PRICE["end"])])
            continue
        letters = [(c, PRICE["lookalike"]) for c in LOOKALIKES.get(char, "")]
        letters.append((char, 0.0 if char.isalpha() else PRICE["itself"]))
        options = []
        for c, price in letters:
            if run == 1:
                options.append((c, price))
            elif run == 2:
                options += [(c * 2, price), (c, price + PRICE["shorter"])]
            else:
                options += [(c, price + PRICE["shorter"]), (c * 2, price + PRICE["shorter"])]
        if not char.isalnum():
            options.append(("", PRICE["dropped"]))
        steps.append(options)
    return steps


def viterbi(token: str, model: CharModel) -> list[str]:
    """The likeliest words that a disguised token stands for. State: the last two characters."""
    best: dict[str, tuple[float, tuple]] = {EDGE * 2: (0.0, ())}
    for options in [*lattice(token), [(EDGE, 0.0)]]:
        after: dict[str, tuple[float, tuple]] = {}
        for head, (score, path) in best.items():
            for out, price in options:
                state, total, way = head, score - price, path
                for c in out:
                    if c == EDGE and state[1] == EDGE:
                        continue
                    total += model.log_p(state, c)
                    way = (c, way)
                    state = EDGE * 2 if c == EDGE else state[1] + c
                if state not in after or total > after[state][0]:
                    after[state] = (total, way)
        best = after
    chars, way = [], max(best.values(), key=lambda x: x[0])[1]
    while way:
        chars.append(way[0])
        way = way[1]
    return [w for w in "".join(reversed(chars)).split(EDGE) if w]


def entries(word: str) -> list[str]:
    """A word and its beginnings, as lexicon entries."""
    return [word, *[word[:k] + "*" for k in BEGINNINGS if len(word) > k]]


def folding() -> dict[int, str]:
    """One sign for all that may be taken for one another: of letters and digits their least letter, of signs that imitate letters that letter in upper case, since they
    may also be dropped, of separators a dash."""
    like = {c: {c} for c in "".join(LOOKALIKES) + "".join(LOOKALIKES.values())}
    for sign, letters in LOOKALIKES.items():
        for c in letters:
            like[sign] = like[c] = like[sign] | like[c]
            for other in like[sign]:
                like[other] = like[sign]
    least = {c: min(x for x in group if x.isalpha()) for c, group in like.items() if any(map(str.isalpha, group))}
    return {ord(c): r if c.isalnum() else r.upper() for c, r in least.items()} | {ord(c): "-" for c in SEPARATORS}


FOLDING = folding()


def folded(token: str) -> str:
    return RUNS.sub(r"\1", re.sub(r"[^\w-]", "", token.translate(FOLDING)))


def lexicon_forms(lexicon: set[str]) -> re.Pattern[str]:
    """What the folded form of a token has, at the beginning of a word, if any reading of the token gives a lexicon entry."""
    forms = set()
    for entry in lexicon:
        letters = re.sub("[A-Z-]", "", folded(entry.rstrip("*")))
        form = "".join(f"[{c}{c.upper() if c.isascii() else ''}][A-Z{c}-]*" for c in letters)
        forms.add(form if entry.endswith("*") else form + "(?:-|$)")
    return re.compile(f"(?:^|-)[A-Z]*(?:{'|'.join(sorted(forms))})" if forms else "(?!)")


class Restorer:
    """Texts to sets of lexicon entries of their restored words (all entries without a lexicon); remembers tokens, up to a bound."""

    REMEMBERED = 160_000

    def __init__(self, model: CharModel, lexicon: set[str] | None = None):
        self.model, self.lexicon, self.known = model, lexicon, {}
        self.forms = None if lexicon is None else lexicon_forms(lexicon)

    def decoded(self, token: str) -> tuple[str, ...]:
        """The likeliest words of a disguised token; none where no reading of it can give an entry, which its folded form tells."""
        if self.forms is not None and (len(token) <= 64 or token.isalnum()) and not self.forms.search(folded(token)):
            return ()
        return tuple(viterbi(token, self.model))

    def token(self, token: str) -> tuple[str, ...]:
        core = EDGES.sub("", token)
        if len(token) > 2 and "*" not in token and token.strip("".join(LOOKALIKES)) == "":
            return self.decoded(token)  # digits and signs alone, each of which imitates a letter
        if not core or core.isdigit():
            return ()
        if core.isalpha() and core == token and not REPEATED.search(core):
            return (core,)
        odd = token if any(c in "@$!|+(<€£¢§" for c in token) else core
        plain = tuple(WORDS.findall(core)) if not core.isalpha() else (core,)
        if REPEATED.search(core) or DISGUISE.search(odd):
            return plain + self.decoded(core) + (self.decoded(odd) if odd != core else ())
        return plain

    def told(self, words: tuple[str, ...] | list[str]) -> tuple[str, ...]:
        found = {e for w in words for e in entries(w)}
        return tuple(found if self.lexicon is None else found & self.lexicon)

    def features(self, text: str | None) -> set[str]:
        text = (text or "").lower()
        found: set[str] = set()
        known = self.known
        for t in set(text.split()):
            own = known.get(t)
            if own is None:
                own = self.told(self.token(t))
                if len(t) <= 64:
                    if len(known) >= self.REMEMBERED:
                        known.clear()
                    known[t] = own
            if own:
                found.update(own)
        for m in SPACED.finditer(text):
            found.update(self.told(self.decoded(m[0])))
        return found


@dataclass
class ToxicModel:
    chars: CharModel
    weights: dict[str, float]
    bias: float

    def score(self, features: set[str]) -> float:
        z = self.bias + sum(sorted(self.weights[w] for w in features))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def fitted(rows: list[list[int]], labels: list[int], n: int) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression on rows of present entries, by full-batch Adam steps."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([c for r in rows for c in r], np.int64)
    y = np.array(labels, float)
    theta = np.zeros(n + 1)
    theta[n] = math.log(y.mean() / (1 - y.mean()))
    first, second = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, STEPS + 1):
        z = np.bincount(at, weights=theta[col], minlength=len(rows)) + theta[n]
        error = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        gradient = np.append(np.bincount(col, weights=error[at], minlength=n) + RIDGE * theta[:n], error.sum()) / len(rows)
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        theta -= RATE * (1 - step / (STEPS + 1)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta[:n], float(theta[n])


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def g_test(a: float, n: float, b: float, m: float) -> float:
    """Log-likelihood ratio of presence in a of n texts against b of m."""
    total, g = (a + b) / (n + m), 0.0
    for seen, of in ((a, n), (b, m)):
        for k, p in ((seen, total), (of - seen, 1 - total)):
            if k > 0:
                g += 2 * k * math.log(k / (of * p))
    return g


def char_model(docs: DataFrame, text: str = "text") -> CharModel:
    """The trigram counts of every row's words. Words are added up first, so each is cut into trigrams once a task."""
    lower = F.lower(F.col(f"`{text}`"))
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(lower, F.lit(r"[\p{L}]{2,}"), 0))).alias("word"))
    words = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    marked = words.select(F.concat(F.lit(EDGE * 2), "word", F.lit(EDGE)).alias("word"), "n")
    places = F.sequence(F.lit(1), F.length("word") - 2)
    grams = marked.select(F.explode(F.transform(places, lambda i: F.substring("word", i, F.lit(3)))).alias("gram"), "n")
    return CharModel({r["gram"]: r["n"] for r in grams.groupBy("gram").agg(F.sum("n").alias("n")).toLocalIterator()})


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS) -> ToxicModel:
    marks = pick(labels, doc_id=doc_id, label=label).filter("doc_id is not null and label in (0, 1)").filter(~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    there = marks.count()
    if there > rows:
        marks = marks.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 50)) < (1 << 50) * rows // there)
    texts = pick(docs, doc_id=doc_id, text=text).join(F.broadcast(marks), "doc_id")  # at most about `rows` ids
    texts = texts.groupBy(F.xxhash64("text").alias("digest")).agg(F.max("label").alias("label"), F.min_by("text", "doc_id").alias("text"))
    chars = char_model(docs, text)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer = Restorer(chars)
        for pdf in slices(batches, 500):
            seen = {0: Counter(), 1: Counter()}
            for y, t in zip(pdf["label"], pdf["text"], strict=True):
                seen[y].update(["", *restorer.features(t)])
            yield pd.DataFrame([(e, y, n) for y, c in seen.items() for e, n in c.items()], columns=["entry", "label", "n"])

    counts = texts.select("label", "text").mapInPandas(counted, "entry string, label int, n long").groupBy("entry")
    counts = counts.agg(*[F.coalesce(F.sum(F.when(F.col("label") == y, F.col("n"))), F.lit(0)).alias(c) for y, c in ((1, "a"), (0, "b"))])
    counts = counts.filter(F.col("a") + F.col("b") >= MIN_TEXTS)
    totals = counts.filter("entry = ''").collect()
    n, m = (totals[0]["a"], totals[0]["b"]) if totals else (0, 0)
    if not n or not m:
        share = min(max(n / max(1, n + m), 1e-9), 1 - 1e-9)
        return ToxicModel(chars, {}, math.log(share / (1 - share)))
    often = counts.filter((F.col("entry") != "") & ((F.col("a") >= MIN_SHARE * n) | (F.col("b") >= MIN_SHARE * m)))
    # A text has so many entries; those in MIN_SHARE of the texts of a label are at most a few hundred times as many.
    lexicon = sorted(r["entry"] for r in often.collect() if g_test(r["a"], n, r["b"], m) >= MIN_G)
    place = {e: i for i, e in enumerate(lexicon)}

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer = Restorer(chars, set(place))
        for pdf in slices(batches):
            yield pd.DataFrame({"label": pdf["label"], "at": [sorted(place[e] for e in restorer.features(t)) for t in pdf["text"]]})

    sample = texts.select("label", "text").mapInPandas(placed, "label int, at array<int>").toPandas()  # at most about `rows`
    order = sorted(range(len(sample)), key=lambda i: (list(sample["at"].iat[i]), sample["label"].iat[i]))  # sums in one order
    weights, bias = fitted([list(sample["at"].iat[i]) for i in order], [int(sample["label"].iat[i]) for i in order], len(lexicon))
    return ToxicModel(chars, dict(zip(lexicon, weights.tolist(), strict=True)), bias)


def score_toxicity(docs: DataFrame, model: ToxicModel, text: str = "text", score: str = "score") -> DataFrame:
    """docs with a score column (0 to 1), which replaces one of that name."""

    @F.pandas_udf(T.DoubleType())
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        restorer = Restorer(model.chars, set(model.weights))
        for texts in batches:
            yield texts.map(lambda t: model.score(restorer.features(t))).astype("float64")

    return docs.withColumn(score, scored(F.coalesce(F.col(f"`{text}`"), F.lit(""))))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
