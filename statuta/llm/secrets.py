"""Operator 4: secret scans by assignment-aware lexing.

Each whole text is read once. Three base patterns give spans of kinds assign, access and hex. The lexer then
finds every run of ':' and '=' and reads the name before it and the literal after it, in source or configuration syntax
(name = "literal", "name": 'literal', name := literal, name => literal, NAME=literal). A literal that is a name assigned before
takes that name's constant, and "a" + "b" joins the constants, so a value is followed to the sensitive name it
reaches. A literal's score is the sensitivity of its target name times the strength of its value (in steps of 1/64); at LEXED_SCORE
or more, the literal's own span is added with kind lexed unless a base span covers it.

A constant is held as counts and places, never as joined text, and the places of joined literals as plain numbers: a = a + a in many lines, "x" + "x" + ...,
long chains k1=k2=... and long runs of marks take time and memory in proportion to the text.

Defined results: a null text is an empty one and has no spans; an empty table gives no rows; a null id stays null. Very long texts, literals and names
are read in full. Spans are in code points, end exclusive. Repeated rows give a row each. Other columns are carried through by
redact_secrets whatever their names and types, and do not matter to scan_secrets.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statuta.llm.common import pick
from statuta.session import table

KINDS = ("assign", "access", "hex", "lexed")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_HINT = re.compile(r"passw|secret|token|api_?key", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
MARKS = re.compile(r"[:=](?:[\x20\t]*+[:=])*+>?[\x20\t]*+")
NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.$-")
QUOTED = re.compile(r""""([^"\n]*)"|'([^'\n]*)'""")
BARE = re.compile(r"""[^\s"',;(){}\[\]<>]++""")
JOINED = re.compile(r"""[\x20\t]*+\+[\x20\t]*+(?:"([^"\n]*)"|'([^'\n]*)'|([A-Za-z_$][\w.$-]*+))""")

#: What a target name says about its value.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9,
    "privatekey": 1.0, "accesskey": 1.0, "signature": 0.6, "auth": 0.7, "bearer": 0.8, "session": 0.5, "salt": 0.5, "connectionstring": 0.8,
}
LEXED_SCORE = 0.35
FULL_BITS = 64.0
MOST = 1 << 40  # counts of longer joined values stop here
WORDS = {"changeme", "none", "null", "true", "false", "example"}


def sensitivity(name: str) -> float:
    flat = re.sub(r"[^a-z0-9]", "", name.lower())
    return max((weight for word, weight in SENSITIVE.items() if word in flat), default=0.0)


class Value:
    """What a constant's score needs, instead of its text: length, counts of characters while they hold less than FULL_BITS of entropy
    (more characters never make it less, so beyond that they are not needed), first and last characters, and where its
    literals stand: parts is (start, end) of a literal, or (an array of starts and ends, joined values) of a joined value, whose values are shared and never copied."""

    __slots__ = ("alpha", "counts", "head", "marked", "n", "only_x", "parts", "tail", "url")

    def __init__(self, n, counts, alpha, only_x, url, head, tail, parts):
        self.n, self.counts, self.alpha, self.only_x, self.url, self.head, self.tail, self.parts = n, counts, alpha, only_x, url, head, tail, parts
        self.marked = 0.0  # the best score that its places have been given

    def strength(self) -> float:
        """0 to 1: bits of entropy of the characters, full at FULL_BITS; words of letters alone count half."""
        if self.n < 8 or self.url or self.placeholder():
            return 0.0
        return min(1.0, (FULL_BITS if self.counts is None else bits(self.counts, self.n)) / FULL_BITS) * (0.5 if self.alpha else 1.0)

    def placeholder(self) -> bool:
        """xxxx, ****, ...., <...>, ${...}, %...%, your-... and the usual words."""
        head, last = self.head.lower(), self.tail[-1:]
        if self.only_x or (self.counts is not None and len(self.counts) == 1 and head[0] in "*."):
            return True
        closed = (head[0] == "<" and last == ">") or (head[:2] == "${" and last == "}") or (head[0] == "%" and last == "%" and self.n > 1)
        return closed or head[:5] in ("your-", "your_") or (self.n == 8 and head in WORDS)


def bits(counts: dict[str, int], n: int) -> float:
    return -sum(c * math.log2(c / n) for c in counts.values())


def open_counts(counts: dict[str, int], n: int) -> dict[str, int] | None:
    return None if bits(counts, n) >= FULL_BITS else counts


def literal(text: str, start: int, end: int) -> Value:
    """The value of one literal."""
    own = text[start:end]
    counts = open_counts(Counter(own), end - start) if own else {}
    return Value(end - start, counts, own.isalpha(), bool(own) and not own.strip("xX"), "://" in own, own[:8], own[-2:], (start, end))


class Joint:
    """Values joined one after another."""

    def __init__(self) -> None:
        self.n, self.counts, self.alpha, self.only_x, self.url, self.head, self.tail = 0, {}, True, True, False, "", ""
        self.spans, self.values = array("q"), []

    def add(self, v: Value) -> Joint:
        if not v.n:
            return self
        if isinstance(v.parts[0], int):
            self.spans.extend(v.parts)
        else:
            self.values.append(v)
        self.url = self.url or v.url or "://" in self.tail + v.head
        self.head = (self.head + v.head)[:8]
        self.tail = v.tail if v.n >= 2 else (self.tail + v.tail)[-2:]
        self.n, self.alpha, self.only_x = min(MOST, self.n + v.n), self.alpha and v.alpha, self.only_x and v.only_x
        if self.counts is not None and v.counts is not None:
            for char, k in v.counts.items():
                self.counts[char] = min(MOST, self.counts.get(char, 0) + k)
            self.counts = open_counts(self.counts, sum(self.counts.values()))
        else:
            self.counts = None
        return self

    def value(self) -> Value:
        return Value(self.n, self.counts, self.alpha and self.n > 0, self.only_x and self.n > 0, self.url, self.head, self.tail, (self.spans, self.values))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, each kind leftmost and non-overlapping."""
    found = []
    if ASSIGN_HINT.search(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def name_before(text: str, at: int) -> tuple[int, int]:
    """Where the name stands that ends before a mark, perhaps in quotes or brackets; marks part names, so no character is read for two of them."""
    end = at
    while end and text[end - 1] in " \t":
        end -= 1
    if end and text[end - 1] in "\"']":
        end -= 1
        while end and text[end - 1] in "\"'":
            end -= 1
    start = end
    while start and text[start - 1] in NAME:
        start -= 1
    return start, end


def run_values(text: str, starts: array, end: int) -> Iterator[Value]:
    """Values of bare literals that begin at ascending places of one run of characters and all end with it, from the last to the
    first. The run is read once: each literal adds its own characters to what follows."""
    last = end
    while last > starts[-1] + 1 and text[last - 1] in ".:!?":
        last -= 1
    own = literal(text, starts[-1], last)
    yield own
    tail, counts, at, url, only_x = own.tail, own.counts, starts[-1], own.url, own.only_x
    for k in range(len(starts) - 2, -1, -1):
        start = starts[k]
        added = text[start:at]
        if counts is not None:
            counts = dict(counts)
            for char, n in Counter(added).items():
                counts[char] = counts.get(char, 0) + n
            counts = open_counts(counts, last - start)
        url = url or "://" in added + text[at : at + 2]
        only_x = only_x and not added.strip("xX")
        tail = tail if len(tail) == 2 else text[max(start, last - 2) : last]
        yield Value(last - start, counts, False, only_x, url, text[start : min(last, start + 8)], tail, (start, last))
        at = start


def chain(text: str, at: int, known: dict[str, Value]) -> Value | None:
    """What '+' joins on after a literal: quoted parts and names with their constants."""
    m = JOINED.match(text, at)
    if not m:
        return None
    joint = Joint()
    while m:
        group = m.lastindex
        part = known.get(m[3]) if group == 3 else None
        joint.add(part or literal(text, *m.span(group)))
        m = JOINED.match(text, m.end())
    return joint.value()


class Found:
    """Places with scores, as plain numbers."""

    def __init__(self) -> None:
        self.spans, self.scores = array("q"), array("d")

    def mark(self, value: Value, score: float) -> None:
        """Gives a score to every literal of a value. Parts that had this score before are passed by, and scores have 64 steps, so
        shared parts are visited at most so many times."""
        todo = [value]
        while todo:
            v = todo.pop()
            if v.marked >= score:
                continue
            v.marked = score
            spans = v.parts
            if not isinstance(v.parts[0], int):
                spans = v.parts[0]
                todo += v.parts[1]
            self.spans.extend(spans)
            self.scores.extend([score] * (len(spans) // 2))

    def best(self) -> Iterator[tuple[int, int, float]]:
        """(start, end, best score) of every place, in order."""
        spans, scores = np.array(self.spans, np.int64).reshape(-1, 2), np.array(self.scores)
        order = np.lexsort((-scores, spans[:, 1], spans[:, 0]))
        spans, scores = spans[order], scores[order]
        first = np.ones(len(spans), bool)
        first[1:] = (spans[1:] != spans[:-1]).any(axis=1)
        for k in np.flatnonzero(first):
            yield int(spans[k, 0]), int(spans[k, 1]), float(scores[k])


def lexed_spans(text: str) -> Iterator[tuple[int, int, float]]:
    """(start, end, score) of the literals that reach a sensitive name, in order. Time and memory grow with the text's length only."""
    known: dict[str, Value] = {}
    found = Found()

    def assign(name: str, value: Value, more: Value | None, to: dict[str, Value]) -> None:
        value = value if more is None or not more.n else Joint().add(value).add(more).value()
        to.setdefault(name, value)
        weight = sensitivity(name)
        if weight:
            score = weight * value.strength()
            if score >= LEXED_SCORE:
                found.mark(value, max(LEXED_SCORE, math.floor(score * 64) / 64))

    def assign_one(name: str, value: Value, more: Value | None) -> None:
        known.pop(name, None)
        assign(name, value, more, known)

    def assign_run(names: array, starts: array, end: int) -> None:
        """Literals of one run, from the right; of a name that stands twice the last counts, and only the last literal can be a name."""
        more, fresh = chain(text, end, known), {}
        values = run_values(text, starts, end)
        own = next(values)
        for k, value in zip(range(len(starts) - 2, -1, -1), values, strict=True):
            assign(text[names[2 * k] : names[2 * k + 1]], value, more, fresh)
        known.update(fresh)
        assign_one(text[names[-2] : names[-1]], known.get(text[starts[-1] : end]) or own, more)

    names, starts = array("q"), array("q")
    run_end = 0
    for mark in MARKS.finditer(text):
        at = mark.end()
        if names and at >= run_end:
            assign_run(names, starts, run_end)
            names, starts = array("q"), array("q")
        a, b = name_before(text, mark.start())
        if a == b or text[a].isdigit():
            continue
        quoted = QUOTED.match(text, at)
        if quoted:
            assign_one(text[a:b], literal(text, *quoted.span(quoted.lastindex)), chain(text, quoted.end(), known))
            continue
        if at >= run_end:
            bare = BARE.match(text, at)
            if not bare:
                continue
            run_end = bare.end()
        names.extend((a, b))
        starts.append(at)
    if names:
        assign_run(names, starts, run_end)
    return found.best()


def scan_text(text: str | None) -> list[tuple[int, int, int, float]]:
    """All spans (start, kind, end, score) of a text, by start, kind and end."""
    if not text:
        return []
    base = sorted(base_spans(text))
    spans = [(a, k, b, 1.0) for a, k, b in base]
    if ":" in text or "=" in text:
        starts, reach = [x for x, _, _ in base], list(accumulate((y for _, _, y in base), max))
        for a, b, score in lexed_spans(text):
            at = bisect_right(starts, a)  # base spans that begin no later
            if not at or reach[at - 1] < b:
                spans.append((a, 3, b, score))
    return sorted(spans)


SPANS = T.ArrayType(
    T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])
)


@F.pandas_udf(SPANS)
def spans_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"start": a, "kind": KINDS[k], "end": b, "score": s} for a, k, b, s in scan_text(t)])


@F.pandas_udf(T.StringType())
def redact_udf(texts: pd.Series) -> pd.Series:
    return texts.map(redact_text)


def redact_text(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans are replaced once."""
    if not text:
        return text
    out, at = [], 0
    for a, k, b, _ in scan_text(text):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k]}]"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id and spans (start, kind, end, score)."""
    base = pick(docs, doc_id=doc_id, text=text)
    return base.select(F.col("doc_id").alias(doc_id), spans_udf(F.coalesce("text", F.lit(""))).alias("spans"))


def redact_secrets(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """docs with every secret replaced; the length column, if any, follows the new text."""
    kinds = dict(docs.dtypes)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*columns).alias("row"), redact_udf(F.col(f"`{text}`")).alias("clean"))
    changed = {text: F.col("clean")}
    if length and length != text and length in kinds:
        changed[length] = F.length("clean").cast(kinds[length])
    return rows.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    spans = F.col("spans")
    of = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(joined(F.filter(spans, lambda s: s["kind"] != "lexed")), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )
