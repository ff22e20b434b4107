"""Korean text: tokens with endings and compounds, damaged-text spans, Unicode folding. Arrow batches."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Particles and verb endings, longest first when matched.
ENDINGS = (
    "으로부터 로부터 에게서 에서도 에서 에게 으로 부터 까지 하고 하며 하는 하여 하면 하게 했다 한다 된다 되어 된 한 은 는 이 가 을 를 에 로 와 과 도 만 의"
).split()
# Closing words of compounds (leave, procedure, application, regulation, allowance, payment, hiring, contract, inspection, acceptance, form, table).
CLOSINGS = "휴직 절차 신청 규정 수당 지급 채용 계약 검사 검수 서식 별표".split()
ARTICLE = re.compile(r"제\s*\d+\s*조(?:\s*의\s*\d+)?")
WORD = re.compile(r"\w+")


def strip_ending(word: str) -> str:
    """The word without its longest known ending, if two characters or more are left."""
    for size in range(min(4, len(word) - 2), 0, -1):
        if len(word) > 2 and word[-size:] in ENDINGS:
            return word[:-size]
    return word


def compound(word: str) -> list[str]:
    for closing in CLOSINGS:
        head = word.removesuffix(closing)
        if head != word and len(head) >= 2:
            return [head, closing]
    return []


def token_list(text: str | None, distinct: bool = True) -> list[str]:
    """Article numbers first, then words, each with its compound parts and its stem."""
    text = unicodedata.normalize("NFC", text or "")
    out = ["".join(m[0].split()).lower() for m in ARTICLE.finditer(text)]
    for word in WORD.findall(text.lower()):
        if ARTICLE.fullmatch(word):
            out.append(word)
            continue
        stem = strip_ending(word)
        out += [word, *compound(word), *([stem] if stem != word else [])]
    return list(dict.fromkeys(out)) if distinct else out


@F.pandas_udf(T.ArrayType(T.StringType()))
def korean_tokens(texts: pd.Series) -> pd.Series:
    return texts.map(token_list)


@F.pandas_udf(T.StringType())
def nfkc_fold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


# Brackets of a Hanja gloss, sequences seen in damaged files, pieces that every exported file has, and scripts that no regulation is written in.
GLOSS = {"(": ")", "（": "）", "[": "]", "［": "］", "「": "」", "『": "』", "〔": "〕", "《": "》", "<": ">"}
SEEN = "捤獥|汤捯|氠瑢|湰灧|桤灧|灳瑣|湯慴|湯湷|†普"
EXPORTED = re.compile("慤桥|漠杳")
FOREIGN = "Ā-ͯЀ-֏֐-ࣿऀ-࿿က-ჿሀ-᳿Ḁ-ỿ"
# CJK characters both of whose bytes are a lower-case letter or a blank: names of a file's parts, read as text.
PAIRED = "".join(f"{chr(high << 8 | 0x20)}{chr(high << 8 | 0x61)}-{chr(high << 8 | 0x7A)}" for high in range(0x61, 0x7B))
SUSPECT = re.compile(f"(?:{SEEN}|[{PAIRED}{FOREIGN}])+")
CERTAIN = re.compile(f"{SEEN}|[{FOREIGN}]")
LOST = re.compile(f"{SEEN}|[㐀-鿿豈-\ufaff]")


def damaged_spans(text: str | None) -> list[tuple[int, int, bool]]:
    """(begin, end, lost) of damaged runs: with a foreign letter or a known sequence, or two paired characters or more that are no bracketed gloss. lost: content stood there,
    not a leftover of the export or of the layout."""
    text, spans = text or "", []
    for m in SUSPECT.finditer(text):
        a, b = m.span()
        gloss = a > 0 and b < len(text) and GLOSS.get(text[a - 1]) == text[b]
        if CERTAIN.search(m[0]) or (b - a >= 2 and not gloss):
            rest = EXPORTED.sub("", m[0]).strip()
            spans.append((a, b, bool(rest and LOST.search(m[0]))))
    return spans


DAMAGE = T.StructType([T.StructField("n_damaged", T.IntegerType()), T.StructField("n_cleaned", T.IntegerType()), T.StructField("cleaned", T.StringType())])


@F.pandas_udf(DAMAGE)
def damage(texts: pd.Series) -> pd.DataFrame:
    """Characters in spans where content was lost, in other damaged spans, and the text with a blank for each span."""
    rows = []
    for t in texts:
        spans, kept, at = damaged_spans(t), [], 0
        for a, b, _ in spans:
            kept += [t[at:a], " "]
            at = b
        rows.append((sum(b - a for a, b, lost in spans if lost), sum(b - a for a, b, lost in spans if not lost), (t or "") if not spans else "".join([*kept, t[at:]])))
    return pd.DataFrame(rows, columns=["n_damaged", "n_cleaned", "cleaned"])
