"""Text functions of the regulation corpus, as built-in column expressions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Private-use glyphs of word-processor fonts and what they show.
GLYPHS = {
    0xF09F: "•", 0xF09E: "◦", 0xF0A7: "▪", 0xF077: "▪", 0xF0E8: "→", 0xF081: "①", 0xF082: "②", 0xF083: "③", 0xF084: "④",
    0xF085: "⑤", 0xF086: "⑥", 0xF087: "⑦", 0xF088: "⑧", 0xF089: "⑨", 0xF08A: "⑩", 0xF000: '"', 0xE046: "-", 0xE06D: "/",
}

# What may open a structural line (part, chapter, section, article, paragraph, item, supplement, attachment).
HEADING = r"^\s*(?:제\s*\d+\s*(?:편|장|절|관|조)|부\s*칙|[\[【<]?\s*별\s*[표지]|[①-⑳]|\(\d+\)|\d+\.|[가-하][.)])"
SENTENCE_END = r"[.?!:;]$"
PAGE_FOOTER = r"^-\s*\d+\s*-$"
TOKEN = r"[\p{L}\p{N}_]+"


def normalize(text: Column) -> Column:
    """New lines, no-break and zero-width spaces, glyphs, control characters, runs of blanks and lines; each line trimmed."""
    out = F.regexp_replace(text, "\r\n?", "\n")
    out = F.translate(F.regexp_replace(out, "\u200b", ""), "\u00a0" + "".join(map(chr, GLYPHS)), " " + "".join(GLYPHS.values()))
    out = F.regexp_replace(out, r"([\uE000-\uF8FF])\1{2,}", " ")
    out = F.regexp_replace(out, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", " ")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"(?m)^ +| +$", ""), r"^\n+|\n+$", ""))


def is_page_footer(line: Column) -> Column:
    return line.rlike(PAGE_FOOTER)


def repair_line_breaks(text: Column) -> Column:
    """Joins a line to the one before unless it opens a structure or the one before ends a sentence."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    before = F.concat(F.array(F.lit("")), lines)  # each line beside the one before it
    opens = lambda x, last: x.rlike(HEADING) | last.rlike(SENTENCE_END)
    parts = F.zip_with(
        lines, before, lambda x, last: F.when(x.isNull(), "").when(last == "", x).otherwise(F.concat(F.when(opens(x, last), "\n").otherwise(" "), x))
    )
    return F.coalesce(F.array_join(parts, ""), F.lit(""))


def compact(text: Column) -> Column:
    """Without white space of any kind."""
    return F.regexp_replace(text, r"(?U)\s+", "")


def match_key(text: Column) -> Column:
    """Letters a-z, digits and Hangul syllables of the lower-cased text."""
    return F.regexp_replace(F.lower(text), "[^0-9a-z가-힣]+", "")


def number_key(text: Column) -> Column:
    """A regulation number with dashes made alike, without 제 … 호 around it."""
    plain = F.regexp_replace(F.lower(text), "[‐-―−－]", "-")
    return F.regexp_replace(F.regexp_replace(plain, r"\s+", ""), r"^제(.*)호$", "$1")


def redact(text: Column) -> Column:
    """Secrets, keys and local paths of an answer, replaced by their kind."""
    out = F.regexp_replace(text, r"""(?i)\b(password|passwd|secret|token|api_?key)["']?\s*[:=]\s*["']?[A-Za-z0-9+/_.=-]{8,}""", "$1=[redacted]")
    out = F.regexp_replace(out, r"AKIA[A-Z0-9]{12,}", "[redacted]")
    return F.regexp_replace(out, r"(?:[A-Za-z]:\\|/(?:home|Users|root)/)[^\s\"']+", "[path]")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), 1)


def context_header(document: Column, path: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("[문서명] "), document), F.concat(F.lit("[위치] "), path))


def retrieval_text(document: Column, path: Column, body: Column, rows: Column | None = None) -> Column:
    parts = [context_header(document, path), F.concat(F.lit("[본문]\n"), body)]
    if rows is not None:
        parts.append(F.concat(F.lit("[표]\n"), rows))
    return F.concat_ws("\n", *parts)


def path_below(path: Column, title: Column) -> Column:
    """The hierarchy path from the regulation's own step on; unchanged where the title is no step of it."""
    steps = F.split(path, " > ")
    at = F.array_position(steps, title)
    return F.when(at > 1, F.array_join(F.slice(steps, at.cast("int"), F.size(steps)), " > ")).otherwise(path)


def line_sections(text: Column) -> Column:
    """Parts of a text at markers (①, (1), 1., 가.) that open a line or follow a blank."""
    return F.filter(F.split(text, r"(?=(?:^|(?<=\s))(?:[①-⑳]|\(\d{1,2}\)|\d{1,2}\.\s|[가-하]\.\s))"), lambda x: F.trim(x) != "")


def canonical_headers(text: Column, title: Column, path: Column) -> Column:
    """The first '[문서명]' and '[위치]' line of a text with the canonical title and path in its place."""

    def put(body: Column, mark: str, value: Column) -> Column:
        line = rf"(?m)^\[{mark}\][ \t]*.*$"
        head = F.regexp_extract(body, rf"(?s)\A(.*?)(?m)^\[{mark}\]", 1)
        rest = F.substring(body, F.length(head) + 1, F.length(body))
        end = F.length(F.regexp_extract(rest, r"\A[^\n]*", 0))
        made = F.concat(head, F.lit(f"[{mark}] "), value, F.substring(rest, end + 1, F.length(rest)))
        return F.when(body.rlike(line) & F.coalesce(F.trim(value) != "", F.lit(False)), made).otherwise(body)

    return put(put(text, "문서명", title), "위치", path)


# Words that line breaks of a source file tear apart.
TORN = {
    "일 시금": "일시금", "정 산": "정산", "하 되": "하되", "경 우": "경우", "교 직원": "교직원", "재직기 간": "재직기간", "휴 직한": "휴직한", "7개 월째": "7개월째", "해당 하는": "해당하는",
    "70 만원": "70만원", "임신또는": "임신 또는", "3년이내": "3년 이내", "다 음": "다음", "음주운 전": "음주운전", "등 급": "등급", "징계 량": "징계량", "다 시": "다시",
}


#: What a sentence for an answer is rid of before torn words are mended (white space, marks in < >) and after (a number close to its text or
#: its bound, a particle apart from its noun, signs at the ends); what a line looks like that only names a regulation and a page.
BEFORE_MENDING = ((r"(?U)\s+", " "), (r"\s*<[^>]{1,120}>|\s*<[^>]*$", ""))
AFTER_MENDING = (
    (r"([①-⑳])(?=[가-힣A-Za-z0-9])", "$1 "),
    (r"(\d+\s*(?:년|개월|월|일|시간|분))\s*(이내|이상|이하|초과|미만|까지)", "$1 $2"),
    (r"([가-힣])\s+(으로|로|에|에서|에게|부터|까지|보다|처럼|만큼|와|과|를|을|은|는|도|의)(?![가-힣\w])", "$1$2"),
    (r"^[ ;,]+|[ ;,]+$", ""),
)
PAGE_LINE = r"^(?:\d+(?:-\d+)+\.\s*)?[가-힣A-Za-z0-9·ㆍ\s]+(?:규정|세칙|지침|요강|규칙)\s*\d+(?:\.\d+)*\.?>?$"


def replaced(text: Column, rules: Iterable[tuple[str, str]], literal: bool = False) -> Column:
    """All rules (what, instead) in turn."""
    one = (lambda t, rule: F.replace(t, F.lit(rule[0]), F.lit(rule[1]))) if literal else (lambda t, rule: F.regexp_replace(t, *rule))
    return reduce(one, rules, text)


def answer_text(text: Column) -> Column:
    """A sentence for an answer, cleaned by the rules above; empty for a line that only names a regulation and a page."""
    mended = replaced(F.trim(replaced(F.coalesce(text, F.lit("")), BEFORE_MENDING)), TORN.items(), literal=True)
    return F.when(mended.rlike(PAGE_LINE), "").otherwise(replaced(mended, AFTER_MENDING))
