"""Date functions: dates written in regulation texts, validity windows and version keys."""

from __future__ import annotations

import re
from datetime import date

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ANY_DATE = r"(\d{4})\s*(?:[.\-/]|년)\s*(\d{1,2})\s*(?:[.\-/]|월)\s*(\d{1,2})"
WRITTEN = re.compile(ANY_DATE)
PLAIN_DATE = r"\d{4}\s*(?:[.\-/]|년)\s*\d{1,2}\s*(?:[.\-/]|월)\s*\d{1,2}"


def date_of(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def all_dates(text: Column) -> Column:
    """Calendar dates of a text (dot, dash, slash or 년월일), each once, in the order found."""
    groups = [F.regexp_extract_all(text, F.lit(ANY_DATE), k) for k in (1, 2, 3)]
    dates = F.transform(F.arrays_zip(*[g.alias(n) for g, n in zip(groups, "ymd", strict=True)]), lambda x: date_of(x["y"], x["m"], x["d"]))
    return F.array_distinct(F.filter(dates, lambda x: x.isNotNull()))


def first_date(text: Column) -> Column:
    return F.get(all_dates(text), 0)


def filename_dates(name: Column) -> Column:
    """Dates of a file name: separated forms, then eight digits, then six (a year to 69 is 20yy)."""
    eight = F.regexp_extract_all(name, F.lit(r"(?<!\d)((?:19|20)\d{6})(?!\d)"), 1)
    six = F.regexp_extract_all(name, F.lit(r"(?<!\d)(\d{6})(?!\d)"), 1)
    century = lambda x: F.when(F.substring(x, 1, 2).cast("int") <= 69, F.lit("20")).otherwise(F.lit("19"))
    dates = F.concat(
        all_dates(name),
        F.transform(eight, lambda x: F.try_to_date(x, "yyyyMMdd")),
        F.transform(six, lambda x: F.try_to_date(F.concat(century(x), x), "yyyyMMdd")),
    )
    return F.array_distinct(F.filter(dates, lambda x: x.isNotNull()))


def effective_date(text: Column) -> Column:
    """The date before '부터 시행', else the one after '시행'; the sentinel promulgation_date for '공포한 날부터 시행'."""
    before = first_date(F.regexp_extract(text, PLAIN_DATE + r"\s*일?\.?\s*부터\s*시행", 0))
    after = first_date(F.regexp_extract(text, r"시행\s*(?:일)?\s*[:：]?\s*" + PLAIN_DATE, 0))
    promulgated = F.when(text.rlike(r"공포한\s*날부터\s*시행"), F.lit("promulgation_date"))
    return F.coalesce(before.cast("string"), after.cast("string"), promulgated)


def effective_on(day: Column, start: Column, end: Column, repealed: Column) -> Column:
    """In force on a day: from start, to end inclusive, before the repeal."""
    return (start.isNull() | (start <= day)) & (end.isNull() | (day <= end)) & (repealed.isNull() | (day < repealed))


def version_key(version: Column) -> Column:
    """Natural order of version tokens: numbers by value and before words."""
    return F.transform(
        F.split(version, r"[.\-]"),
        lambda x: F.struct((~x.rlike(r"^\d+$")).alias("word"), F.when(x.rlike(r"^\d+$"), x.cast("long")).alias("number"), F.lower(x).alias("text")),
    )


def article_overrides(text: Column) -> Column:
    """(article, date) of '제N조의 개정규정은 <date>부터 시행'."""
    pattern = r"(제\s*\d+\s*조(?:\s*의\s*\d+)?)\s*의?\s*개정\s*규정\s*은\s*" + PLAIN_DATE + r"\s*[.일]?\s*부터\s*시행"
    whole = F.regexp_extract_all(text, F.lit(pattern), 0)
    return F.transform(whole, lambda x: F.struct(F.regexp_replace(F.regexp_extract(x, pattern, 1), r"\s+", "").alias("article"), first_date(F.regexp_replace(x, r"^제\s*\d+\s*조", "")).alias("effective")))


def revision_events(text: Column) -> Column:
    """Bodies of '<개정 …>' marks: kind and first date."""
    marks = F.regexp_extract_all(text, F.lit(r"[<〈]\s*((?:신설|개정|삭제|전문개정|일부개정|전부개정)[^>〉]*)[>〉]"), 1)
    return F.transform(marks, lambda x: F.struct(F.regexp_extract(x, r"^(\S*?(?:신설|개정|삭제))", 1).alias("kind"), first_date(x).alias("on")))


# Marks of revisions and of coming into force, and how near to one a date must stand.
REVISED, IN_FORCE = ("개정", "일부개정", "전문개정", "전부개정", "타규정개정"), ("시행일", "시행", "효력", "적용일")
NEAR = 90


def nearest_dates(text: str | None, words: tuple[str, ...]) -> list[date]:
    text, out = text or "", []
    for word in re.finditer("|".join(sorted(words, key=len, reverse=True)), text):
        low = max(0, word.start() - NEAR)
        best = None
        for m in WRITTEN.finditer(text[low : word.end() + NEAR]):
            a, b = low + m.start(), low + m.end()
            gap = word.start() - b if b <= word.start() else max(0, a - word.end())
            try:
                on = date(int(m[1]), int(m[2]), int(m[3]))
            except ValueError:
                continue
            if best is None or gap < best[0]:
                best = (gap, on)
        out += [best[1]] if best else []
    return out


def near_dates(text: Column, words: tuple[str, ...]) -> Column:
    """For each place of a word, in order: the date nearest to it within NEAR characters before or after. Places are needed, so Arrow batches."""

    @F.pandas_udf(T.ArrayType(T.DateType()))
    def near(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: nearest_dates(t, words))

    return near(text)


def date_after(line: Column, words: tuple[str, ...]) -> Column:
    """The date that stands closest after one of the words in a line."""
    hits = [F.struct(F.length(F.regexp_extract(line, f"{w}(.*?){PLAIN_DATE}", 1)).alias("gap"), first_date(F.regexp_extract(line, f"{w}.*?({PLAIN_DATE})", 1)).alias("on")) for w in words]
    made = F.filter(F.array(*hits), lambda x: x["on"].isNotNull())
    return F.array_min(made)["on"]


def leading_history(text: Column, lines: int = 300) -> Column:
    """(revised, in_force): dates of the history at the head of a text, each once, of lines that name a revision or a coming into force."""
    head = F.slice(F.split(F.coalesce(text, F.lit("")), "\n"), 1, lines)
    dated = F.filter(head, lambda x: x.rlike(PLAIN_DATE))
    revised = F.transform(F.filter(dated, lambda x: x.rlike("제정|개정")), lambda x: F.coalesce(date_after(x, ("제정", "개정")), first_date(x)))
    force = F.transform(F.filter(dated, lambda x: x.rlike("시행|효력|적용일")), lambda x: F.coalesce(date_after(x, ("시행", "효력", "적용일")), F.array_max(all_dates(x))))
    clean = lambda a: F.array_distinct(F.filter(a, lambda d: d.isNotNull()))
    return F.struct(clean(revised).alias("revised"), clean(force).alias("in_force"))


def validity_windows(effective: Column, overrides: Column, history: Column) -> Column:
    """Windows (article, valid_from, source) of a document: its own start for '*', each article's override (article, effective), and the latest
    start of its history (dates in order); each once."""
    window = lambda article, start, source: F.struct(article.cast("string").alias("article"), start.cast("string").alias("valid_from"), F.lit(source).alias("source"))
    none = F.array().cast("array<struct<article:string,valid_from:string,source:string>>")
    own = F.when(effective.isNotNull(), F.array(window(F.lit("*"), effective, "document_effective_date"))).otherwise(none)
    told = F.filter(F.coalesce(overrides, F.array().cast("array<struct<article:string,effective:date>>")), lambda o: (F.trim(o["article"]) != "") & o["effective"].isNotNull())
    articles = F.transform(told, lambda o: window(o["article"], o["effective"], "article_effective_override"))
    last = F.get(F.filter(history, lambda d: d.isNotNull()), F.size(F.filter(history, lambda d: d.isNotNull())) - 1)
    late = F.when(last.isNotNull(), F.array(window(F.lit("*"), last, "latest_revision_history_effective_date"))).otherwise(none)
    return F.array_distinct(F.concat(own, articles, late))


def supplementary(text: Column) -> Column:
    """(is_supplementary, identifier_date, boilerplate) of a provision: 부칙, its date in < >, and whether it says no more than when it comes into force."""
    own = text.rlike(r"(?m)^\s*부\s*칙")
    marked = first_date(F.regexp_extract(text, rf"부\s*칙\s*(?:[<〈(\[]\s*)?({PLAIN_DATE})", 1))
    body = F.trim(F.regexp_replace(F.regexp_replace(text, r"(?m)^\s*부\s*칙[^\n]*$", ""), r"\s+", " "))
    plain = body.rlike(rf"^(?:제\s*\d+\s*조\s*\(\s*시행일\s*\)\s*)?(?:[①-⑮]\s*)?(?:[(（]\s*시행일\s*[)）]\s*)?이\s*(?:규정|정관|지침|세칙|내규|요령|기준)?\s*은\s*(?:공포한\s*날|{PLAIN_DATE}\s*[일.]?)\s*부터\s*시행한다\.?$")
    return F.struct(own.alias("is_supplementary"), F.when(own, marked).alias("identifier_date"), (own & plain & (F.size(article_overrides(text)) == 0)).alias("boilerplate"))
