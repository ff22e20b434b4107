"""References, intents and identity of regulations."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statuta.operators.numbering import running

# How regulations and laws are named, and words that connect references of one source.
OWN = ("규정", "지침", "내규", "정관", "세칙", "요령", "기준", "편람", "규칙", "예규")
LAWS = ("시행규칙", "시행령", "시행규정", "법률", "법", "영", "령")
SELF = ("이", "본", "동", "해당", "현")
ARTICLE = re.compile(r"제\s*(\d+)\s*조(?:\s*의\s*(\d+))?(?:\s*제\s*(\d+)\s*항)?(?:\s*제\s*(\d+)\s*호)?")
CONNECT = re.compile(r"^[\s,·ㆍ및와과또는]*$")
QUOTED = re.compile(r"[「『“\"]\s*([^」』”\"\n]{1,80})\s*[」』”\"]\s*$")
NAMED = re.compile(rf"([가-힣A-Za-z0-9·ㆍ]+(?:\s[가-힣A-Za-z0-9·ㆍ]+)?(?:{'|'.join([*OWN, *LAWS])}))\s*$")
LOOK_BACK, INHERIT = 120, 160

REFERENCES = T.ArrayType(
    T.StructType([T.StructField(n, T.StringType()) for n in ("article", "scope", "name")])
)


def article_references(text: str | None) -> list[dict]:
    """Every article reference with its scope: own regulation, another regulation or a law, by the name before it.

    A reference without a name takes that of the reference before it when only connecting words stand between."""
    out, last = [], None
    for m in ARTICLE.finditer(text or ""):
        before = text[max(last[0] if last else 0, m.start() - LOOK_BACK) : m.start()]
        hit = QUOTED.search(before) or NAMED.search(before)
        name, scope = None, "own"
        if hit:
            name = hit[1].strip()
            bare = name.split()[-1]
            if any(name.startswith(s) and name[len(s) :].strip() in OWN for s in SELF) or bare in OWN and name.split()[0] in SELF:
                name = None
            else:
                scope = "regulation" if name.endswith(OWN) else "law"
        elif last and m.start() - last[0] <= INHERIT and CONNECT.match(text[last[0] : m.start()]):
            name, scope = last[1], last[2]
        article = f"제{m[1]}조" + (f"의{m[2]}" if m[2] else "") + (f"제{m[3]}항" if m[3] else "") + (f"제{m[4]}호" if m[4] else "")
        out.append({"article": article, "scope": scope, "name": name})
        last = (m.end(), name, scope)
    return out


@F.pandas_udf(REFERENCES)
def references(texts: pd.Series) -> pd.Series:
    return texts.map(article_references)


def attachment_references(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"(별\s*[표지]\s*(?:제\s*)?\d+(?:\s*-\s*\d+)?(?:\s*호)?(?:\s*서식)?)"), 1)
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"\s+", "")))


# What a sentence that answers an intent says.
INTENTS = {
    "procedure": r"절차|신청|제출|승인|process|apply", "period": r"기간|일 이내|개월|기한|within|days", "amount": r"금액|지급|수당|원\b|amount|pay",
    "condition": r"경우|조건|요건|if\b|when", "authority": r"위원회|이사장|원장|부서|committee", "sanction": r"징계|처벌|위반|penalty", "definition": r"말한다|이란|means|is called",
}


def intents(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(f"(?i){p}"), F.lit(n)) for n, p in INTENTS.items()]))


def outline(text: Column, most: int = 5) -> Column:
    """The `most` sentences with the most intents, then the earliest."""
    sentences = F.filter(F.split(text, r"(?<=[.?!])\s+|\n"), lambda x: F.trim(x) != "")
    ranked = F.array_sort(F.transform(sentences, lambda x, i: F.struct((-F.size(intents(x))).alias("s"), i.alias("i"), x.alias("t"))))
    return F.transform(F.slice(ranked, 1, most), lambda x: x["t"])


def stable_id(title: Column, most: int = 64) -> Column:
    """A key of a title: letters and digits joined by '-', with a hash where it is too long."""
    key = F.regexp_replace(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", "")
    return F.when(F.length(key) <= most, key).otherwise(F.concat(F.substring(key, 1, most - 9), F.lit("-"), F.substring(F.sha2(key, 256), 1, 8)))


def version_of(name: Column, effective: Column) -> Column:
    """vN or 제N차 of a name, else rev- and the date."""
    explicit = F.nullif(F.regexp_extract(F.lower(name), r"(?:^|[^a-z])v(\d+)", 1), F.lit(""))
    ordinal = F.nullif(F.regexp_extract(name, r"제\s*(\d+)\s*차", 1), F.lit(""))
    return F.coalesce(explicit, ordinal, F.concat(F.lit("rev-"), F.date_format(effective, "yyyyMMdd")))


def inherited(rows: DataFrame, scope: str, field: str) -> DataFrame:
    """field filled from its scope where the scope has one value for it; field_status: own, inherited, conflict or none. The least and the greatest
    value of a scope tell whether it has one: a partial aggregate, however many rows a scope has."""
    ends = rows.groupBy(scope).agg(F.min(field).alias("least_"), F.max(field).alias("most_"))
    both = rows.alias("r").join(ends.withColumnRenamed(scope, "scope_"), F.col(f"r.{scope}").eqNullSafe(F.col("scope_")))
    single = F.col("least_") == F.col("most_")
    status = F.when(F.col(field).isNotNull(), "own").when(single, "inherited").when(F.col("least_").isNotNull(), "conflict").otherwise("none")
    filled = F.coalesce(F.col(field), F.when(single, F.col("least_")))
    return both.select(*[filled.alias(c) if c == field else F.col(f"r.{c}") for c in rows.columns], status.alias(f"{field}_status"))


def in_spans(points: DataFrame, spans: DataFrame, key: str, at: str, begin: str, end: str, width: int) -> DataFrame:
    """points joined to the spans of their key that hold them; both sides meet by buckets of the position, so no key meets whole."""
    cut = spans.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(begin) / width), F.floor(F.col(end) / width))))
    return points.withColumn("bucket", F.floor(F.col(at) / width)).join(cut, [key, "bucket"]).filter((F.col(at) >= F.col(begin)) & (F.col(at) <= F.col(end))).drop("bucket")


def counted_in_spans(points: DataFrame, spans: DataFrame, key: str, at: str, begin: str, end: str, span: str) -> DataFrame:
    """(span, n): how many points of its key each span (a name of its own, begin to end) holds, if any. The number of points up to its end less those before its
    begin, from one running sum over each key, so points and spans do not meet pair by pair."""
    mark = lambda df, pos, kind, n, name: df.select(key, F.col(pos).cast("long").alias("pos"), F.lit(kind).alias("kind"), n.cast("long").alias("n"), name.alias(span))
    counts = points.groupBy(key, at).agg(F.count("*").alias("n"))
    whole = spans.filter(F.col(begin) <= F.col(end))
    none = F.lit(None).cast(dict(spans.dtypes)[span])
    marks = mark(counts, at, 1, F.col("n"), none).unionByName(mark(whole, begin, 0, F.lit(0), F.col(span))).unionByName(mark(whole, end, 2, F.lit(0), F.col(span)))
    sums = running(marks.filter(F.col("pos").isNotNull() & F.col(key).isNotNull()), [key], ["pos", "kind"], "n", "upto")
    return sums.filter("kind <> 1").groupBy(span).agg(F.sum(F.when(F.col("kind") == 2, F.col("upto")).otherwise(-F.col("upto"))).alias("n")).filter("n > 0")


def islands(rows: DataFrame, key: str, order: str, width: int = 65_536) -> DataFrame:
    """(key, first, last, n): runs of consecutive numbers. Runs are found within ranges of `width` numbers; only those that touch the end of their range, two
    a range at the most, are put together over the whole key."""
    bucket = F.floor(F.col(order) / width)
    run = F.col(order) - F.row_number().over(Window.partitionBy(key, "bucket").orderBy(order))
    local = rows.select(key, order, bucket.alias("bucket")).withColumn("run", run)
    local = local.groupBy(key, "bucket", "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))
    edge = (F.col("first") == F.col("bucket") * width) | (F.col("last") == F.col("bucket") * width + width - 1)
    by = Window.partitionBy(key).orderBy("first")
    open_runs = local.filter(edge).withColumn("new", F.coalesce((F.lag("last").over(by) + 1 != F.col("first")).cast("int"), F.lit(1)))
    open_runs = open_runs.withColumn("group", F.sum("new").over(by)).groupBy(key, "group").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    return local.filter(~edge).select(key, "first", "last", "n").unionByName(open_runs.select(key, "first", "last", "n"))
