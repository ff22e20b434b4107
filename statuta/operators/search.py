"""Search over approved records: a persisted weighted index, ranking rules, the fallback cascade, catalog to body search and exact lookups.

Records: id, text, and metadata columns (regulation_title, article_no, article_title, hierarchy_path, …; lists are arrays). Visibility is filtered before:
no function here adds a record that was not given.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statuta.functions.korean import token_list
from statuta.functions.text import compact, tokens
from statuta.operators import inverted
from statuta.operators.inverted import Inverted, fingerprint
from statuta.operators.retrieval import B, K1, literal_score
from statuta.operators.store import Store

TOKENIZER = "regex-ko-tokenizer-v1"
BODY_TOKENIZER = "fields-v1"

# Weights of metadata fields in the index.
FIELD_WEIGHTS = {
    "article_no": 8, "regulation_no": 6, "chapter_no": 4, "section_no": 4, "part_no": 4, "paragraph_no": 3, "item_no": 3, "hierarchy_path": 3, "article_refs": 6,
    "internal_regulation_refs": 4, "regulation_article_refs": 4, "appendix_refs": 6, "form_refs": 6, "external_law_refs": 3, "references": 3, "table_citation_label": 6,
    "table_appendix_no": 5, "table_appendix_title": 5, "table_source": 2, "table_geometry_source": 2, "chunk_type": 1, "table_like": 1, "answer_intents": 1,
    "answer_keywords": 1, "answer_facts": 1,
}
TITLES = ("regulation_title", "article_title")


@F.pandas_udf(T.MapType(T.StringType(), T.IntegerType()))
def weighted_terms(texts: pd.Series, values: pd.Series) -> pd.Series:
    """Term frequencies of a text with its fields (value, weight): a field's value adds its weight to each of its terms, once."""

    def one(text: str | None, fields: list) -> dict[str, int]:
        counts = Counter(token_list(text, distinct=False))
        for field in fields if fields is not None else ():
            for term in token_list(field["value"]):
                counts[term] += field["weight"]
        return dict(counts)

    return pd.Series([one(t, v) for t, v in zip(texts, values, strict=True)])


def field_values(records: DataFrame, title_weight: int = 2) -> Column:
    """All weighted (value, weight) of a record. Part, chapter and section numbers are left out where a canonical path tells the place."""
    kinds = dict(records.dtypes)
    canonical = F.col("canonical_hierarchy_path") if "canonical_hierarchy_path" in kinds else F.lit(None).cast("string")
    parts = []
    for name, weight in [*[(t, title_weight) for t in TITLES], *FIELD_WEIGHTS.items()]:
        if name not in kinds:
            continue
        value = F.coalesce(canonical, F.col(name)) if name == "hierarchy_path" else F.col(name)
        many = value if kinds[name].startswith("array") else F.array(value.cast("string"))
        made = F.transform(many, lambda x: F.struct(x.cast("string").alias("value"), F.lit(weight).alias("weight")))  # noqa: B023
        if name in ("part_no", "chapter_no", "section_no"):
            made = F.when(canonical.isNull(), made)
        parts.append(F.coalesce(made, F.array().cast("array<struct<value:string,weight:int>>")))
    return F.filter(F.concat(F.array().cast("array<struct<value:string,weight:int>>"), *parts), lambda x: x["value"].isNotNull())


def weighted_records(key: str = "id", text: str = "text", content_hash: str = "content_hash", group: str | None = None, title_weight: int = 2) -> inverted.Analysis:
    """Records' weighted frequencies, one count a term; group: what an update replaces as one (a document), each record by itself for None."""

    def analyse(records: DataFrame) -> DataFrame:
        made = weighted_terms(F.coalesce(text, F.lit("")), field_values(records, title_weight))
        marks = [F.col(key).alias("key"), F.col(group or key).cast("string").alias("grp"), F.lit(None).cast("string").alias("unit"), F.col(content_hash).alias("hash")]
        rows = records.select(*marks, made.alias("made"))
        length = F.aggregate(F.map_values("made"), F.lit(0), lambda a, x: a + x)
        return rows.select("key", "grp", "unit", "hash", length.alias("len"), F.transform_values("made", lambda _, v: F.array(v)).alias("terms"))

    return analyse


@F.pandas_udf(T.MapType(T.StringType(), T.ArrayType(T.IntegerType())))
def counts_by_field(fields: pd.Series) -> pd.Series:
    """How often each token is in each of a row's lists of tokens."""

    def one(lists: list) -> dict[str, list[int]]:
        out: dict[str, list[int]] = {}
        for k, tokens_ in enumerate(lists):
            for term in tokens_:
                out.setdefault(term, [0] * len(lists))[k] += 1
        return out

    return fields.map(one)


def body_records(key: str = "id", version: str = "version_id", content_hash: str = "content_hash") -> inverted.Analysis:
    """Chunks' tokens counted by field, in the order of BODY_FIELDS; the version is the unit that a search is narrowed to."""

    def analyse(chunks: DataFrame) -> DataFrame:
        lists = F.array(*[tokens(F.col(f)) if f in chunks.columns else F.array().cast("array<string>") for f in BODY_FIELDS])
        marks = [F.col(key).alias("key"), F.col(version).cast("string").alias("grp"), F.col(version).cast("string").alias("unit"), F.col(content_hash).alias("hash")]
        rows = chunks.select(*marks, lists.alias("lists"))
        return rows.select("key", "grp", "unit", "hash", F.size(F.flatten("lists")).alias("len"), counts_by_field("lists").alias("terms"))

    return analyse


def kind_of(tokenizer: str, key: str) -> str:
    return f"{tokenizer}:{key}"


def build_index(records: DataFrame, folder: str, key: str = "id", text: str = "text", content_hash: str = "content_hash", group: str | None = None) -> int:
    """Puts a whole index of records into a folder's next version and returns its number; a build that fails leaves the version before as it is."""
    store = Store(records.sparkSession, folder)
    return inverted.build(store, records, weighted_records(key, text, content_hash, group), kind_of(TOKENIZER, key))["number"]


def update_index(folder: str, changed: DataFrame, groups: DataFrame, whole: DataFrame, group: str, key: str = "id", text: str = "text", content_hash: str = "content_hash", before_print: str | None = None) -> bool:
    """The index with the records `changed` in place of all of `groups` (grp); False if it was built anew from `whole`."""
    analyse = weighted_records(key, text, content_hash, group)
    return inverted.update(Store(whole.sparkSession, folder), changed, groups, analyse, kind_of(TOKENIZER, key), whole, before_print)[1]


def build_catalog(versions: DataFrame, chunks: DataFrame, folder: str, contents: DataFrame | None = None, references: DataFrame | None = None, key: str = "id") -> int:
    """The catalog on disk: versions, contents, references and chunks beside an index of the chunks' fields, all in one version of the folder."""
    tables = {"versions": versions, "chunks": chunks, "contents": contents, "references": references}
    made = inverted.build(Store(chunks.sparkSession, folder), chunks, body_records(key), kind_of(BODY_TOKENIZER, key), {n: t for n, t in tables.items() if t is not None})
    return made["number"]


def current(spark: SparkSession, folder: str) -> int | None:
    """The number of a folder's newest version, if any."""
    numbers = Store(spark, folder).numbers()
    return numbers[-1] if numbers else None


@dataclass(frozen=True)
class Index(Inverted):
    """An index version, opened for ranking."""

    tokenizer = TOKENIZER

    @classmethod
    def open(cls, spark: SparkSession, folder: str, number: int | None = None) -> Index:
        index = super().open(spark, folder, number)
        if index.manifest["kind"].rpartition(":")[0] != cls.tokenizer:
            raise ValueError(f"index of another tokenizer: {index.manifest['kind']}")
        return index

    @property
    def key(self) -> str:
        return self.manifest["kind"].rpartition(":")[2]

    @property
    def fingerprint(self) -> str:
        return self.manifest["fingerprint"]

    def stale_for(self, records: DataFrame, content_hash: str = "content_hash") -> bool:
        """Reads all records; who keeps a record table's fingerprint compares that instead."""
        return self.fingerprint != fingerprint(records, content_hash)

    def none(self) -> DataFrame:
        return self.matches(["-"]).select(F.col("key").alias(self.key), F.lit(0.0).alias("score")).limit(0)

    def score(self, terms: list[str], allowed: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
        """(key, score) of records with a positive score; allowed: the ids that may be found. Repeated query terms count as often as they stand."""
        counts = Counter(unicodedata.normalize("NFC", t.strip().lower()) for t in terms if t and t.strip())
        df = self.frequencies(list(counts)) if counts else {}
        weight = {t: q * math.log(1 + (self.n - df[t] + 0.5) / (df[t] + 0.5)) for t, q in counts.items() if t in df}
        if not weight:
            return self.none()
        rows = self.matches(list(weight)).withColumnRenamed("key", self.key)
        if allowed is not None:
            rows = rows.join(allowed.select(self.key).distinct(), self.key, "left_semi")
        idf = F.create_map(*[F.lit(x) for pair in weight.items() for x in pair])[F.col("term")]
        tf = F.get("tfs", 0)
        part = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / (self.avg_len or 1.0)))
        return rows.groupBy(self.key).agg(F.round(F.sum(part), 8).alias("score")).filter("score > 0")

    def search(self, query: str, allowed: DataFrame | None = None) -> DataFrame:
        return self.score(token_list(query, distinct=False), allowed)

    def cold_terms(self, query: str) -> list[str]:
        """The query's terms and parts of its words that the index knows, so compounds are found that the tokenizer does not split."""
        folded = unicodedata.normalize("NFC", query).lower()
        terms = token_list(folded, distinct=False)
        words = [w for w in re.findall(r"[0-9a-z가-힣]+", folded)[:64] if 3 <= len(w) <= 64]
        pieces = {w[i:j] for w in words for i in range(len(w)) for j in range(i + 2, min(len(w), i + 32) + 1)}
        known = set(self.frequencies(sorted(pieces))) if pieces else set()  # bounded by the query
        extra = [s for w in words for s in segments(w, known)]
        return terms + [s for s in dict.fromkeys(extra) if s not in set(terms)]


@dataclass(frozen=True)
class BodyIndex(Index):
    """The catalog's index of chunks by field."""

    tokenizer = BODY_TOKENIZER

    def body_scores(self, query: str, within: DataFrame, version: str = "version_id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(key, retrieval_score) of the chunks of the versions in `within`, as `body_scores` has them, from the buckets of the query's terms alone."""
        terms = query_terms(query)
        prefixes = [t for t in terms if ARTICLE_TERM.match(t)]
        exact = [t for t in terms if t not in prefixes]
        if not terms:
            return self.none().withColumnRenamed("score", "retrieval_score")
        weights = F.array(*[F.lit(w) for w in BODY_FIELDS.values()])
        weighted = F.aggregate(F.zip_with("tfs", weights, lambda n, w: n * w), F.lit(0.0), lambda a, x: a + x)
        hits = self.matches(exact, prefixes).groupBy("key", "unit", "len", "term").agg(F.sum(weighted).alias("tf"))
        df = self.frequencies(exact) if exact else {}
        if prefixes:
            df |= {r["term"]: r["n"] for r in hits.filter(F.col("term").isin(prefixes)).groupBy("term").agg(F.count("*").alias("n")).collect()}  # at most a row a term
        if not df:
            return self.none().withColumnRenamed("score", "retrieval_score")
        idf = F.create_map(*[F.lit(x) for t, n in df.items() for x in (t, max(1e-6, math.log((self.n - n + 0.5) / (n + 0.5))))])[F.col("term")]
        mean = self.manifest["length"] / max(1, self.n)
        part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / (mean or 1.0)))
        rows = hits.join(within.select(F.col(version).cast("string").alias("unit")).distinct(), "unit", "left_semi")
        return rows.groupBy(F.col("key").alias(self.key)).agg((1 - 1 / (1 + F.sum(part))).alias("retrieval_score"))


def segments(word: str, known: set[str]) -> tuple[str, ...]:
    """The known parts (two characters or more, with a letter, not the whole word) that cover the most of a word; of equal covers the one that begins
    first, then the one with the most parts, then the one whose first parts are longest.

    A chain of parts is as good as its beginning lets it be, so the best chain up to every place is kept and each part extends the one before it."""
    spans = [(i, j) for i in range(len(word)) for j in range(i + 2, min(len(word), i + 32) + 1)]
    spans = [(i, j) for i, j in spans if j - i < len(word) and word[i:j] in known and not word[i:j].isdigit() and any(map(str.isalpha, word[i:j]))]
    rank = lambda chain: (sum(j - i for i, j in chain), -chain[0][0] if chain else 0, len(chain), [j - i for i, j in chain])
    upto: list[tuple[tuple[int, int], ...]] = [()]
    for place in range(1, len(word) + 1):
        ending = [(*upto[i], (i, j)) for i, j in spans if j == place]
        upto.append(max([upto[-1], *ending], key=rank))
    return tuple(word[i:j] for i, j in upto[-1])


# How queries name regulations, places and attachments; fields that hold them; points of the structured boost and its cap.
NAMED = re.compile(r"(?<![0-9A-Za-z가-힣])[0-9A-Za-z가-힣]{2,}(?:규정|규칙|세칙|지침|요령|내규)")
ATTACHMENT_NO = r"(?:별표|별지)\s*(?:제\s*)?\d+(?:\s*[-의]\s*\d+)*(?:\s*호)?(?:\s*서식)?"
LOCATOR = re.compile(ATTACHMENT_NO + r"|제\s*\d+(?:\s*의\s*\d+)?\s*(?:편|장|절|조|항|호|목)")
MARKER = re.compile(r"(?<![0-9A-Za-z가-힣])(별표|별지|서식)(?:에서는|으로는|에는|으로|에서|은|는|이|가|을|를|의|와|과|에|로|도|만)?(?![0-9A-Za-z가-힣])")
DIRECT_PLACES = ("article_no", "chapter_no", "section_no", "part_no", "paragraph_no", "item_no", "table_appendix_no")
REFERENCE_PLACES = ("appendix_refs", "form_refs")
DIRECT_TITLES = ("article_title", "direct_article_title", "table_appendix_title")
ATTACHMENTS = ("별표", "별지", "서식")
MOST_BOOST = 64.0


def flat_key(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[^0-9A-Za-z가-힣]+", ""))


def flat(text: str) -> str:
    return re.sub("[^0-9A-Za-z가-힣]+", "", unicodedata.normalize("NFC", text)).lower()


def named_titles(records: DataFrame, query: str, title: str = "regulation_title") -> list[str]:
    """Keys of titles that the query names: at the beginning of a word, and not only inside a longer title that it names too."""
    if title not in records.columns:
        return []
    bare, low = flat(query), unicodedata.normalize("NFC", query).lower()
    key = flat_key(F.col(title))
    rows = records.select(key.alias("k")).filter((F.length("k") >= 4) & F.lit(bare).contains(F.col("k"))).distinct()
    spans = {}
    for r in rows.toLocalIterator():  # parts of one query: bounded by its length
        pattern = "[^0-9A-Za-z가-힣]*".join(map(re.escape, r["k"]))
        found = [m.span() for m in re.finditer(f"(?<![0-9A-Za-z가-힣]){pattern}", low)]
        if found:
            spans[r["k"]] = found
    inside = lambda own, others: all(any(a <= x and y <= b for a, b in others) for x, y in own)
    return sorted(t for t, own in spans.items() if not any(t != o and t in o and inside(own, others) for o, others in spans.items()))


def place_named(query: str, places: Column) -> Column:
    """Some of an array of places stands in the query and is not the beginning of a longer number there."""
    q = F.lit(flat(query))

    def one(place: Column) -> Column:
        k = flat_key(place)
        after = F.substring(q, F.instr(q, k) + F.length(k), F.lit(len(flat(query))))
        longer = after.rlike("^(?:[0-9]|[의-][0-9])")
        dated = after.rlike(r"^(?:19|20)\d{6}") & k.rlike("별표|별지|서식")
        return (F.length(k) >= 3) & k.rlike("[0-9]") & (F.instr(q, k) > 0) & (~longer | dated)

    return F.coalesce(F.exists(places, one), F.lit(False))


def structured_boost(records: DataFrame, query: str) -> Column:
    """Points for a record whose regulation, place, title or attachment the query names, MOST_BOOST at the most."""
    kinds, bare = dict(records.dtypes), flat(query)
    none = F.array().cast("array<string>")

    def values(names: tuple[str, ...]) -> Column:
        parts = [F.coalesce(F.col(n), none) if kinds[n].startswith("array") else F.array_compact(F.array(F.col(n).cast("string"))) for n in names if n in kinds]
        return F.concat(none, *parts)

    titles = named_titles(records, query)
    places = LOCATOR.search(query) is not None
    if not titles and not places:
        return F.lit(0.0)
    markers = sorted(set(MARKER.findall(re.sub(ATTACHMENT_NO, " ", query))))
    asks = any(a in bare for a in ATTACHMENTS)
    key = flat_key(F.col("regulation_title")) if "regulation_title" in kinds else F.lit("")
    titled = key.isin(titles) if titles else F.lit(False)
    direct = place_named(query, values(DIRECT_PLACES)) if places else F.lit(False)
    refers = place_named(query, values(REFERENCE_PLACES)) if places else F.lit(False)
    named = F.coalesce(F.exists(values(DIRECT_TITLES), lambda x: (F.length(flat_key(x)) >= 3) & F.lit(bare).contains(flat_key(x))), F.lit(False))
    kind = F.lower(F.coalesce("chunk_type", F.lit(""))) if "chunk_type" in kinds else F.lit("")
    held = values(("table_appendix_no", *REFERENCE_PLACES))
    attached = kind.isin("appendix", "form") | ((kind == "table") & (F.size(held) > 0))
    own = F.concat(F.when(kind == "appendix", F.array(F.lit("별표"))).when(kind == "form", F.array(F.lit("별지"), F.lit("서식"))).otherwise(none), F.flatten(F.transform(held, lambda x: F.filter(F.array(*[F.lit(a) for a in ATTACHMENTS]), lambda a: flat_key(x).contains(a)))))
    unnumbered = titled & attached & (F.arrays_overlap(own, F.array(*[F.lit(m) for m in markers])) if markers else F.lit(False))
    points = lambda test, n: F.when(F.coalesce(test, F.lit(False)), n).otherwise(0.0)
    total = (
        points(titled, F.least(F.lit(18.0), 6.0 + F.length(key)))
        + points(named, F.when(direct, 14.0).otherwise(8.0))
        + points(direct, F.when(F.lit(asks) & ~attached, 2.0).otherwise(16.0))
        + points(refers, F.when(F.lit(asks) & attached, 22.0).otherwise(8.0))
        + points(F.lit(asks) & attached & refers, F.lit(8.0))
        + points(unnumbered, F.lit(22.0))
        + points(titled & (direct | refers | named), F.lit(8.0))
        + points(unnumbered, F.lit(8.0))
    )
    return F.least(total, F.lit(MOST_BOOST))


@dataclass(frozen=True)
class DomainRule:
    """What a query must hold (all of, one of each group), what a record must hold (all, one of), and the points then; or what the query is expanded by."""

    query: tuple[str, ...]
    query_any: tuple[str, ...] = ()
    record: tuple[str, ...] = ()
    record_any: tuple[str, ...] = ()
    points: float = 0.0
    expansion: str = ""

    def asked(self, query: str) -> bool:
        bare = query.replace(" ", "")
        return all(q in bare for q in self.query) and (not self.query_any or any(q in bare for q in self.query_any))


# Points of domain rules (leave, pay, hiring, attachments) and what they add to a query. Institutions give their own tables.
EXCLUDED = ("제외", "제한", "지급대상", "대상제외", "못받", "미지급", "지급하지", "중징계", "징계")
DOMAIN_RULES = (
    DomainRule(("육아휴직",), (), ("제29조",), ("만 8세", "초등학교 2학년", "자녀를 양육"), 18.0),
    DomainRule(("육아휴직",), (), ("제30조",), ("자녀 1명", "3년 이내", "휴직 기간"), 18.0),
    DomainRule(("육아휴직",), (), ("제33조",), ("육아휴직수당", "기본연봉월액"), 18.0),
    DomainRule(("육아휴직",), (), ("육아휴직수당",), ("78퍼센트", "62.4퍼센트"), 12.0),
    DomainRule(("성과연봉",), EXCLUDED, ("제27조의2", "성과연봉 지급대상 제외"), (), 34.0),
    DomainRule(("성과연봉",), EXCLUDED, (), ("중징계", "성폭력", "성매매", "성희롱", "음주운전", "음주측정"), 10.0),
    DomainRule(("성과연봉",), EXCLUDED, ("제24조",), ("연봉의 지급 방법", "6월", "12월", "일시금"), -14.0),
    DomainRule(("교원인사위원회", "심의"), (), ("제8조", "위원회 기능", "교원 인사위원회"), (), 24.0),
    DomainRule(("교원인사위원회", "심의"), (), (), ("교원업적평가 규정", "별지제3호서식"), -8.0),
    DomainRule(("전임", "교원"), ("채용", "임용", "절차"), ("교원 임용 세칙",), ("신규임용 후보자 심사", "지원 마감일", "공개발표심사"), 22.0),
    DomainRule(("전임", "교원"), ("채용", "임용", "절차"), ("제38조", "전임 교원", "교수, 부교수, 조교수"), (), 42.0),
    DomainRule(("성과연봉",), ("언제", "시기", "방법"), expansion="제24조 성과연봉 지급 방법 지급시기 6월 12월 일시금 이등분"),
    DomainRule(("교원인사위원회", "심의"), expansion="인사규정 제8조 위원회 기능 교원 인사위원회 교원의 신규 채용 재계약 승진 정년보장 강임 면직 징계 심의"),
)


def domain_boost(records: DataFrame, query: str, rules: tuple[DomainRule, ...] = DOMAIN_RULES) -> Column:
    """Sum of the points of all rules that the query asks for and the record meets."""
    names = [n for n in ("text", "regulation_title", "article_no", "article_title", "hierarchy_path") if n in records.columns]
    blob = F.concat_ws(" ", *names)
    total = F.lit(0.0)
    for rule in rules:
        if rule.points and rule.asked(query):
            test = F.lit(True)
            for word in rule.record:
                test = test & blob.contains(word)
            if rule.record_any:
                some = F.lit(False)
                for word in rule.record_any:
                    some = some | blob.contains(word)
                test = test & some
            total = total + F.when(test, rule.points).otherwise(0.0)
    return total


def expanded(query: str, rules: tuple[DomainRule, ...] = DOMAIN_RULES) -> str:
    return " ".join([query.strip(), *[r.expansion for r in rules if r.expansion and r.asked(query)]])


def boosted(scored: DataFrame, query: str, rules: tuple[DomainRule, ...] = DOMAIN_RULES) -> DataFrame:
    """scored (records with score) with structured and domain points added."""
    return scored.withColumn("score", F.round(F.col("score") + structured_boost(scored, query) + domain_boost(scored, query, rules), 8))


def reranked(scored: DataFrame, index: Index, query: str, rules: tuple[DomainRule, ...] = DOMAIN_RULES) -> DataFrame:
    """Candidates (with score) ranked anew: their score, BM25 over known parts of the query within the candidates, and the boosts."""
    found = index.score(index.cold_terms(query), scored).withColumnRenamed("score", "bm25")
    rows = scored.join(found, index.key, "left").withColumn("score", F.col("score") + F.coalesce("bm25", F.lit(0.0))).drop("bm25")
    return boosted(rows, query, rules)


def promoted(scored: DataFrame, records: DataFrame, query: str, key: str = "id", order: str = "order_index", points: float = 24.0) -> DataFrame:
    """A query for kinds ('종류') also wants the definitions of what the three best records list: the first record of each listed term gains points."""
    if "종류" not in query.replace(" ", ""):
        return scored
    best = scored.orderBy(F.desc("score"), key).limit(3).select("text").collect()
    drop = re.compile("(?:으로|로|에게|에서|까지|부터|만|도|은|는|을|를|의|과|와|이라|이다)$")
    small = {"교직원", "휴가", "휴가는", "종류", "구분", "구분한다", "및", "그리고", "등", "하는", "한다", "위해", "사용", "제", "조", "항"}
    words = [w for r in best for w in re.findall("[A-Za-z0-9가-힣]+", r["text"] or "")]
    terms = [t for t in dict.fromkeys(drop.sub("", w) if len(w) > 2 and len(drop.sub("", w)) > 1 else w for w in words) if len(t) > 1 and t not in small]
    if not terms:
        return scored
    names = F.array(*[F.lit(t) for t in terms])
    holds = F.filter(names, lambda t: F.coalesce(F.col("article_title"), F.lit("")).contains(t) | F.substring("text", 1, 200).contains(t))
    defining = records.select(key, F.explode(holds).alias("term"), order).groupBy("term").agg(F.min_by(key, order).alias(key))
    gains = defining.groupBy(key).agg((F.count("*") * points).alias("gain"))
    both = records.join(gains, key, "left").join(scored.select(key, "score"), key, "left").filter("gain is not null or score is not null")
    return both.withColumn("score", F.coalesce("score", F.lit(0.0)) + F.coalesce("gain", F.lit(0.0))).drop("gain")


def cascade(records: DataFrame, query: str, index: Index | None, k: int, key: str = "id", content_hash: str = "content_hash", record_print: str | None = None) -> DataFrame:
    """The k best records with score and model: BM25 over the index; literal matches where it finds none; without an index, or with one of other content, literal
    matches, else counts of words. record_print: the fingerprint of the record table, where it is known; else all records are read for it."""
    fresh = index is not None and index.fingerprint == (record_print or fingerprint(records, content_hash))
    if fresh:
        found = index.search(expanded(query), records)
        if not found.isEmpty():
            rows = boosted(records.join(found, key), query).withColumn("model", F.lit("bm25"))
            return rows.orderBy(F.desc("score"), key).limit(k)
    blob = F.concat_ws(" ", *[c for c in ("text", "regulation_title", "article_title", "article_no", "document_name") if c in records.columns])
    literal = records.withColumn("score", literal_score(blob, query).cast("double")).filter("score > 0")
    if not literal.isEmpty():
        return literal.withColumn("model", F.lit("literal")).orderBy(F.desc("score"), key).limit(k)
    words = list(dict.fromkeys(token_list(query)))
    toks = tokens(blob)
    score = sum((F.least(F.size(F.filter(toks, lambda x, w=w: x == w)), F.lit(5)) for w in words), F.lit(0))
    return records.withColumn("score", score.cast("double")).filter("score > 0").withColumn("model", F.lit("lexical")).orderBy(F.desc("score"), key).limit(k)


def query_terms(query: str, most: int = 16) -> list[str]:
    """Terms of a catalog query: folded words of two letters or more, each once."""
    folded = unicodedata.normalize("NFKC", query).casefold()
    return list(dict.fromkeys(w for w in re.findall(r"[0-9a-z가-힣]+", folded) if len(w) >= 2))[:most]


def ranked_versions(versions: DataFrame, query: str) -> DataFrame:
    """versions with catalog_score: 100 where title and query hold one another, 80 for the number, and 24, 18 or 4 a term in title, number or search text."""
    bare = re.sub(r"\s+", "", unicodedata.normalize("NFKC", query).casefold())
    key = lambda c: F.lower(compact(F.coalesce(F.col(c), F.lit(""))))
    title, number, text = key("title"), key("regulation_no"), key("search_text")
    score = F.when((title != "") & (F.lit(bare).contains(title) | title.contains(bare)), 100.0).otherwise(0.0) + F.when((number != "") & F.lit(bare).contains(number), 80.0).otherwise(0.0)
    for term in query_terms(query):
        score = score + F.when(title.contains(term), 24.0).when(number.contains(term), 18.0).when(text.contains(term), 4.0).otherwise(0.0)
    return versions.withColumn("catalog_score", score)


# Weights of article title, path, article number and body in the body search.
BODY_FIELDS = {"article_title": 8.0, "hierarchy_path": 4.0, "article_no": 6.0, "text": 1.0}
ARTICLE_TERM = re.compile(r"^제[1-9]\d*조(?:의[1-9]\d*)?$")


def body_scores(chunks: DataFrame, query: str, within: DataFrame, version: str = "version_id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """chunks of the versions in `within` with retrieval_score: weighted BM25 over all fields as 1 - 1 / (1 + s), an article number matching what begins with it; where no
    chunk matches a term as a token, points for each field that holds it. Statistics cover all chunks and come in one row."""
    terms = query_terms(query)
    fields = {f: tokens(F.col(f)) for f in BODY_FIELDS if f in chunks.columns}
    rows = chunks.select("*", *[t.alias(f"_{f}") for f, t in fields.items()])
    hit = lambda f, t: F.size(F.filter(F.col(f"_{f}"), lambda x: x.startswith(t) if ARTICLE_TERM.match(t) else x == t))
    size = sum((F.size(f"_{f}") for f in fields), F.lit(0))
    counted = rows.select("*", size.alias("_n"), *[sum((BODY_FIELDS[f] * hit(f, t) for f in fields), F.lit(0.0)).alias(f"_t{i}") for i, t in enumerate(terms)])
    stats = counted.agg(F.count("*").alias("_docs"), F.avg("_n").alias("_avg"), *[F.count_if(F.col(f"_t{i}") > 0).alias(f"_d{i}") for i in range(len(terms))])
    both = counted.join(within.select(version).distinct(), version, "left_semi").crossJoin(F.broadcast(stats))  # one row
    s = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.greatest(F.lit(1e-6), F.log((F.col("_docs") - F.col(f"_d{i}") + 0.5) / (F.col(f"_d{i}") + 0.5)))
        s = s + idf * F.col(f"_t{i}") * (k1 + 1) / (F.col(f"_t{i}") + k1 * (1 - b + b * F.col("_n") / F.col("_avg")))
    hits = sum((F.col(f"_t{i}") for i in range(len(terms))), F.lit(0.0))
    found = both.filter(hits > 0).select(*chunks.columns, (1 - 1 / (1 + s)).alias("retrieval_score"))
    if terms and not found.isEmpty():
        return found
    points = F.lit(0.0)
    for t in (terms or [query.strip()])[:8]:
        for f, p in (("article_title", 8.0), ("hierarchy_path", 4.0), ("text", 1.0)):
            points = points + F.when(F.lower(F.coalesce(f, F.lit(""))).contains(t.lower()), p).otherwise(0.0)
    return chunks.join(within.select(version).distinct(), version, "left_semi").withColumn("retrieval_score", points).filter("retrieval_score > 0")


def catalog_search(versions: DataFrame, chunks: DataFrame, query: str, k: int, index: Index | None = None, body: BodyIndex | None = None) -> DataFrame:
    """The k best chunks by way of the catalog: versions by their catalog score (the first max(5, min(16, 3k)) with points, all if none has), their bodies, both
    scores together, the reranking where there is an index; order: score, revision date, path, all descending.

    versions: version_id, title, regulation_no, search_text, revision_date, already as of a day and visible; chunks: version_id, id and BODY_FIELDS; body: their index
    (without it, or where no chunk has a term as a token, the chunks themselves are read)."""
    ranked = ranked_versions(versions, query)
    best = ranked.filter("catalog_score > 0").orderBy(F.desc("catalog_score"), F.desc("revision_date"), F.desc("title"), "version_id").limit(max(5, min(16, 3 * k)))
    chosen = ranked if best.isEmpty() else best
    most = max(6 * k, 24)
    found = body.body_scores(query, chosen).orderBy(F.desc("retrieval_score"), "id").limit(most) if body is not None else None
    if found is not None and not found.isEmpty():
        rows = chunks.join(F.broadcast(found), "id")  # at most `most` rows
    else:
        rows = body_scores(chunks, query, chosen).orderBy(F.desc("retrieval_score"), "id").limit(most)
    rows = rows.join(F.broadcast(chosen.select("version_id", "catalog_score", "revision_date")) if chosen is best else chosen.select("version_id", "catalog_score", "revision_date"), "version_id")
    rows = rows.withColumn("score", F.round(F.col("retrieval_score") + F.least("catalog_score", F.lit(100.0)) / 100, 8))
    if index is not None:
        rows = reranked(rows, index, query)
    return rows.orderBy(F.desc("score"), F.desc("revision_date"), F.desc("hierarchy_path"), "id").limit(k)


def lookup(records: DataFrame, versions: DataFrame, query: str, k: int, title: str | None = None, article: str | None = None, index: Index | None = None) -> DataFrame:
    """Exact place first: records of the named regulation (title or number) and article; only if there are none, the catalog search."""
    if title or article:
        hit = F.lit(True)
        if title:
            hit = hit & ((flat_key(F.col("regulation_title")) == flat(title)) | (flat_key(F.col("regulation_no")) == flat(title)))
        if article:
            hit = hit & (flat_key(F.col("article_no")) == flat(article))
        found = records.filter(hit)
        if not found.isEmpty():
            return found.withColumn("score", F.lit(1.0)).orderBy("order_index", "id").limit(k)
    out = catalog_search(versions, records, query, k, index)
    return out.select(*records.columns, "score")


def evaluator_scores(records: DataFrame, query: str) -> Column:
    """An offline check of ranking: a term counts in the body (up to 5), in titles (1.4, up to 3) and in other fields (.25, up to 2), by its share; records with
    references and tables gain, damaged text loses."""
    count = lambda text, t: (F.length(text) - F.length(F.replace(text, F.lit(t), F.lit("")))) / len(t)
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))) if c in records.columns else F.lit("")
    score = F.lit(0.0)
    for t in query_terms(query):
        score = score + F.least(F.lit(5.0), count(low("text"), t)) + 1.4 * F.least(F.lit(3.0), count(F.concat_ws(" ", low("regulation_title"), low("article_title")), t)) + 0.25 * F.least(F.lit(2.0), count(low("hierarchy_path"), t))
    edges = F.when(F.coalesce("n_edges", F.lit(0)) > 0, 0.35).otherwise(0.0) if "n_edges" in records.columns else F.lit(0.0)
    tables = F.when(F.coalesce("table_like", F.lit(False)), 0.15).otherwise(0.0) if "table_like" in records.columns else F.lit(0.0)
    return F.when(score > 0, (score + edges + tables) * F.when(low("text").contains("�"), 0.35).otherwise(1.0)).otherwise(0.0)


def governing_articles(hits: DataFrame, articles: DataFrame, label: str, refs: str, scope: list[str]) -> DataFrame:
    """Attachment hits with the article that governs each: of the same regulation, listing the attachment; the first in order."""
    listed = articles.select(*scope, "order_index", F.col("id").alias("article_id"), F.explode(refs).alias("ref")).withColumn("k", flat_key(F.col("ref")))
    first = listed.groupBy(*scope, "k").agg(F.min_by("article_id", F.struct("order_index", "article_id")).alias("governing_article"))
    return hits.withColumn("k", flat_key(F.col(label))).join(first, [*scope, "k"], "left").drop("k")


def tables_named(chunks: DataFrame, inventory: DataFrame, document: str, name: str) -> DataFrame:
    """(id, label, rows, source) of a document's tables whose label, alias or number is `name`, from chunks, then from a sidecar inventory; equal rows once."""
    want = flat(name)
    own = chunks.filter(F.col("document_id") == document).withColumn("names", F.transform(F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>"))), flat_key))
    own = own.filter(F.array_contains("names", want)).select("id", "label", "rows", F.lit("chunk").alias("source"), F.lit(0).alias("place"))
    side = inventory.filter((F.col("document_id") == document) & (flat_key(F.col("label")) == want)).select("id", "label", "rows", F.lit("inventory").alias("source"), F.lit(1).alias("place"))
    print_of = F.sha2(F.to_json("rows"), 256)
    return own.unionByName(side).groupBy(print_of.alias("print")).agg(F.min_by(F.struct("id", "label", "rows", "source"), F.struct("place", "id")).alias("t")).select("t.*")


def answer_comparison(metrics: DataFrame, query_id: str, left: str, right: str, names: list[str]) -> DataFrame:
    """(metric, better_left, better_right, equal, mean_delta) over queries measured under both modes; metrics: query_id, mode and a column each."""
    long = metrics.unpivot([query_id, "mode"], names, "metric", "value")
    pairs = long.groupBy(query_id, "metric").pivot("mode", [left, right]).agg(F.first("value")).filter(F.col(left).isNotNull() & F.col(right).isNotNull())
    d = F.col(left) - F.col(right)
    return pairs.groupBy("metric").agg(F.count_if(d > 0).alias("better_left"), F.count_if(d < 0).alias("better_right"), F.count_if(d == 0).alias("equal"), F.round(F.avg(d), 6).alias("mean_delta"))
