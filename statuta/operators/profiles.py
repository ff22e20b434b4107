"""What a chunk can answer, and answers put together from it: intents, keywords, facts and an outline by column expressions; a question's intent names slots, facts of its hits fill them.

A null or empty text has no sentences and so no facts. Marks, words and slots are tables: an institution passes its own."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.functions.text import answer_text

# Words of intents, words that make a term a keyword or no term, forms of facts, their units, and the greatest numbers of each.
INTENTS = {
    "procedure": ("절차", "단계", "심사", "공고", "접수", "선정", "선발", "임용", "채용", "신청", "승인"),
    "eligibility": ("대상", "자격", "요건", "기준", "해당", "제외", "제한"),
    "duration": ("기간", "기한", "이내", "이상", "이하", "초과", "미만", "까지", "년", "개월", "일"),
    "payment": ("지급", "수당", "연봉", "보수", "급여", "금액", "만원", "%", "퍼센트", "일시금"),
    "obligation": ("하여야 한다", "해야 한다", "하여야 하며", "제출", "신고", "통보", "금지"),
    "exception": ("다만", "예외", "불구하고", "제외한다", "아니하다"),
    "definition": ("정의", "뜻은", "이란", "라 함은", "말한다"),
}
TERMS = r"휴직|채용|임용|심사|공고|지급|연봉|보수|수당|기간|자녀|시간선택제|자격|기준|위원회"
NO_TERMS = ("한다", "있는", "없는", "경우", "다음", "각호", "사항", "따라", "대한", "관한")
STEP_WORDS = r"절차|단계|심사|공고|접수|선정|선발|임용|채용"
SHORT_STEP = r"심사|공고|접수|면접|선발|선정|임용|채용"
MARK = r"(?:\d+\.|[가-힣]\.|[①②③④⑤⑥⑦⑧⑨⑩])"
STEP = rf"(?:^|\s){MARK}\s*([^①②③④⑤⑥⑦⑧⑨⑩]+?)(?=\s+{MARK}|$)"
TIME = r"\d+\s*(?:년|개월|월|일|시간|분)"
TIME_VALUE = rf"({TIME}(?:\s*(?:이내|이상|이하|초과|미만|까지))?)"
TIME_WORDS = r"기간|기한|이내|이상|이하|초과|미만|까지|범위"
PAY_WORDS = r"지급|수당|연봉|보수|급여|금액|일시금|성과급|환수|계좌이체|요구불예금|\d+\s*(?:원|만원|%)"
PAY_VALUE = r"(\d+\s*(?:월|원|만원|%|퍼센트)|일시금|매월|계좌이체|요구불예금)"
SENTENCE_FACTS = {"condition": r"대상|자격|요건|기준|경우|해당|제외|제한", "obligation": r"하여야 한다|해야 한다|하여야 하며|제출|신고|통보|금지|할 수 없다", "exception": r"다만|예외|불구하고|제외한다|아니하다"}
SAYS = r"한다|하여야|할 수 있다|할 수 없다|이내|이상|지급|심사|공고|자격"
BREAKS = r"(?<=[.!?。])\s+|(?=제\s*\d+\s*조\s*\()|(?=(?<![\d.])\d+\.\s)|(?=[①②③④⑤⑥⑦⑧⑨⑩])"
MOST_KEYWORDS, MOST_FACTS, MOST_STEPS, MOST_OUTLINE = 24, 20, 12, 5
FACT = "array<struct<type:string,value:string,sentence:string>>"

#: Slots of a question by its intent, the first pattern that matches: facts of a type, in the order in which an answer says them.
SLOTS = {
    "payment": (r"얼마|금액|수당|급여|보수|지급|연봉", ("payment", "condition", "exception")),
    "duration": (r"기간|기한|며칠|언제|몇\s*(?:년|개월|일)", ("duration", "condition", "exception")),
    "procedure": (r"절차|단계|방법|어떻게|신청", ("procedure_step", "obligation", "duration")),
    "eligibility": (r"대상|자격|요건|누가|가능", ("condition", "exception")),
    "exception": (r"예외|제외|다만", ("exception",)),
    "obligation": (r"의무|하여야|해야|제출|신고|금지", ("obligation", "duration")),
    "definition": (r"정의|뜻|이란|무엇", ("definition",)),
}


def sentences(text: Column) -> Column:
    """Distinct cleaned sentences; brackets end one, articles, numbers (whole ones) and circled numbers begin one, dates with blanks stay whole."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\[[^\]]+\]", "\n"), r"\s+", " "))
    flat = F.regexp_replace(flat, r"(\d{4})\.\s+(\d{1,2})\.\s+(\d{1,2})\.", "$1.$2.$3.")
    return F.array_distinct(F.filter(F.transform(F.split(flat, BREAKS), cleaned), lambda s: s != ""))


def cleaned(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(answer_text(value), r"^[-•]\s*", ""), r"^[ ;,]+|[ ;,]+$", "")


def distinct(values: Column, most: int) -> Column:
    return F.slice(F.array_distinct(F.filter(values, lambda v: v != "")), 1, most)


def intents(*texts: Column) -> Column:
    said = F.concat_ws(" ", *texts)
    any_of = lambda words: reduce(lambda a, w: a | said.contains(w), words[1:], said.contains(words[0]))
    return F.array_compact(F.array(*[F.when(any_of(words), F.lit(name)) for name, words in INTENTS.items()]))


def keywords(text: Column, found: Column, *titles: Column) -> Column:
    terms = F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([가-힣A-Za-z0-9·ㆍ%]+)"), 1), lambda t: (F.length(t) >= 2) & ~t.isin(*NO_TERMS) & ~t.rlike(r"^\d+$") & t.rlike(TERMS))
    return distinct(F.transform(F.concat(F.array_compact(F.array(*titles)), found, terms), cleaned), MOST_KEYWORDS)


def values_of(sentence: Column, pattern: str, most: int) -> Column:
    """The values that a pattern finds, joined; the sentence where it finds none."""
    found = distinct(F.transform(F.regexp_extract_all(sentence, F.lit(pattern), 1), lambda v: cleaned(F.replace(v, F.lit(" "), F.lit("")))), most)
    return F.when(F.size(found) > 0, F.array_join(found, ", ")).otherwise(sentence)


def facts_of(sentence: Column) -> Column:
    """Facts of a sentence: steps of a procedure, then one of each other kind."""
    fact = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("value"), sentence.alias("sentence"))
    numbered = F.filter(F.transform(F.regexp_extract_all(sentence, F.lit(STEP), 1), cleaned), lambda s: s != "")
    whole = F.when((F.length(sentence) <= 40) & sentence.rlike(SHORT_STEP) | (sentence.contains("단계") & sentence.contains("심사")), F.array(sentence)).otherwise(F.array().cast("array<string>"))
    steps = F.when(~sentence.rlike(STEP_WORDS), F.array().cast("array<string>")).when(F.size(numbered) > 0, F.slice(numbered, 1, MOST_STEPS)).otherwise(whole)
    others = [
        F.when(sentence.rlike(TIME) & sentence.rlike(TIME_WORDS), fact("duration", values_of(sentence, TIME_VALUE, 8))),
        F.when(sentence.rlike(PAY_WORDS), fact("payment", values_of(sentence, PAY_VALUE, 10))),
        *[F.when(sentence.rlike(p), fact(kind, sentence)) for kind, p in SENTENCE_FACTS.items()],
    ]
    return F.concat(F.transform(steps, lambda s: F.struct(F.lit("procedure_step").alias("type"), s.alias("value"), sentence.alias("sentence"))), F.array_compact(F.array(*others)))


def profiles(chunks: DataFrame, text: str, titles: Sequence[str] = ()) -> DataFrame:
    """chunks with answer_intents, answer_keywords, answer_facts (of the first sentences that have twenty together, each type and value once) and answer_outline (the best five sentences)."""
    t, named = F.col(text), [F.col(c) for c in titles]
    rows = chunks.withColumn("sentences_", sentences(t)).withColumn("by_", F.transform("sentences_", facts_of))
    whole = F.aggregate("by_", F.array().cast(FACT), lambda acc, f: F.when(F.size(acc) >= MOST_FACTS, acc).otherwise(F.concat(acc, f.cast(FACT))))
    rows = rows.withColumn("all_", whole)
    same = lambda a, b: (a["type"] == b["type"]) & (a["value"] == b["value"])
    once = F.filter("all_", lambda f, i: ~F.exists(F.slice("all_", F.lit(1), i), lambda g: same(f, g)) & (f["value"] != ""))
    rows = rows.withColumn("answer_facts", once).withColumn("answer_intents", intents(t, *named))
    score = lambda s: F.when(F.exists("answer_facts", lambda f: f["sentence"] == s), 4).otherwise(0) + F.when(s.rlike(SAYS), 2).otherwise(0) + F.when(s.rlike(r"제\s*\d+\s*조"), 1).otherwise(0)
    scored = F.filter(F.transform("sentences_", lambda s, i: F.struct((-score(s)).alias("s"), i.alias("i"), s.alias("t"))), lambda x: x["s"] < 0)
    best = F.transform(F.slice(F.array_sort(scored), 1, MOST_OUTLINE), lambda x: x["t"])
    rows = rows.withColumn("answer_outline", F.when(F.size(scored) > 0, best).otherwise(F.slice("sentences_", 1, 3)))
    return rows.withColumn("answer_keywords", keywords(t, F.col("answer_intents"), *named)).drop("sentences_", "by_", "all_")


def query_intent(query: Column, slots: Mapping[str, tuple[str, Sequence[str]]] = SLOTS) -> Column:
    """The first intent whose pattern is in the question, else 'general'."""
    return F.coalesce(*[F.when(query.rlike(pattern), F.lit(name)) for name, (pattern, _) in slots.items()], F.lit("general"))


def answers(queries: DataFrame, hits: DataFrame, profiled: DataFrame, slots: Mapping[str, tuple[str, Sequence[str]]] = SLOTS) -> DataFrame:
    """(query_id, intent, filled, missing, evidence): each slot of the question's intent with the first fact of its type by rank of the hit and place in the chunk; slots that no hit fills are
    said; a question of no intent is answered by the first hit's outline. queries: query_id, query. hits: query_id, rank, chunk_id. profiled: chunk_id and the columns of `profiles`.

    One row a question, also without hits. Facts are short and twenty a chunk at most, so what is grouped grows with the hits of a question."""
    asked = queries.select("query_id", query_intent(F.coalesce("query", F.lit("")), slots).alias("intent"))
    wanted = F.create_map(*[x for name, (_, types) in slots.items() for x in (F.lit(name), F.array(*[F.lit(t) for t in types]))], F.lit("general"), F.array().cast("array<string>"))
    asked = asked.withColumn("wanted", wanted[F.col("intent")])
    met = asked.join(hits, "query_id").join(profiled.select("chunk_id", "answer_facts", "answer_outline"), "chunk_id")
    facts = met.select("query_id", "wanted", "rank", "chunk_id", F.posexplode("answer_facts").alias("place", "f")).filter("array_contains(wanted, f.type)")
    first = facts.groupBy("query_id", F.col("f.type").alias("slot"), F.array_position("wanted", F.col("f.type")).alias("turn")).agg(F.min(F.struct("rank", "chunk_id", "place", "f")).alias("b"))
    filled = first.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("turn", "slot", F.col("b.f.value").alias("value"), F.col("b.f.sentence").alias("sentence"), F.col("b.chunk_id").alias("chunk_id")))).alias("filled"))
    general = met.filter("intent = 'general'").groupBy("query_id").agg(F.min_by("answer_outline", F.struct("rank", "chunk_id")).alias("outline"), F.min(F.struct("rank", "chunk_id"))["chunk_id"].alias("best"))
    rows = asked.join(filled, "query_id", "left").join(general, "query_id", "left")
    none = F.array().cast("array<string>")
    said = F.coalesce(F.transform("filled", lambda x: F.concat_ws(": ", x["slot"], x["value"])), F.slice("outline", 1, 3), none)
    missing = F.array_except("wanted", F.coalesce(F.transform("filled", lambda x: x["slot"]), none))
    evidence = F.array_distinct(F.coalesce(F.transform("filled", lambda x: x["chunk_id"].cast("string")), F.array_compact(F.array(F.col("best").cast("string")))))
    return rows.select("query_id", "intent", said.alias("filled"), missing.alias("missing"), evidence.alias("evidence"))
