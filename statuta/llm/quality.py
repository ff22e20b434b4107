"""Operator 1: quality rules compiled into one Spark projection.

A rule is a row of a threshold table: (name, measure, lowest, highest). All measures are built-in
expressions over one row, so the job is a scan and a projection: no shuffle, no Python on the executors.

The rule on stop words judges only texts of a language whose words are listed: by the lang column where there is one with a value, else by the
bytes of a character, since the listed languages are written in Latin letters.

Defined results: a null or blank text has zero counts, fails the base rule (fewer than 20 words) and is
not kept. Repeated rows and extra columns do not matter; each input row gives one output row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.llm.common import pick, words_of
from statuta.session import table

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 8

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be but by for from has have he her his in is it its not of on or she that the their they this to was were which will with you "
    "als am auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat im ist mit nach nicht sich sie sind und von war wird zu zum zur "
    "au aux avec ce ces dans de des du elle en est et il la le les leur mais ne nous ou par pas plus pour qu que qui sa se ses son sur un une vous "
    "al como con de del el ella en es esta este la las lo los más no o para pero por que se sin su sus un una y"
).split()


#: The languages of STOP_WORDS, and how many bytes a character of a text in Latin letters has at most.
LISTED = ("en", "de", "fr", "es")
LATIN_BYTES = 1.5


@dataclass(frozen=True)
class Rule:
    name: str
    measure: str
    lowest: float | None = None
    highest: float | None = None


#: Production thresholds; a row is rejected by the first measure outside its range.
RULES = (
    Rule("length", "n_words", lowest=20),
    Rule("repetition", "repeat_ratio", highest=0.30),
    Rule("symbols", "symbol_ratio", highest=0.30),
    Rule("stop words", "stop_ratio", lowest=0.08),
    Rule("duplicate lines", "dup_line_ratio", highest=0.60),
    Rule("stutter", "stutter_ratio", highest=0.50),
    Rule("word length", "mean_word_length", lowest=2.0, highest=14.0),
)


def covered(positions: Column, width: int) -> Column:
    """Cells covered by intervals [p, p + width) of sorted positions."""
    gaps = F.aggregate(
        positions,
        F.struct(F.lit(0).alias("n"), F.lit(-(10**9)).alias("end")),
        lambda acc, p: F.struct(
            (acc["n"] + F.least(F.lit(width), p + width - acc["end"])).alias("n"), (p + width).alias("end")
        ),
    )
    return F.coalesce(gaps["n"], F.lit(0))


def measures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Counts of each row. n_repeat_words covers every 8-word window that is found twice or more."""
    base = pick(docs, doc_id=doc_id, text=text, **({"lang": lang} if lang in docs.columns else {}))
    latin = F.octet_length(F.coalesce("text", F.lit(""))) <= LATIN_BYTES * F.length(F.coalesce("text", F.lit("")))
    base = base.withColumn("listed", F.coalesce(F.lower(F.col("lang").cast("string")).isin(*LISTED), latin) if "lang" in base.columns else latin)
    base = base.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("words", words_of(F.col("text")))
    w, n = F.col("words"), F.size("words")
    windows = F.when(
        n > WINDOW,
        F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    base = base.withColumn("windows", windows)
    lines = F.filter(F.split("text", "\n"), lambda line: F.translate(line, BLANKS, "") != "")
    base = base.select(
        "doc_id",
        "listed",
        "words",
        "windows",
        n.cast("long").alias("n_words"),
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        (F.size("windows") > F.size(F.array_distinct("windows"))).alias("has_repeat"),
    )
    # Only a text in which some window repeats sorts its windows to find which ones do.
    ordered = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    base = base.withColumn("ordered", F.when(F.col("has_repeat"), ordered))
    o = F.col("ordered")
    twice = F.filter(
        o,
        lambda x, k: ((k > 0) & (F.get(o, k - 1)["h"] == x["h"])) | (F.coalesce(F.get(o, k + 1)["h"] == x["h"], F.lit(False))),
    )
    positions = F.sort_array(F.transform(twice, lambda x: x["i"]))
    bare = F.transform(w, lambda x: F.lower(F.regexp_replace(x, r"[^\p{L}\p{N}]+", "")))
    base = base.withColumn("bare", bare)
    b = F.col("bare")
    stop = F.array(*[F.lit(x) for x in dict.fromkeys(STOP_WORDS)])
    # inline() keeps a later filter on the counts from being pushed below, where it would compute them again.
    counts = F.struct(
        "listed",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("has_repeat"), covered(positions, WINDOW)).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter(b, lambda x: x.isin(*dict.fromkeys(STOP_WORDS)))).cast("long").alias("n_stop_words"),
        F.size(F.filter(b, lambda x, i: (i > 0) & (x == F.get(b, i - 1)))).cast("long").alias("n_stutters"),
    )
    return base.select("doc_id", F.inline(F.array(counts)))


def ratio(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The name of the first rule that rejects the row, else null."""
    known = {
        "n_words": F.col("n_words"),
        "repeat_ratio": ratio("n_repeat_words", "n_words"),
        "symbol_ratio": ratio("n_symbols", "n_words"),
        "stop_ratio": ratio("n_stop_words", "n_words"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "stutter_ratio": ratio("n_stutters", "n_words"),
        "mean_word_length": ratio("word_chars", "n_words"),
    }
    tests = []
    for rule in rules:
        value = known[rule.measure]
        outside = F.lit(False)
        if rule.lowest is not None:
            outside = outside | (value < rule.lowest)
        if rule.highest is not None:
            outside = outside | (value > rule.highest)
        if rule.measure == "stop_ratio":
            outside = outside & F.col("listed")
        tests.append(F.when(outside, F.lit(rule.name)))
    return F.coalesce(*tests)


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: counts, base_failed, kept, and the rule that rejected it (null if kept)."""
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = measures(docs, doc_id, text, lang).withColumn("base_failed", base_failed).withColumn("rejected_by", verdict(rules))
    return rows.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull()).drop("listed")


def keep_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of docs that the rules keep, unchanged; one scan, whatever the other columns are called."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"), *([F.col(f"`{lang}`").alias("lang")] if lang in docs.columns else []))
    return quality(rows, rules, "row", "text", "lang").filter("kept").select("doc_id.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


STOP_SQL = ", ".join(f"'{x}'" for x in dict.fromkeys(STOP_WORDS))
DOC_WORDS_SQL = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def measures_sql(docs: str, key: str = "doc_id") -> str:
    """DuckDB: the counts of op1 for each row of docs, a table or subquery."""
    return rf"""
numbered AS (SELECT row_number() OVER () AS rn, {key} AS doc_id, coalesce(text, '') AS text FROM {docs}),
worded AS (SELECT rn, doc_id, text, {DOC_WORDS_SQL} AS words,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM numbered),
windows AS (SELECT rn, i, list_slice(words, i, i + 7) AS win FROM (
    SELECT rn, words, unnest(generate_series(1, len(words) - 7)) AS i FROM worded WHERE len(words) >= 9)),
repeated AS (SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, win) AS c FROM windows) WHERE c > 1),
covered AS (SELECT rn, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n FROM (
    SELECT rn, i, lead(i) OVER (PARTITION BY rn ORDER BY i) AS nxt FROM repeated) GROUP BY rn),
bared AS (SELECT rn, list_transform(words, lambda w: lower(regexp_replace(w, '[^\p{{L}}\p{{N}}]+', '', 'g'))) AS bare FROM worded),
counts AS (SELECT w.rn, w.doc_id, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
    len(list_filter(bare, lambda x: x IN ({STOP_SQL})))::BIGINT AS n_stop_words,
    len(list_filter(generate_series(2, len(bare)), lambda i: bare[i] = bare[i - 1]))::BIGINT AS n_stutters
    FROM worded w JOIN bared USING (rn) LEFT JOIN covered c USING (rn)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts),
ruled AS (SELECT *, NOT base_failed AND NOT (
    n_words < 20 OR n_repeat_words / greatest(n_words, 1) > 0.30 OR n_symbols / greatest(n_words, 1) > 0.30
    OR n_stop_words / greatest(n_words, 1) < 0.08 OR n_dup_lines / greatest(n_lines, 1) > 0.60
    OR n_stutters / greatest(n_words, 1) > 0.50
    OR word_chars / greatest(n_words, 1) < 2.0 OR word_chars / greatest(n_words, 1) > 14.0) AS kept FROM judged)"""


OP1_SQL = f"""WITH {measures_sql('documents')}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM ruled"""
