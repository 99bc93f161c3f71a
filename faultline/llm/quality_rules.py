"""Operator 10: quality rules as one projection.

A table of thresholds is compiled into boolean columns over a few counts of the text. Everything is built-in
functions: no user function, no shuffle, one pass.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from faultline.llm.common import BLANK, pick, table, text_of, unused

WORD = r"[^\x20\x09-\x0D]+"

# Fixed values of the contract: symbols, window, least words, most repeated words in hundredths.
SYMBOLS, WINDOW, LEAST_WORDS, MOST_REPEATED = "#*$%&|<>", 8, 20, 30

#: Frequent short words of the languages of the corpus.
STOP_WORDS = {
    "en": "the of and to in is that for it as was with be by on are this from at or an a",
    "fr": "le la les de des du et en un une est que qui dans pour sur pas par au avec",
    "de": "der die das und in den von zu mit ist im für auf ein eine nicht des sich dem",
    "es": "el la los de que y en un una es por con para del las no se al lo",
}


@dataclass(frozen=True)
class Rule:
    """A text passes when at_least <= 100 * measure / per <= at_most; whole numbers on both sides."""

    name: str
    measure: str
    per: str
    at_least: int | None = None
    at_most: int | None = None

    def passes(self) -> Column:
        share, whole = F.col(self.measure) * 100, F.col(self.per)
        bounds = [share >= whole * self.at_least] if self.at_least is not None else []
        bounds += [share <= whole * self.at_most] if self.at_most is not None else []
        return reduce(and_, bounds)


#: The threshold table: hundredths of `measure` in `per`.
RULES = (
    Rule("word_length", "word_chars", "n_words", at_least=250, at_most=1200),
    Rule("symbols", "n_symbols", "n_words", at_most=10),
    Rule("stop_words", "n_stop_words", "n_words", at_least=4),
    Rule("repeated_lines", "n_dup_lines", "n_lines", at_most=50),
)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines")


def _let(value: Column, fn) -> Column:
    """`fn(value)` with the value computed once, however often `fn` uses it."""
    return F.transform(F.array(value), fn)[0]


def _at(order: Column, i: Column) -> Column:
    return F.get(order, i)["h"]


def repeated_words(words: Column) -> Column:
    """Words in windows of eight that occur twice or more in the same text, the first one included.

    Windows are compared by a 64-bit hash. Sorting brings equal ones together, so a text of n words costs n log n; a
    text without any repeated window is recognised by the number of distinct hashes and not sorted.
    """

    def of_hashes(hashes: Column) -> Column:
        def of_sorted(order: Column) -> Column:
            def twice(item: Column, i: Column) -> Column:
                return _at(order, i - 1).eqNullSafe(item["h"]) | _at(order, i + 1).eqNullSafe(item["h"])

            return F.filter(order, twice)

        def covered(at: Column) -> Column:
            start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

            def add(acc: Column, p: Column) -> Column:
                fresh = F.lit(WINDOW) - F.greatest(F.lit(0), acc["end"] - p)
                return F.struct((acc["n"] + fresh).alias("n"), (p + WINDOW).alias("end"))

            return F.aggregate(at, start, add, lambda acc: acc["n"])

        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        places = F.sort_array(F.transform(_let(pairs, of_sorted), lambda x: x["p"]))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(covered(places))

    last = F.size(words) - (WINDOW - 1)
    hashes = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(last < 2, F.lit(0).cast("long")).otherwise(_let(hashes, of_hashes))


def measures(text: Column, stop_words: dict[str, str] = STOP_WORDS) -> Column:
    """A struct of the counts of one text."""
    stops = sorted({form for line in stop_words.values() for w in line.split() for form in (w, w.capitalize())})

    def of_words(words: Column, lines: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            repeated_words(words).alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: w.isin(stops))).cast("long").alias("n_stop_words"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        )

    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return _let(F.struct(words.alias("w"), lines.alias("l")), lambda x: of_words(x["w"], x["l"]))


def _judged(df: DataFrame, text: str, rules: tuple[Rule, ...]) -> DataFrame:
    """`df` (columns must not clash) with the counts, one boolean per rule, base_failed and kept."""
    value = F.col(text)
    counted = df.withColumn("_counts", measures(value)).select(
        *[F.col(c) for c in df.columns if c != text],
        "_counts.*",
        F.char_length(F.regexp_replace(value, BLANK, "")).cast("long").alias("word_chars"),
        (F.char_length(value) - F.char_length(F.translate(value, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    passed = {f"passes_{r.name}": r.passes() for r in rules}
    return counted.withColumns({"base_failed": failed, **passed}).withColumn(
        "kept", ~F.col("base_failed") & reduce(and_, map(F.col, passed), F.lit(True))
    )


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row: key, the counts, one boolean per rule, base_failed and kept.

    Null and empty texts have no words and fail. Repeated rows and keys are judged each, a null key stays null, other
    columns are ignored, an empty table gives no rows. A rule whose whole is 0 (no lines, no words) passes.
    """
    return _judged(pick(docs, key, text), "text", rules).withColumnRenamed("key", key)


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of `docs` whose text is kept, with the columns of `docs`, whatever their names."""
    (whole,) = unused(docs, "row")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(whole), text_of(text).alias("_text"))
    return _judged(rows, "_text", rules).filter("kept").select(f"{whole}.*")


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return judge(table(spark, folder, "documents"))


def _sql_rule(rule: Rule) -> str:
    low = [f"100 * {rule.measure} >= {rule.at_least} * {rule.per}"] if rule.at_least is not None else []
    high = [f"100 * {rule.measure} <= {rule.at_most} * {rule.per}"] if rule.at_most is not None else []
    return f"({' AND '.join(low + high)})"


_STOPS = ", ".join(f"'{f}'" for f in sorted({f for x in STOP_WORDS.values() for w in x.split() for f in (w, w.capitalize())}))

SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{WORD}') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM d),
grams AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g
          FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n
            FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
c AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words,
        coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(n, 0)::BIGINT AS n_repeat_words,
        len(list_filter(ws, lambda x: x IN ({_STOPS})))::BIGINT AS n_stop_words,
        len(ls)::BIGINT AS n_lines
      FROM w LEFT JOIN covered USING (doc_id)),
f AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
        {", ".join(f"{_sql_rule(r)} AS passes_{r.name}" for r in RULES)} FROM c)
SELECT *, NOT base_failed AND {" AND ".join(f"passes_{r.name}" for r in RULES)} AS kept FROM f
"""
