"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a built-in expression over the whole text, so the rules run inside the
scan stage without a shuffle and without user functions. A row of ``RULES`` reads: keep a
document only if ``least * base <= measure * per <= most * base``.

Null or empty texts have no words, fail the base rule and are dropped. Repeated rows get
equal verdicts, each row its own. No column of the input other than ``text`` is read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_BREAK, spread_table, words

WINDOW = 8

#: Function words of the four languages of the corpus.
STOP_WORDS = (
    "the and of to in a is that for it on as with was at by be this are from or an "
    "der die das und in zu den mit von ist für auf im ein eine nicht als auch sich des dem "
    "le la les de des et en un une du que est pour dans qui par au "
    "el los las y que en un una se con para por del al no es"
)


@dataclass(frozen=True)
class Rule:
    """least * base <= 100 * measure <= most * base, in whole numbers."""

    measure: str
    base: str
    least: int | None
    most: int | None


#: Length, symbol, stop-word and line ratios, in hundredths of the base.
RULES = (
    Rule("word_chars", "n_words", 150, 2500),
    Rule("n_symbols", "n_words", None, 30),
    Rule("n_marks", "n_words", None, 60),
    Rule("n_stop_words", "n_words", 1, None),
    Rule("n_dup_lines", "n_lines", None, 60),
)


def _without(chars: str) -> Column:
    return F.length("__text") - F.length(F.translate("__text", chars, ""))


def measured(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns to carry (all by default) packed in ``__row``, beside the measures of the text."""
    stop = list(dict.fromkeys(STOP_WORDS.split()))
    df = docs.select(F.struct(*(carry or ["*"])).alias("__row"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    df = df.withColumns({"__words": words(F.col("__text")), "__lines": F.filter(F.split("__text", "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0)})
    df = df.select(
        "__row",
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.translate("__text", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        _without("#*$%&|<>").cast("long").alias("n_symbols"),
        _without("!?").cast("long").alias("n_marks"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("__words", lambda w: F.lower(w).isin(stop))).cast("long").alias("n_stop_words"),
        F.transform("__words", lambda w: F.xxhash64(w)).alias("__h"),
    )
    # windows of 8 words as one hash each; the hash chain keeps the word bounds
    df = df.withColumn(
        "__win",
        F.when(F.col("n_words") < WINDOW, F.array().cast("array<bigint>")).otherwise(
            F.transform(
                F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("__h") - WINDOW)),
                lambda i: F.xxhash64(*[F.get("__h", i + k) for k in range(WINDOW)]),
            )
        ),
    )
    # only texts with a repeated window pay for the sort that finds where
    repeated = F.size(F.array_distinct("__win")) < F.size("__win")
    df = df.withColumn(
        "__sorted",
        F.when(repeated, F.sort_array(F.transform("__win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    )
    df = df.withColumn(
        "__starts",
        F.sort_array(
            F.filter(
                F.transform(
                    "__sorted",
                    lambda p, i: F.when(
                        (F.get("__sorted", i - 1)["h"] == p["h"]) | (F.get("__sorted", i + 1)["h"] == p["h"]), p["i"]
                    ),
                ),
                lambda x: x.isNotNull(),
            )
        ),
    )
    covered = F.aggregate(
        F.transform("__starts", lambda s, i: F.least(F.lit(WINDOW), F.coalesce(F.get("__starts", i + 1) - s, F.lit(WINDOW)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    # a filter pushed below this projection would run the array functions once an element;
    # a condition that isn't deterministic, and always holds, keeps filters above it
    covered = F.when(F.monotonically_increasing_id() >= 0, covered)
    names = ["n_words", "word_chars", "n_symbols", "n_marks", "n_lines", "n_dup_lines", "n_stop_words"]
    return df.select("__row", *names, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The threshold table as one boolean expression."""
    ok = F.lit(True)
    for r in rules:
        if r.least is not None:
            ok = ok & (100 * F.col(r.measure) >= r.least * F.col(r.base))
        if r.most is not None:
            ok = ok & (100 * F.col(r.measure) <= r.most * F.col(r.base))
    return ok


def quality_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, carry: list[str] | None = None) -> DataFrame:
    """``__row`` with the input's columns, the measures, base_failed and kept."""
    df = measured(docs, text, carry).withColumn("base_failed", base_failed())
    return df.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The input's rows, all columns as they were, that the rules keep."""
    return quality_rules(docs, text, rules).filter("kept").select("__row.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spread_table(spark, sf_dir, "documents", "doc_id"), carry=["doc_id"]).select(
        F.col("__row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _list(items: list[str]) -> str:
    return "[" + ", ".join("'" + x + "'" for x in items) + "]"


#: The same measures by unnested windows, for DuckDB.
MEASURES_SQL = f"""
  SELECT d.doc_id, d.text,
    list_filter(regexp_split_to_array(coalesce(d.text, ''), '{WORD_BREAK}'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(d.text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM {{docs}} d"""


def sql(docs: str = "documents") -> str:
    """Rows of doc_id, the measures, base_failed and kept."""
    checks = " AND ".join(
        part
        for r in RULES
        for part in (
            [f"100 * {r.measure} >= {r.least} * {r.base}"] * (r.least is not None) + [f"100 * {r.measure} <= {r.most} * {r.base}"] * (r.most is not None)
        )
    )
    return f"""
WITH m AS ({MEASURES_SQL.format(docs=docs)}),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS k
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS i FROM m WHERE len(w) >= {WINDOW})),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
cov AS (
  SELECT doc_id, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id),
s AS (
  SELECT m.doc_id, len(w)::BIGINT AS n_words,
    length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    length(regexp_replace(coalesce(text, ''), '[^!?]', '', 'g'))::BIGINT AS n_marks,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    len(list_filter(w, lambda x: list_contains({_list(list(dict.fromkeys(STOP_WORDS.split())))}, lower(x))))::BIGINT AS n_stop_words,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM m LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND {checks}) AS kept FROM b"""
