"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is one SQL expression over a text.  The cascade is a CASE whose branches Spark evaluates
lazily, so a text that an early rule rejects never pays for the later ones.  ``order_rules``
measures each rule's seconds and its share of rejections on a sample and puts the rule with most
rejections per second first.  The order changes the cost alone: a text is kept if no rule rejects
it, so the verdict does not depend on it.

Null and empty texts have no words and fail the ``few_words`` rule.  Columns of the input that bear
the name of a result column are replaced; the others pass through ``apply_rules``.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.llm.common import table, written

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: a one-element array stands in for a binding."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def n_words(words: Column) -> Column:
    return F.size(words).cast("long")


def word_chars(words: Column) -> Column:
    """Code points in words."""
    return F.length(F.array_join(words, "")).cast("long")


def n_matches(text: Column, one_character: str) -> Column:
    """How many characters match: one less than the pieces between them."""
    return (F.size(F.split(F.coalesce(text, F.lit("")), one_character, -1)) - 1).cast("long")


def lines(text: Column) -> Column:
    """The lines with a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def n_dup_lines(text: Column) -> Column:
    return let(lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _covered(hashes: Column) -> Column:
    """Words under repeated windows, from the hash of each window in order of position."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    starts = let(
        pairs,
        lambda p: F.sort_array(
            F.transform(
                F.filter(
                    F.transform(
                        p,
                        lambda x, k: F.struct(
                            x["i"].alias("i"),
                            (F.coalesce(F.get(p, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False))).alias("twice"),
                        ),
                    ),
                    lambda x: x["twice"],
                ),
                lambda x: x["i"],
            )
        ),
    )
    steps = let(starts, lambda s: F.transform(s, lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get(s, k + 1) - at, F.lit(WINDOW)))))
    return F.aggregate(steps, F.lit(0), lambda a, b: a + b)


def n_repeat_words(words: Column) -> Column:
    """Words in windows of five words that the text holds twice or more, the first included."""
    # hashes are compared within one text only; Spark's distinct of a long array is linear
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(
        hashed,
        lambda w: F.when(
            F.size(w) > WINDOW,
            F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])),
        ),
    )
    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h)).otherwise(0)).cast("long")


#: Each takes a text and its words.
METRICS = {
    "n_words": lambda t, w: n_words(w),
    "word_chars": lambda t, w: word_chars(w),
    "n_symbols": lambda t, w: n_matches(t, SYMBOLS),
    "n_dup_lines": lambda t, w: n_dup_lines(t),
    "n_repeat_words": lambda t, w: n_repeat_words(w),
    "n_lines": lambda t, w: F.size(lines(t)).cast("long"),
    "n_exclaims": lambda t, w: n_matches(t, "!"),
}


@dataclass(frozen=True)
class Rule:
    """``rejects`` takes a function from a metric's name to its column."""

    name: str
    rejects: object


BASE_RULES = [
    Rule("few_words", lambda m: m("n_words") < 10),
    Rule("repetition", lambda m: 100 * m("n_repeat_words") > 20 * m("n_words")),
]
MORE_RULES = [
    Rule("symbols", lambda m: 10 * m("n_symbols") > m("n_words")),
    Rule("exclaims", lambda m: 10 * m("n_exclaims") > 3 * m("n_words")),
    Rule("word_length", lambda m: (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 15 * m("n_words"))),
    Rule("dup_lines", lambda m: 10 * m("n_dup_lines") > 3 * m("n_lines")),
]
RULES = [*BASE_RULES, *MORE_RULES]


#: Metrics that the query returns and so has for every text.
RETURNED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def lazy(ready: Sequence[str] = (), text: str = "text"):
    """From a metric's name to its column: one that is ready, or the expression over the text."""
    return lambda name: F.col(name) if name in ready else METRICS[name](F.col(text), words(F.col(text)))


def order_rules(docs: DataFrame, rules: list[Rule] = RULES, text: str = "text", sample_rows: int = 1000, seed: int = 7, ready: Sequence[str] = ()) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected) by rejections per second on a sample of about ``sample_rows``.

    Metrics in ``ready`` cost nothing, as the caller has them anyway.  The time of a job that reads the
    sample alone is taken off; every job runs once before it is timed.  The sample sets the order of
    evaluation alone, never a verdict.
    """
    total = docs.count()
    sample = docs.select(F.col(text).alias("text")).sample(min(1.0, sample_rows / max(total, 1)), seed).coalesce(1)
    sample = written(sample.select("text", *[lazy()(name).alias(name) for name in ready]), "rule-sample")

    def timed(hit: Column) -> tuple[float, int]:
        job = sample.agg(F.count_if(F.coalesce(hit, F.lit(False))).alias("hits"), F.max(F.length("text")))
        job.first()
        began = time.perf_counter()
        hits = job.first()["hits"]
        return time.perf_counter() - began, hits

    rows = max(sample.count(), 1)
    reading, _ = timed(F.lit(False))
    measured = []
    for rule in rules:
        seconds, hits = timed(rule.rejects(lazy(ready)))
        measured.append((rule, max(seconds - reading, 1e-4), hits / rows))
    return sorted(measured, key=lambda x: -x[2] / x[1])


def rejected_by(rules: list[Rule], metric) -> Column:
    """Name of the first rule, in the given order, that rejects; null if none does."""
    out = None
    for rule in rules:
        hit = F.coalesce(rule.rejects(metric), F.lit(False))
        out = F.when(hit, rule.name) if out is None else out.when(hit, rule.name)
    return F.lit(None).cast("string") if out is None else out


def apply_rules(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """Add ``rejected_by``, evaluating the rules lazily in the given order."""
    return docs.withColumn("rejected_by", rejected_by(rules, lazy(text=text)))


def quality_rules(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Per document: the returned metrics, the verdict of the base rules and of the whole cascade.

    The cascade runs on texts that pass the base rules; metrics that are not returned are expressions
    inside its branches, so that a text pays for one only if no earlier rule has rejected it.
    """
    ordered = [rule for rule, _, _ in order_rules(docs, rules, ready=RETURNED) if rule not in BASE_RULES]
    split = docs.select("doc_id", "text", words(F.col("text")).alias("words"))
    measured = split.select("doc_id", "text", *[METRICS[name](F.col("text"), F.col("words")).alias(name) for name in RETURNED])
    base = F.coalesce(BASE_RULES[0].rejects(F.col) | BASE_RULES[1].rejects(F.col), F.lit(True))
    return measured.select("doc_id", *RETURNED, base.alias("base_failed"), (~base & rejected_by(ordered, lazy(RETURNED)).isNull()).alias("kept"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


#: kept adds the extra rules to base_failed; counts are over whole texts.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
      FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM r) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words,
         coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(l)::BIGINT AS n_lines,
         (length(text) - length(replace(text, '!', '')))::BIGINT AS n_exclaims
  FROM d LEFT JOIN c ON d.doc_id = c.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > n_words
            OR 10 * n_exclaims > 3 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 10 * n_dup_lines > 3 * n_lines) AS kept
FROM m
"""
