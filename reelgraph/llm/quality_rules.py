"""Quality rules: a short-circuit cascade ordered by rejections per cost.

A rule is a condition on measures of a text. Its cost and the rows it rejects are
estimated on a sample, the rules are put in order of rejections per cost (each counted
only on the rows that the rules before it leave), and one CASE expression tries them in
that order and stops at the first that rejects; measures that no rule before needed are
then not worked out. The order changes how long it takes, never which rows are kept.

Defined cases: a null text has no words and counts 0 everywhere; very long texts are
measured whole; equal rows are judged alike; an empty table gives no rows and the rules
stay in the order given; columns of the input are carried, and those with a name that
is added here are replaced. Three-word windows are compared by their 64-bit hashes
inside one text.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgraph.llm.common import WORD_CHAR, first_rows, words_column

#: Rows of the sample from which cost and selectivity of the rules are estimated: the
#: first that a scan meets. They pass through the driver.
SAMPLE_ROWS = 1_000

#: Runs of characters that are no symbols.
NO_SYMBOLS = r"[^#*$%&|<>]+"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
VERDICT = ("rejected_by", "kept")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words inside a three-word window that the text holds twice or more."""
    def starts(grams: Column) -> Column:
        return F.filter(
            grams,
            lambda g, k: (g["h"] == F.get(grams, k + 1)["h"]) | (g["h"] == F.get(grams, k - 1)["h"]),
        )

    def covered(found: Column) -> Column:
        return F.aggregate(
            F.sort_array(F.transform(found, lambda g: g["i"])),
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
            lambda acc, i: F.struct(
                (acc["n"] + (i + 3 - F.greatest(i, acc["end"])).cast("long")).alias("n"),
                (i + 3).alias("end"),
            ),
            lambda acc: acc["n"],
        )

    def count(hashes: Column) -> Column:
        # Most texts repeat no window, which a set of hashes tells without sorting.
        grams = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        plain = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(plain, F.lit(0).cast("long")).otherwise(covered(_let(grams, starts)))

    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(3)]),
    )
    return F.when(F.size(words) >= 3, _let(windows, count)).otherwise(F.lit(0).cast("long"))


def measure_columns(text: Column, words: Column) -> dict[str, Column]:
    """The measures as expressions over a text and the column of its words."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(WORD_CHAR))
    repeated_lines = _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(whole, NO_SYMBOLS, "")).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": repeated_lines.cast("long"),
        "n_repeat_words": _repeat_words(words),
    }


def base_failed(m: dict[str, Column]) -> Column:
    """The fixed part of the verdict."""
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


@dataclass(frozen=True)
class Rule:
    """``rejects`` turns the measures into a condition; null counts as not rejected."""

    name: str
    rejects: Callable[[dict[str, Column]], Column]


#: The two base rules first; the others are wide of ordinary prose in any language.
DEFAULT_RULES = (
    Rule("too_few_words", lambda m: m["n_words"] < 50),
    Rule("repeats_itself", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    Rule("symbols_per_word", lambda m: 4 * m["n_symbols"] > m["n_words"]),
    Rule("word_length", lambda m: (m["word_chars"] < 2 * m["n_words"])
         | (m["word_chars"] > 15 * m["n_words"])),
    Rule("repeated_lines", lambda m: (m["n_lines"] >= 4) & (2 * m["n_dup_lines"] > m["n_lines"])),
)


def order_rules(sample: DataFrame, rules: Sequence[Rule], m: dict[str, Column]) -> list[Rule]:
    """Rules by rejections per cost on the sample.

    What the rules reject together is one row of counts per combination of verdicts, so
    the driver sees at most ``2 ** len(rules)`` rows. A rule's cost is the time of a job
    that evaluates it alone, less the time of a job that evaluates none.
    """
    names = [f"r{k}" for k in range(len(rules))]
    verdicts = [F.coalesce(r.rejects(m), F.lit(False)) for r in rules]
    combos = [
        tuple(row)
        for row in sample.select(*[v.alias(n) for v, n in zip(verdicts, names, strict=True)])
        .groupBy(*names).count().collect()
    ]

    def seconds(verdict: Column) -> float:
        begun = time.perf_counter()
        sample.agg(F.count_if(verdict)).collect()
        return time.perf_counter() - begun

    idle = seconds(F.size("_words") < 0)
    costs = [max(seconds(v) - idle, 1e-3) for v in verdicts]
    left, ordered = list(range(len(rules))), []

    def gain(k: int) -> float:
        return sum(c[-1] for c in combos if c[k] and not any(c[j] for j in ordered)) / costs[k]

    while left:
        best = max(left, key=lambda k: (gain(k), -k))
        left.remove(best)
        ordered.append(best)
    return [rules[k] for k in ordered]


def verdict(rules: Sequence[Rule], m: dict[str, Column]) -> Column:
    """Name of the first rule that rejects, in the given order; null if none does."""
    name = F.lit(None).cast("string")
    for rule in reversed(rules):
        name = F.when(rule.rejects(m), F.lit(rule.name)).otherwise(name)
    return name


def _with_words(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumn("_words", words_column(F.col(text)))


def best_order(docs: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, text: str = "text",
               sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    sample = _with_words(first_rows(docs.select(text), sample_rows), text)
    return order_rules(sample, rules, measure_columns(F.col(text), F.col("_words")))


def keep_good(docs: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, text: str = "text",
              sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that no rule rejects, with their own columns."""
    ordered = best_order(docs, rules, text, sample_rows)
    # Words are bound inside the condition: a filter is moved below the columns it reads,
    # which would work them out anew at each place that names them.
    rejected = _let(
        words_column(F.col(text)), lambda words: verdict(ordered, measure_columns(F.col(text), words))
    )
    return docs.where(rejected.isNull())


def judge(docs: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, text: str = "text",
          sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Every document with all measures, ``base_failed``, ``rejected_by`` and ``kept``."""
    ordered = best_order(docs, rules, text, sample_rows)
    added = (*MEASURES, *VERDICT, "base_failed")
    carried = [c for c in docs.columns if c not in added]
    lazy = measure_columns(F.col(text), F.col("_words"))
    df = _with_words(docs, text).select(*carried, "_words", *[c.alias(n) for n, c in lazy.items()])
    ready = {n: F.col(n) for n in MEASURES}
    df = df.withColumn("base_failed", base_failed(ready)).withColumn("rejected_by", verdict(ordered, ready))
    return df.withColumn("kept", F.col("rejected_by").isNull()).drop("_words")
