"""Secret scans: fixed patterns, and character Markov models for random strings.

Base spans come from three patterns. More are added by two first-order Markov models
over characters, one of random strings and one of ordinary identifiers. They are trained
on all documents: values that a base pattern caught are labelled random, long words of
the documents, without those values, ordinary. A token of ``TOKEN`` that touches no
base span is a secret where the log-likelihood ratio per transition exceeds ``THRESHOLD``.

Pairs of characters are cells of a 95 x 95 table of printable ASCII, so the models are one
array of 9 025 numbers whatever the corpus. Spark sums the pair counts; only those cells
reach the driver. Everything is built from SQL functions. Offsets are code points, ends
exclusive: a text is split at the matches, and lengths of pieces and matches are added up.

Defined cases: a null text is empty and has no spans; texts are scanned whole; equal rows
get equal spans; without labelled values on either side nothing is added to the base
spans; an empty table gives no rows; other columns are carried, those with a name that is
added here are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns and least lengths of the base scan. A run of hex digits that is
# too short is never a match of a longer one, so its length is part of the pattern.
ASSIGN = (
    r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

#: Whole runs that the models judge: long, with a letter and a digit.
TOKEN = (
    r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}"
)
#: Words that train the model of ordinary identifiers.
IDENTIFIER = r"[A-Za-z][A-Za-z0-9_-]{7,}"

KINDS = ("assign", "access", "hex", "random")
SPANS = "array<struct<start:int,kind:int,stop:int>>"

#: Log-likelihood ratio per transition above which a token counts as random.
THRESHOLD = 0.5

CELLS = 95
COLUMNS = ("base_spans", "spans")


def _none() -> Column:
    return F.array().cast(SPANS)


def _let(values: list[Column], then: Callable[..., Column]) -> Column:
    """``then(*values)`` with each value worked out once per row."""
    packed = F.array(F.struct(*[v.alias(f"v{k}") for k, v in enumerate(values)]))
    return F.get(
        F.transform(packed, lambda s: then(*[s[f"v{k}"] for k in range(len(values))])), F.lit(0)
    )


def _walk(pieces: Column, matches: Column, kind: int, fits: Callable[[Column], Column]) -> Column:
    """Spans by a running sum over pieces and matches; keeps the matches that fit."""
    def step(acc: Column, k: Column) -> Column:
        start = acc["at"] + F.length(F.get(pieces, k))
        stop = start + F.length(F.get(matches, k))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"))
        found = F.when(fits(k), F.concat(acc["found"], F.array(span).cast(SPANS)))
        return F.struct(stop.alias("at"), found.otherwise(acc["found"]).alias("found"))

    empty = F.struct(F.lit(0).alias("at"), _none().alias("found"))
    places = F.sequence(F.lit(0), F.size(matches) - 1)
    return F.when(
        F.size(matches) > 0, F.aggregate(places, empty, step, lambda acc: acc["found"])
    ).otherwise(_none())


def _scan(text: Column, pattern: str, kind: int, judge: Callable[[Column], Column],
          group: int = 0) -> Column:
    """Spans of a pattern where ``judge`` of the match's group holds."""
    spans = _let(
        [
            F.split(text, pattern, -1),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(group)),
        ],
        lambda pieces, whole, part: _walk(pieces, whole, kind, lambda k: judge(F.get(part, k))),
    )
    return F.when(text.rlike(pattern), spans).otherwise(_none())


def base_spans(text: Column) -> Column:
    """Spans of the three patterns by start, then kind."""
    return F.sort_array(F.concat(
        _scan(text, ASSIGN, 0, lambda v: F.length(v) >= ASSIGN_LEAST, group=2),
        _scan(text, ACCESS, 1, lambda v: F.length(v) >= ACCESS_LEAST),
        _scan(text, HEX, 2, lambda v: F.lit(True)),
    ))


def _cell(token: Column, i: Column) -> Column:
    """The table cell of the transition from character i to the next (from 1)."""
    first = F.ascii(F.substring(token, i, F.lit(1))) - 32
    return first * CELLS + F.ascii(F.substring(token, i + 1, F.lit(1))) - 32


def train(docs: DataFrame, text: str = "text") -> list[float] | None:
    """Log-likelihood ratio of every transition, or None without values of both kinds.

    Every document counts; equal rows count as often as they occur.
    """
    whole = docs.select(F.coalesce(F.col(text), F.lit("")).alias("_t"))
    cut = F.col("_t")
    for pattern in (ASSIGN, ACCESS, HEX):
        cut = F.regexp_replace(cut, pattern, " ")
    values = F.concat(
        F.filter(F.regexp_extract_all("_t", F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= ASSIGN_LEAST),
        F.filter(F.regexp_extract_all("_t", F.lit(ACCESS), F.lit(0)), lambda v: F.length(v) >= ACCESS_LEAST),
        F.regexp_extract_all("_t", F.lit(HEX), F.lit(0)),
    )
    labelled = whole.select(F.explode(F.array(
        F.struct(F.lit(1).alias("random"), values.alias("tokens")),
        F.struct(F.lit(0).alias("random"),
                 F.regexp_extract_all(cut, F.lit(IDENTIFIER), F.lit(0)).alias("tokens")),
    )).alias("s"))
    # Values are ASCII, so a pair is two bytes, which are found without a walk from the start.
    tokens = labelled.select("s.random", F.explode(F.col("s.tokens").cast("array<binary>")).alias("token"))
    pairs = tokens.select("random", "token", F.explode(F.sequence(F.lit(1), F.length("token") - 1)).alias("i"))
    pair = F.substring("token", F.col("i"), F.lit(2)).alias("pair")
    counts = ([0] * CELLS**2, [0] * CELLS**2)
    for row in pairs.groupBy("random", pair).agg(F.count(F.lit(1)).alias("n")).collect():
        first, second = row["pair"]
        counts[row["random"]][(first - 32) * CELLS + second - 32] = row["n"]
    if not sum(counts[0]) or not sum(counts[1]):
        return None
    return _ratios(*counts)


def _ratios(ordinary: list[int], random: list[int], prior: float = 0.5) -> list[float]:
    """Smoothed by ``prior`` counts per cell, rounded so that the array stays short."""
    out = []
    for row in range(0, CELLS**2, CELLS):
        totals = [sum(c[row:row + CELLS]) + prior * CELLS for c in (ordinary, random)]
        for cell in range(row, row + CELLS):
            out.append(round(
                math.log((random[cell] + prior) / totals[1]) - math.log((ordinary[cell] + prior) / totals[0]), 3
            ))
    return out


def random_spans(text: Column, ratios: list[float], threshold: float = THRESHOLD) -> Column:
    """Spans of tokens that look drawn rather than named."""
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")

    def per_transition(token: Column) -> Column:
        steps = F.sequence(F.lit(1), F.length(token) - 1)
        total = F.aggregate(steps, F.lit(0.0), lambda acc, i: acc + F.get(table, _cell(token, i)))
        return total / (F.length(token) - 1)

    return _scan(text, TOKEN, 3, lambda token: per_transition(token) > threshold)


def find(docs: DataFrame, text: str = "text", ratios: list[float] | None = None,
         threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans`` (base and added), each
    ``array<struct<start, kind, stop>>`` by start, then kind; kinds as in ``KINDS``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    carried = [c for c in docs.columns if c not in COLUMNS]
    df = docs.select(*carried, base_spans(whole).alias("base_spans"))
    if ratios is None:
        return df.withColumn("spans", F.col("base_spans"))
    added = F.filter(
        random_spans(whole, ratios, threshold),
        lambda r: ~F.exists("base_spans", lambda b: (b["start"] < r["stop"]) & (r["start"] < b["stop"])),
    )
    return df.withColumn("spans", F.sort_array(F.concat(F.col("base_spans"), added)))


def redact(docs: DataFrame, text: str = "text", ratios: list[float] | None = None,
           threshold: float = THRESHOLD, mark: str = "<secret>") -> DataFrame:
    """``docs`` with every span of the text replaced by ``mark``; overlapping spans once."""
    found = find(docs, text, ratios, threshold)
    whole = F.col(text)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.concat(acc["out"], F.substring(whole, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(
            F.when(fresh, piece).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], s["stop"]).alias("at"),
        )

    cut = F.aggregate(
        "spans", start, step,
        lambda acc: F.concat(acc["out"], F.substring(whole, acc["at"] + 1, F.length(whole))),
    )
    clean = F.when(F.size("spans") > 0, cut).otherwise(whole)
    return found.withColumn(text, clean).select(*docs.columns)


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"),
                                     s["stop"].cast("string"))), ",")
