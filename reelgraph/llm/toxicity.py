"""Toxicity: class-conditional Kneser-Ney models over the letters of words.

Two models of order 6, one of words in toxic documents and one of words in ordinary ones,
both backed off to the same lower orders: a Kneser-Ney model that counts distinct left
neighbours over both classes. With the shared model of the shorter context ``h'``,

    p_c(x | h) = (1 - w_c(h)) * discounted_c(x | h) + w_c(h) * shared(x | h')

For a context that both classes know ``w`` is the same, the larger of theirs, so a rare
expression that neither class knows well has the same likelihood under both. A class that
does not know a context backs off, with a weight of 1. Models begin anew at every word: the
order of words tells nothing.

A document has two values. The first is ``log p_toxic - log p_ordinary`` over all n-grams of
all its words, for and against, divided by the number of words. The second counts of every
word only what its ratio has above ``MARGIN``, on a logarithmic scale, as a few words make a
long text toxic. A logistic curve of both, fitted on labelled documents that gave no counts,
is the score.

All counts come from Spark aggregates over the labelled rows that do not calibrate. What
tasks hold is one table of ratios by the 64-bit hash of an n-gram, or of a context for the
n-grams that neither class holds. It grows with the distinct n-grams of the labelled rows.

Defined cases: a null or empty text, and one without letters, has a ratio of 0 and the
score of that; texts are scored whole; repeated rows are scored alike; rows with a null
label or key train nothing; without rows of both classes every score is the share of toxic
rows, 0 if there is none; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelgraph.llm.common import Shared, words_column
from reelgraph.llm.word_scores import WordSums, each_part

ORDER = 6
DISCOUNT = 0.75
#: Log-likelihood ratio of a word up to which the second value takes it for chance.
MARGIN = 2.0
START, END = "^", "$"
#: Every so many-th labelled row (by a hash of the key) calibrates and gives no counts.
CALIBRATION = 5
#: Widths of the bins of the two values, and what is added before the second's logarithm.
BINS, FLOOR = (0.02, 0.1), 1e-4

LETTERS = r"[^\p{L}\p{M}]+"


@dataclass(frozen=True)
class Ratios:
    """Log-likelihood ratios by the hash of an n-gram or context, sorted by hash."""

    hashes: np.ndarray
    values: np.ndarray

    def find(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ratio of every text, 0 for an unknown one, and which are known."""
        import xxhash

        digests = (xxhash.xxh64_intdigest(t.encode(), 42) for t in texts)
        asked = np.fromiter(digests, np.uint64, len(texts)).view(np.int64)
        if not len(self.hashes):
            return np.zeros(len(texts)), np.zeros(len(texts), bool)
        at = np.minimum(np.searchsorted(self.hashes, asked), len(self.hashes) - 1)
        known = self.hashes[at] == asked
        return np.where(known, self.values[at], 0.0), known


@dataclass(frozen=True)
class Model:
    ratios: Ratios
    slopes: tuple[float, float]
    bias: float


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(gram, toxic, ordinary): how often words of either class hold an n-gram."""
    words = labelled.select("label", F.explode(words_column(F.col("text"))).alias("w"))
    words = words.select("label", F.lower(F.regexp_replace("w", LETTERS, "")).alias("w")).where("w != ''")
    counted = words.groupBy("w").agg(
        F.count_if(F.col("label") == 1).alias("toxic"), F.count_if(F.col("label") == 0).alias("ordinary")
    )
    marked = F.concat(F.lit(START * (ORDER - 1)), F.col("w"), F.lit(END))
    places = F.sequence(F.lit(1), F.length("w") + 1)
    grams = counted.select(
        "toxic", "ordinary",
        F.explode(F.transform(places, lambda i: F.substring(marked, i, F.lit(ORDER)))).alias("gram"),
    )
    return grams.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _context(column: str = "gram"):
    return F.expr(f"substring({column}, 1, length({column}) - 1)")


def shared_backoff(grams: DataFrame) -> DataFrame:
    """(gram, shared): Kneser-Ney probability of the last letter in n-grams one shorter than
    those given, classes taken together."""
    levels = {ORDER: grams.select("gram")}
    for order in range(ORDER - 1, 0, -1):
        shorter = F.expr("substring(gram, 2)").alias("gram")
        levels[order] = levels[order + 1].select(shorter).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    below = None
    for order in range(1, ORDER):
        same = Window.partitionBy(_context())
        table = levels[order].select(
            "gram", "n", F.sum("n").over(same).alias("total"), F.count(F.lit(1)).over(same).alias("kinds")
        )
        if below is None:
            table = table.withColumn("lower", 1 / (F.col("kinds") + 1))
        else:
            table = table.withColumn("_tail", F.expr("substring(gram, 2)")).join(
                below.select(F.col("gram").alias("_tail"), F.col("shared").alias("lower")).hint("merge"), "_tail"
            )
        below = table.select("gram", (
            (F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("kinds") * F.col("lower"))
            / F.col("total")
        ).alias("shared"))
    return below


def _weights() -> tuple:
    """Backoff weights of the two classes in a context, and whether both know it."""
    totals = [F.col(f"{c}_total") for c in ("toxic", "ordinary")]
    own = [
        F.when(F.col(f"{c}_total") > 0, DISCOUNT * F.col(f"{c}_kinds") / F.col(f"{c}_total")).otherwise(F.lit(1.0))
        for c in ("toxic", "ordinary")
    ]
    both = (totals[0] > 0) & (totals[1] > 0)
    return (*[F.when(both, F.greatest(*own)).otherwise(w) for w in own], both)


def gram_ratios(grams: DataFrame, lower: DataFrame | None = None) -> DataFrame:
    """(gram, ratio): log-likelihood ratio of every n-gram that a class holds."""
    same = Window.partitionBy(_context())
    lower = (shared_backoff(grams) if lower is None else lower).withColumnRenamed("gram", "_tail")
    table = grams.withColumn("_tail", F.expr("substring(gram, 2)")).join(lower.hint("merge"), "_tail").drop("_tail")
    for c in ("toxic", "ordinary"):
        table = table.withColumn(f"{c}_total", F.sum(c).over(same))
        table = table.withColumn(f"{c}_kinds", F.count_if(F.col(c) > 0).over(same))

    def likelihood(c: str, w):
        mass = F.col(f"{c}_total") - DISCOUNT * F.col(f"{c}_kinds")
        discounted = F.when(mass > 0, F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / mass).otherwise(F.lit(0.0))
        return (1 - w) * discounted + w * F.col("shared")

    toxic, ordinary, _ = _weights()
    return table.select("gram", F.ln(likelihood("toxic", toxic) / likelihood("ordinary", ordinary)).alias("ratio"))


def context_ratios(grams: DataFrame) -> DataFrame:
    """(gram, ratio): by contexts that one class knows, the ratio of n-grams that neither holds.

    In contexts that both know it is 0, as both back off to the same with the same weight.
    """
    table = grams.groupBy(_context().alias("gram")).agg(*[
        a for c in ("toxic", "ordinary")
        for a in (F.sum(c).alias(f"{c}_total"), F.count_if(F.col(c) > 0).alias(f"{c}_kinds"))
    ])
    toxic, ordinary, both = _weights()
    return table.where(~both).select("gram", F.ln(toxic / ordinary).alias("ratio"))


def _hashed(ratios: DataFrame) -> DataFrame:
    return ratios.select(F.xxhash64("gram").alias("hash"), F.col("ratio").cast("float").alias("ratio"))


def _ratios(grams: DataFrame, shared: Shared) -> Ratios:
    """Steps are written one by one, so that no two keep their shuffle files at a time."""
    lower = shared.save(shared_backoff(grams), "lower")
    held = shared.save(_hashed(gram_ratios(grams, lower)), "held")
    unheld = shared.save(_hashed(context_ratios(grams)), "unheld")
    table = held.unionByName(unheld).toArrow()
    for name in ("lower", "held", "unheld"):
        shared.drop(name)
    hashes, values = table["hash"].to_numpy(), table["ratio"].to_numpy()
    order = np.argsort(hashes)
    return Ratios(hashes[order], values[order])


def _word_value(ratios: Ratios):
    import regex

    not_letters = regex.compile(LETTERS)

    def value(words: list[bytes]) -> np.ndarray:
        grams, ends = [], []
        for word in words:
            w = not_letters.sub("", word.decode("utf-8", "replace")).lower()
            if w:
                marked = START * (ORDER - 1) + w + END
                grams.extend(marked[i:i + ORDER] for i in range(len(w) + 1))
            ends.append(len(grams))
        found, known = ratios.find(grams)
        unknown = np.flatnonzero(~known)
        found[unknown] = ratios.find([grams[i][:-1] for i in unknown.tolist()])[0]
        sums = np.concatenate([[0.0], np.cumsum(found)])
        at = np.asarray([0, *ends])
        own = sums[at[1:]] - sums[at[:-1]]
        return np.stack([own, np.maximum(own - MARGIN, 0.0)], axis=1)

    return value


def _evidence(rows: DataFrame, key: str, ratios: Ratios) -> DataFrame:
    """(key, whole, high): the two length-normalised values of every text."""
    shared = rows.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = WordSums(_word_value(shared.value), 2)
        for part in each_part(batches):
            sums = totals.sums(part.column(1).to_pylist())
            mean = sums[:, 2:] / np.maximum(sums[:, :1], 1)
            columns = [part.column(0), pa.array(mean[:, 0]), pa.array(np.log(FLOOR + mean[:, 1]))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "whole", "high"])

    return rows.select(F.col(key).cast("long").alias("key"), "text").mapInArrow(
        run, "key long, whole double, high double"
    )


def fit_curve(values: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> tuple[tuple[float, ...], float]:
    """Slopes and bias of a logistic curve through counts of both labels, lightly damped.

    ``values`` has one row per bin and one column per value.
    """
    n = ones + zeros
    mean = np.average(values, axis=0, weights=n)
    width = np.sqrt(np.average((values - mean) ** 2, axis=0, weights=n))
    width[width == 0] = 1.0
    table = np.column_stack([(values - mean) / width, np.ones(len(n))])
    damping = np.array([1e-2] * values.shape[1] + [0.0])
    at = np.zeros(table.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(table @ at, -40, 40)))
        gradient = table.T @ (p * n - ones) + damping * at
        weight = np.maximum(p * (1 - p), 1e-6) * n
        hessian = (table * weight[:, None]).T @ table + np.diag(damping + 1e-6)
        step = np.linalg.solve(hessian, gradient)
        step /= max(1.0, float(np.abs(step).max()))
        at = at - step
        if np.abs(step).max() < 1e-8:
            break
    slopes = at[:-1] / width
    return tuple(slopes.tolist()), float(at[-1] - slopes @ mean)


def train(labelled: DataFrame) -> Model:
    """Model from rows (key, text, label). They are written once and read for each step."""
    shared = Shared(labelled.sparkSession)
    rows = shared.save(
        labelled.where("key is not null and label in (0, 1)").select("key", "text", "label"), "labelled"
    )
    held = F.pmod(F.xxhash64("key"), F.lit(CALIBRATION)) == 0
    grams = shared.save(gram_counts(rows.where(~held)), "grams")
    ratios = _ratios(grams, shared)
    texts = rows.where(held)
    values = _evidence(texts.withColumn("packed", F.col("key") * 2 + F.col("label")), "packed", ratios)
    bins = [F.round(F.col(c) / w).alias(c) for c, w in zip(("whole", "high"), BINS, strict=True)]
    label = F.pmod("key", F.lit(2))
    counts = values.groupBy(*bins).agg(
        F.count_if(label == 1).alias("ones"), F.count_if(label == 0).alias("zeros")
    ).orderBy("whole", "high").collect()
    shared.drop("labelled")
    shared.drop("grams")
    ones, zeros = (np.array([r[c] for r in counts], np.float64) for c in ("ones", "zeros"))
    if not ones.sum() or not zeros.sum():
        share = ones.sum() / max(1.0, ones.sum() + zeros.sum())
        return Model(ratios, (0.0, 0.0), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    return Model(ratios, *fit_curve(np.array([[r["whole"], r["high"]] for r in counts]) * BINS, ones, zeros))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, score): 0 to 1, higher where a text is likelier toxic."""
    found = _evidence(docs, doc_id, model.ratios)
    whole, high = (F.lit(slope) * F.col(c) for c, slope in zip(("whole", "high"), model.slopes, strict=True))
    curve = 1 / (1 + F.exp(-(whole + high + F.lit(model.bias))))
    return found.select(F.col("key").alias("doc_id"), curve.alias("score"))
