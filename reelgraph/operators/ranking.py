"""Ranking, best-of and first-of operators.

Best-of and first-of are aggregates with an ordering struct, so they combine
before the shuffle; top-n filters a row number, which Spark limits before the
shuffle as well. Only full ranks need an order per key (see ``skew``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgraph import config
from reelgraph.operators.skew import rank_in_key

SECTION = ("video_id", "section_index")


def first_row(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The row per key with the smallest ``order``."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return best.select(*keys, "_row.*")


def score_order() -> list[Column]:
    return [
        F.col("score").desc_nulls_last(),
        F.col("timestamp_ms").asc(),
        F.col("frame_id").asc(),
    ]


#: Bins of a score per unit, for ranks of large sections.
SCORE_BINS = 1024


def rank_frames(scored: DataFrame, keys: Sequence[str] = SECTION) -> DataFrame:
    """Rank from 1 within each section: score falling, then time, then id."""
    score = F.col("score").cast("double")
    falling = (
        F.when(score.isNull(), F.lit(2**62))
        .when(F.isnan(score), F.lit(-(2**62)))
        .otherwise(-F.floor(score * SCORE_BINS))
    )
    return rank_in_key(scored, keys, score_order(), falling, "rank")


def best_section_per_frame(scored: DataFrame) -> DataFrame:
    """Highest score per frame; the earliest section among equals."""
    order = F.struct(-F.coalesce(F.col("score"), F.lit(0.0)), F.col("section_index"))
    return first_row(scored, ["video_id", "frame_id"], order)


def distinct_keep_first(df: DataFrame, scope: Sequence[str], position: str) -> DataFrame:
    """First row in list order per frame identity (id, else key, else url)."""
    identity = F.coalesce(F.col("frame_id").cast("string"), F.col("object_key"), F.col("url"))
    keyed = df.withColumn("identity", identity).where(F.col("identity").isNotNull())
    return first_row(keyed, [*scope, "identity"], F.col(position))


def best_frame_per_section(candidates: DataFrame, keys: Sequence[str] = SECTION) -> DataFrame:
    """The one frame shown for a section.

    ``source_priority`` says which list a candidate comes from (1 query-graph
    matches, 2 semantic ranking, 3 plain candidates). Only the best non-empty
    list counts; in it the highest score wins, the first on ties, and rows
    without a score come last.
    """
    no_score = F.col("score").isNull()
    order = F.struct(
        F.col("source_priority"),
        no_score,
        -F.coalesce(F.col("score"), F.lit(0.0)),
        F.col("position"),
    )
    return first_row(candidates, keys, order)


def top_n_display(
    ranked: DataFrame, n: int = config.DISPLAY_LIMIT, keys: Sequence[str] = SECTION
) -> DataFrame:
    """First ``n`` rows per section, with the section's total beside them."""
    totals = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("frames_total"))
    order = Window.partitionBy(*keys).orderBy(*score_order())
    top = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return top.join(totals, list(keys))


def top_matches(
    candidates: DataFrame, n: int = config.DISPLAY_LIMIT, keys: Sequence[str] = SECTION
) -> DataFrame:
    """Best score per frame identity, then the top ``n``; no score counts as 0.

    Equal scores keep list order: the frame first seen stays ahead.
    """
    identity = F.coalesce(F.col("frame_id").cast("string"), F.col("object_key"), F.col("url"))
    score = F.coalesce(F.col("score"), F.lit(0.0))
    best = (
        candidates.withColumn("identity", identity)
        .where(F.col("identity").isNotNull())
        .groupBy(*keys, "identity")
        .agg(F.max(score).alias("score"), F.min("position").alias("first_position"))
    )
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("first_position"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def find_frame(
    frames: DataFrame, targets: DataFrame, scope: Sequence[str] = SECTION
) -> DataFrame:
    """First listed frame sharing the target's id, else key, else url.

    ``frames`` has frame_id, object_key, url and ``position`` (list order);
    ``targets`` has the same three, once per scope. Frames meet the target of
    their scope in one join; the earliest hit wins whichever of the three matched.
    """
    names = ("frame_id", "object_key", "url")
    wanted = targets.select(*scope, *[F.col(n).alias(f"_{n}") for n in names])
    alike = [F.col(n) == F.col(f"_{n}") for n in names]
    hits = frames.join(wanted, list(scope)).where(alike[0] | alike[1] | alike[2])
    return first_row(hits.drop(*wanted.columns[len(scope):]), scope, F.col("position"))
