"""Final selected / rejected state of every frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgraph import config
from reelgraph.functions.text import clamp_unit


def resolve_selection(
    frames: DataFrame, evaluated: DataFrame, dedup: DataFrame, best: DataFrame
) -> DataFrame:
    """Every frame ends selected or rejected, for the first reason that applies.

    frames: video_id, frame_id. evaluated: frames inside some window with
    ``passed`` and ``quality_reason``. dedup: dedup_frame_report rows.
    best: best_section_per_frame rows with ``score``. Inputs meet on
    (video_id, frame_id), so no join key is hotter than one frame's sections.
    """
    key = ["video_id", "frame_id"]
    kept = F.col("dedup_status") == "kept"
    by_frame = dedup.groupBy(*key).agg(
        F.max(kept).alias("_candidate"),
        F.count(F.when(~kept, 1)).alias("duplicate_sections"),
        F.min(F.when(~kept, F.col("section_index"))).alias("first_duplicate_section"),
    )
    joined = (
        frames.join(evaluated.select(*key, "passed", "quality_reason"), key, "left")
        .join(by_frame, key, "left")
        .join(
            best.select(*key, F.col("section_index").alias("_section"), F.col("score").alias("_s")),
            key,
            "left",
        )
    )
    candidate = F.coalesce(F.col("_candidate"), F.lit(False))
    outside = F.col("passed").isNull()
    duplicate = F.coalesce(F.col("duplicate_sections"), F.lit(0)) > 0
    stage = (
        F.when(candidate, F.lit("graph_index_matching"))
        .when(outside, F.lit("section_window"))
        .when(~F.col("passed"), F.lit("quality_filter"))
        .when(duplicate, F.lit("section_dedup"))
        .otherwise(F.lit("section_window"))
    )
    reason = (
        F.when(candidate, F.lit(config.REASON_SELECTED))
        .when(outside, F.lit(config.REASON_OUTSIDE))
        .when(~F.col("passed"), F.col("quality_reason"))
        .when(duplicate, F.lit(config.REASON_DUPLICATE))
        .otherwise(F.lit(config.REASON_OUTSIDE))
    )
    rejected_duplicate = F.col("selection_stage") == "section_dedup"
    return (
        joined.withColumn("selection_stage", stage)
        .withColumn("selection_reason", F.substring(reason, 1, 4000))
        .withColumn(
            "selection_status",
            F.when(candidate, F.lit("selected")).otherwise(F.lit("rejected")),
        )
        .withColumn(
            "selection_score",
            F.when(candidate, clamp_unit(F.coalesce(F.col("_s"), F.lit(0.0)))).otherwise(0.0),
        )
        .withColumn("matched_section_index", F.when(candidate, F.col("_section")))
        .withColumn(
            "duplicate_sections",
            F.when(rejected_duplicate, F.col("duplicate_sections")).otherwise(F.lit(0)),
        )
        .withColumn(
            "first_duplicate_section",
            F.when(rejected_duplicate, F.col("first_duplicate_section")),
        )
        .drop("_candidate", "_section", "_s", "passed", "quality_reason")
    )
