"""Frame quality gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgraph import config
from reelgraph.functions import geometry


def with_quality_score(frames: DataFrame, out: str = "quality_score") -> DataFrame:
    return frames.withColumn(
        out,
        geometry.quality_score(
            F.col("blur_score"),
            F.col("mean_brightness"),
            F.col("dark_ratio"),
            F.col("bright_ratio"),
        ),
    )


def quality_gate(
    frames: DataFrame, limits: config.QualityLimits = config.QUALITY, missing: str | None = None
) -> DataFrame:
    """Add ``failures`` (array), ``passed`` and ``quality_reason``.

    ``missing`` names a boolean column telling that the image could not be
    read; such frames are rejected without further checks.
    """
    blur, mean = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("blur_score", "mean_brightness"))
    dark, bright = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("dark_ratio", "bright_ratio"))
    checks = F.array_compact(
        F.array(
            F.when(blur < limits.min_blur, F.lit("severe_blur")),
            F.when(
                (dark >= limits.max_dark_ratio) | (mean <= limits.min_brightness),
                F.lit("too_dark_or_black"),
            ),
            F.when(
                (bright >= limits.max_bright_ratio) | (mean >= limits.max_brightness),
                F.lit("too_bright_or_overexposed"),
            ),
        )
    )
    absent = F.coalesce(F.col(missing), F.lit(False)) if missing else F.lit(False)
    failures = F.when(absent, F.array(F.lit("missing_image"))).otherwise(checks)
    before, after = config.REASON_QUALITY_FAILED.split("{}")
    failed = F.concat(F.lit(before), F.array_join("failures", ", "), F.lit(after))
    return (
        frames.withColumn("failures", failures)
        .withColumn("passed", F.size("failures") == 0)
        .withColumn(
            "quality_reason",
            F.when(F.col("passed"), F.lit(config.REASON_QUALITY_PASSED))
            .when(absent, F.lit(config.REASON_MISSING_IMAGE))
            .otherwise(failed),
        )
    )
