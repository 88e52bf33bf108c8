"""Time-window joins between frames, sections and sentences.

Time is cut into buckets of doubling width. A window stands at its own level, the first
whose buckets are as wide as the window, and so touches two or three of them whatever its
length; a frame falls in one bucket of each level that some window has. A bucket of level k
is as wide as 2^k narrow ones, so it is dealt into as many parts, ``PARTS`` at most, and no
join key grows with the length of a video. Windows without bounds stand at a level of their
own that is one bucket. Windows stand in many parts, more than Spark's estimate of their size
knows, so both sides are always shuffled and sorted and no list of them passes the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgraph import config

#: Width of a bucket of level 0.
BUCKET_MS = 600_000
#: Parts of a wide bucket at most.
PARTS = 64
#: The level of windows that cover a whole video.
WHOLE = 62

_KEYS = ["video_id", "_level", "_b", "_part"]


def section_windows(
    sections: DataFrame, pad_ms: int = config.SECTION_PADDING_MS, null_window: str = "all"
) -> DataFrame:
    """Padded inclusive window per section; NULL bounds mean the whole video.

    A section without usable bounds covers the whole video (``all``), or is
    taken as it stands (``strict``).
    """
    start, end = F.col("start_ms"), F.col("end_ms")
    if null_window == "strict":
        start = F.coalesce(start, F.lit(0))
        end = F.coalesce(end, start)
    padded = sections.withColumn(
        "window_start_ms", F.greatest(F.lit(0), start - F.lit(pad_ms))
    ).withColumn("window_end_ms", end + F.lit(pad_ms))
    if null_window == "strict":
        return padded
    usable = start.isNotNull() & end.isNotNull() & (end > start)
    return padded.withColumn(
        "window_start_ms", F.when(usable, F.col("window_start_ms"))
    ).withColumn("window_end_ms", F.when(usable, F.col("window_end_ms")))


def _inside(null_window: str) -> Column:
    inside = (F.col("timestamp_ms") >= F.col("window_start_ms")) & (
        F.col("timestamp_ms") <= F.col("window_end_ms")
    )
    if null_window == "all":
        return inside | F.col("window_start_ms").isNull()
    return inside


def _width(level: Column, width: float) -> Column:
    return F.lit(width) * F.pow(F.lit(2.0), level)


def _parts(level: Column) -> Column:
    return F.least(F.lit(PARTS), F.pow(F.lit(2.0), F.least(level, F.lit(30)))).cast("int")


def _placed(windows: DataFrame, start: str, end: str, width: float) -> DataFrame:
    """Windows with the (level, bucket, part) triples they stand in; empty ones go.

    The level only decides how many buckets are listed, never which frames are found.
    """
    low, high = F.col(start), F.col(end)
    length = (high - low).cast("double")
    level = F.when(low.isNull() | high.isNull(), F.lit(WHOLE)).otherwise(
        F.greatest(F.lit(0), F.least(F.lit(WHOLE - 1), F.ceil(F.log2(F.greatest(length, F.lit(1.0)) / width)))).cast("int")
    )
    leveled = windows.where(low.isNull() | high.isNull() | (low <= high)).withColumn("_level", level)
    own = _width(F.col("_level"), width)
    touched = F.when(F.col("_level") == WHOLE, F.array(F.lit(0).cast("bigint"))).otherwise(
        F.sequence(F.floor(low / own), F.floor(high / own))
    )
    return leveled.withColumn("_b", F.explode(touched)).withColumn(
        "_part", F.explode(F.sequence(F.lit(0), _parts(F.col("_level")) - 1))
    )


def _levels(placed: DataFrame) -> Column:
    """The levels that windows have, 63 at most, as an array."""
    found = [r[0] for r in placed.select("_level").distinct().collect()]
    return F.array(*[F.lit(x) for x in sorted(found)]).cast("array<int>")


def _at_levels(rows: DataFrame, levels: Column, start: Column, end: Column, width: float, part: Column) -> DataFrame:
    """Rows once for every bucket of every level that they touch."""
    leveled = rows.withColumn("_level", F.explode(levels))
    own = _width(F.col("_level"), width)
    touched = F.when(F.col("_level") == WHOLE, F.array(F.lit(0).cast("bigint"))).otherwise(
        F.sequence(F.floor(start / own), F.greatest(F.floor(start / own), F.floor(end / own)))
    )
    return leveled.withColumn("_b", F.explode(touched)).withColumn("_part", F.pmod(part, _parts(F.col("_level"))).cast("int"))


def frames_in_sections(
    frames: DataFrame,
    sections: DataFrame,
    pad_ms: int = config.SECTION_PADDING_MS,
    null_window: str = "all",
    bucket_ms: int = BUCKET_MS,
) -> DataFrame:
    """Every (section, frame) with the frame inside the section's window.

    Frames and windows meet once, on (video, level, time bucket, part).
    """
    windows = section_windows(sections, pad_ms, null_window)
    if null_window == "strict":
        windows = windows.where("window_start_ms is not null and window_end_ms is not null")
    placed = _placed(windows, "window_start_ms", "window_end_ms", bucket_ms)
    time = F.col("timestamp_ms")
    known = frames.where("timestamp_ms is not null") if null_window == "strict" else frames
    near = _at_levels(known, _levels(placed), time, time, bucket_ms, F.xxhash64("frame_id"))
    return near.join(placed.hint("merge"), _KEYS).where(_inside(null_window)).drop("_level", "_b", "_part")


def frames_in_sections_strict(
    frames: DataFrame, sections: DataFrame, bucket_ms: int = BUCKET_MS
) -> DataFrame:
    """No padding, and no whole-video fallback for unusable bounds."""
    return frames_in_sections(frames, sections, 0, "strict", bucket_ms)


def relevant_frames(
    frames: DataFrame,
    sections: DataFrame,
    pad_ms: int = config.SECTION_PADDING_MS,
    bucket_ms: int = BUCKET_MS,
) -> DataFrame:
    """Frames inside any window, kept before anything expensive looks at them.

    A video's windows are first merged where they overlap, and into one where any covers
    the whole video. Merged windows share no point, so a semi join on (video, level, time
    bucket, part) finds a frame at one level at most.
    """
    windows = section_windows(sections, pad_ms).select("video_id", "window_start_ms", "window_end_ms")
    by_start = Window.partitionBy("video_id").orderBy("window_start_ms", "window_end_ms")
    whole = F.max(F.col("window_start_ms").isNull() | F.col("window_end_ms").isNull()).over(Window.partitionBy("video_id"))
    reach = F.max("window_end_ms").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("window_start_ms") > reach, F.lit(True)) & ~F.col("_whole")
    number = F.sum(opens.cast("int")).over(by_start.rowsBetween(Window.unboundedPreceding, 0))
    bounded = windows.where("window_start_ms is null or window_end_ms is null or window_start_ms <= window_end_ms")
    merged = bounded.withColumn("_whole", whole).withColumn("_n", number).groupBy("video_id", "_whole", "_n").agg(
        F.min("window_start_ms").alias("_start"), F.max("window_end_ms").alias("_end")
    ).select(
        "video_id", F.when(~F.col("_whole"), F.col("_start")).alias("window_start_ms"),
        F.when(~F.col("_whole"), F.col("_end")).alias("window_end_ms"),
    )
    placed = _placed(merged, "window_start_ms", "window_end_ms", bucket_ms)
    time = F.col("timestamp_ms")
    near = _at_levels(frames, _levels(placed), time, time, bucket_ms, F.xxhash64("frame_id"))
    met = F.lit(True)
    for key in _KEYS:
        met = met & (F.col(f"f.{key}") == F.col(f"w.{key}"))
    return near.alias("f").join(placed.alias("w").hint("merge"), met & _inside("all"), "left_semi").drop("_level", "_b", "_part")


def segments_overlapping(
    segments: DataFrame, windows: DataFrame, bucket_seconds: float = 600.0
) -> DataFrame:
    """Sentences overlapping a window: sentence end >= start, sentence start <= end.

    ``windows`` carries video_id, section_index, start_seconds, end_seconds. A sentence
    lists the buckets it touches at the levels that windows have; a pair is kept in the
    first bucket the two share, so it appears once.
    """
    left = segments.withColumnRenamed("start_seconds", "segment_start").withColumnRenamed("end_seconds", "segment_end")
    bounded = windows.where("start_seconds is not null and end_seconds is not null")
    placed = _placed(bounded, "start_seconds", "end_seconds", bucket_seconds)
    start, end = F.col("segment_start"), F.col("segment_end")
    near = _at_levels(
        left.where("segment_start is not null and segment_end is not null"), _levels(placed), start, end,
        bucket_seconds, F.xxhash64(start, end),
    )
    shared = F.floor(F.greatest(start, F.col("start_seconds")) / _width(F.col("_level"), bucket_seconds))
    return near.join(placed.hint("merge"), _KEYS).where(
        (end >= F.col("start_seconds")) & (start <= F.col("end_seconds")) & (F.col("_b") == shared)
    ).drop("_level", "_b", "_part")
