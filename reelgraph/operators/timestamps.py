"""Sampling timestamps: grids, scene changes and minimum spacing."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from reelgraph import config
from reelgraph.operators.folds import arranged, coalesced, whole_groups


def _step_ms(interval_seconds: float) -> int:
    return max(config.MIN_SAMPLE_STEP_MS, round(max(0.1, interval_seconds) * 1000))


def _grid(duration: Column, step: Column, last: Column) -> Column:
    """0, step, ... below the duration, plus the closing point where it is more
    than half a step after the last one."""
    top = F.floor((duration - 1) / step) * step
    points = F.sequence(F.lit(0).cast("bigint"), top, step)
    closing = (last > 0) & (last - top > F.floor(step / 2))
    return F.when(closing, F.array_append(points, last)).otherwise(points)


def dense_grid(
    videos: DataFrame, interval_seconds: float = config.SAMPLE_INTERVAL_SECONDS
) -> DataFrame:
    """(video_id, timestamp_ms) sampled evenly from ``duration_ms``."""
    step = F.lit(_step_ms(interval_seconds)).cast("bigint")
    duration = F.col("duration_ms").cast("bigint")
    last = F.greatest(F.lit(0).cast("bigint"), duration - 1000)
    points = F.when(duration <= 0, F.array(F.lit(0).cast("bigint"))).otherwise(
        _grid(duration, step, last)
    )
    return videos.select("video_id", F.explode(points).alias("timestamp_ms"))


def timeline_grid(videos: DataFrame, max_points: int) -> DataFrame:
    """At most ``max_points`` (60 at most) points no closer than 30 s; the
    closing point is added, or takes the last place when the grid is full."""
    zero = F.lit(0).cast("bigint")
    target = max(1, min(60, max_points))
    duration = F.col("duration_ms").cast("bigint")
    step = F.greatest(
        F.lit(30_000).cast("bigint"), F.floor((duration + F.lit(target - 1)) / F.lit(target))
    )
    points = F.slice(F.sequence(zero, F.floor((duration - 1) / step) * step, step), 1, target)
    last = F.greatest(zero, duration - 1000)
    late = last - F.element_at(points, -1) > F.floor(step / 2)
    closed = (
        F.when(late & (F.size(points) < target), F.array_append(points, last))
        .when(late, F.array_append(F.slice(points, 1, target - 1), last))
        .otherwise(points)
    )
    if max_points <= 0:
        closed = F.array(zero)
    grid = F.when(duration <= 0, F.array(zero)).otherwise(closed)
    return videos.select("video_id", F.explode(F.array_distinct(grid)).alias("timestamp_ms"))


def scene_changes(scores: DataFrame, threshold: float = config.SCENE_THRESHOLD) -> DataFrame:
    """(video_id, timestamp_ms) of frames whose scene score exceeds the threshold."""
    limit = max(0.0, min(1.0, threshold))
    return scores.where(F.col("scene_score") > limit).select(
        "video_id", F.bround(F.col("pts_seconds") * 1000, 0).cast("bigint").alias("timestamp_ms")
    )


_CHUNK = ["video_id", "_chunk"]


class _Chunks:
    """Distinct times of a run of whole chunks, and of each the next one far enough."""

    def __init__(self, table: pa.Table, cuts: np.ndarray, chunk_ms: int, spacing: int):
        times = table.column("timestamp_ms").to_numpy()
        owner = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        fresh = np.ones(len(times), bool)
        fresh[1:] = (times[1:] != times[:-1]) | (owner[1:] != owner[:-1])
        self.times, self.owner = times[fresh], owner[fresh]
        self.heads = table.column("_chunk").to_numpy()[cuts[:-1]] * chunk_ms
        # One axis for all chunks, each longer than a chunk and a spacing.
        self.length = chunk_ms + spacing + 1
        self.axis = self.times - self.heads[self.owner] + self.owner * self.length
        count = len(cuts) - 1
        self.bounds = np.searchsorted(self.owner, np.arange(count + 1))
        self.after = np.searchsorted(self.axis, self.axis + max(spacing, 1))

    def first_from(self, offsets: np.ndarray) -> np.ndarray:
        """Of every chunk the first row at an offset from its head or later; its end if none."""
        place = np.arange(len(offsets)) * self.length + np.clip(offsets, 0, self.length - 1)
        return np.searchsorted(self.axis, place)


def _chunk_maps(chunk_ms: int, spacing: int, arrow: pa.Schema):
    """A row per chunk: what it keeps last, for every time it may keep first.

    From each time the next one kept is fixed, so paths are followed by doubling.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in whole_groups(batches, _CHUNK):
            chunks = _Chunks(table, cuts, chunk_ms, spacing)
            ends = chunks.bounds[1:]
            ahead = np.where(chunks.after < ends[chunks.owner], chunks.after, np.arange(len(chunks.after)))
            while not np.array_equal(ahead, further := ahead[ahead]):
                ahead = further
            # The last kept time lies before the chunk, so no later time can be the first.
            stop = np.minimum(chunks.first_from(np.full(len(ends), spacing)) + 1, ends)
            entries = np.arange(len(ahead)) < stop[chunks.owner]
            offsets = pa.array(np.r_[0, np.cumsum(stop - chunks.bounds[:-1])], pa.int32())
            lists = (
                pa.ListArray.from_arrays(offsets, pa.array(x[entries], pa.int64()))
                for x in (chunks.times, chunks.times[ahead])
            )
            heads = pa.array(cuts[:-1])
            yield pa.RecordBatch.from_arrays(
                [*(table.column(c).combine_chunks().take(heads) for c in _CHUNK), *lists], schema=arrow
            )

    return run


def _compose(spacing: int, arrow: pa.Schema):
    """The time kept last before every chunk, by applying the chunks' maps in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video = last = None
        for batch in batches:
            told = []
            for found, first, exits in zip(*(batch.column(c).to_pylist() for c in ("video_id", "entries", "exits"))):
                if found != video:
                    video, last = found, None
                told.append(last)
                at = 0 if last is None else bisect_left(first, last + spacing)
                last = exits[at] if at < len(exits) else last
            yield pa.RecordBatch.from_arrays(
                [batch.column("video_id"), batch.column("_chunk"), pa.array(told, pa.int64())], schema=arrow
            )

    return run


def _kept(chunk_ms: int, spacing: int, arrow: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in whole_groups(batches, _CHUNK):
            chunks = _Chunks(table, cuts, chunk_ms, spacing)
            heads = pa.array(cuts[:-1])
            last = table.column("_last").combine_chunks().take(heads)
            known = last.is_valid().to_numpy(zero_copy_only=False)
            told = last.fill_null(0).to_numpy() + spacing - chunks.heads
            ends = chunks.bounds[1:]
            at = chunks.first_from(np.where(known, told, 0))
            kept = np.zeros(len(chunks.times), bool)
            while len(at := at[at < ends]):
                kept[at] = True
                ends = chunks.bounds[1:][chunks.owner[at]]
                at = chunks.after[at]
            owners = table.column("video_id").combine_chunks().take(heads).take(pa.array(chunks.owner[kept]))
            yield pa.RecordBatch.from_arrays([owners, pa.array(chunks.times[kept])], schema=arrow)

    return run


def min_spacing_filter(
    points: DataFrame,
    min_spacing_ms: int = config.MIN_SPACING_MS,
    chunk_ms: int = 6 * 3_600_000,
) -> DataFrame:
    """Distinct times per video, each kept only at ``min_spacing_ms`` or more
    after the last kept one; negative times count as 0, points without a video take no part.

    Points are dealt by (video, time chunk). What a chunk keeps depends on the time kept
    last before it, which can only change which of its first times, up to one spacing into
    the chunk, is kept first. One pass gives each chunk's exit for every such entry, a list
    no longer than the spacing has milliseconds; the maps are composed along each video, and
    a second pass over the same exchange keeps the times. The plan is the same for any number
    of chunks.
    """
    spacing = max(0, int(min_spacing_ms))
    time = F.greatest(F.lit(0).cast("bigint"), F.col("timestamp_ms").cast("bigint"))
    rows = points.where("video_id is not null").select("video_id", time.alias("timestamp_ms")).withColumn(
        "_chunk", F.floor(F.col("timestamp_ms") / chunk_ms)
    ).where("_chunk is not null").repartition(*_CHUNK)
    video, chunk, number = rows.schema["video_id"], T.StructField("_chunk", T.LongType()), T.ArrayType(T.LongType())
    maps = T.StructType([video, chunk, T.StructField("entries", number), T.StructField("exits", number)])
    told = T.StructType([video, chunk, T.StructField("_last", T.LongType())])
    out = T.StructType([video, T.StructField("timestamp_ms", T.LongType())])
    ordered = rows.sortWithinPartitions(*_CHUNK, "timestamp_ms")
    mapped = ordered.mapInArrow(coalesced(_chunk_maps(chunk_ms, spacing, to_arrow_schema(maps))), maps)
    before = arranged(mapped, ["video_id"], ["_chunk"]).mapInArrow(
        coalesced(_compose(spacing, to_arrow_schema(told))), told
    )
    return rows.join(before, _CHUNK).select(*_CHUNK, "timestamp_ms", "_last").sortWithinPartitions(
        *_CHUNK, "timestamp_ms"
    ).mapInArrow(coalesced(_kept(chunk_ms, spacing, to_arrow_schema(out))), out)


def candidate_timestamps(
    videos: DataFrame,
    scenes: DataFrame,
    interval_seconds: float = config.SAMPLE_INTERVAL_SECONDS,
    min_spacing_ms: int = config.MIN_SPACING_MS,
) -> DataFrame:
    """Even grid plus scene changes inside the video, thinned to the spacing."""
    lengths = videos.select("video_id", F.col("duration_ms").alias("_duration"))
    valid = (
        scenes.join(lengths, "video_id")
        .where(
            (F.col("timestamp_ms") >= 0)
            & ((F.col("_duration") <= 0) | (F.col("timestamp_ms") < F.col("_duration")))
        )
        .select("video_id", F.col("timestamp_ms").cast("bigint").alias("timestamp_ms"))
    )
    grid = dense_grid(videos, interval_seconds)
    return min_spacing_filter(grid.unionByName(valid), min_spacing_ms)


def spacing_with_cap(points: DataFrame, max_points: int, near_ms: int = 5_000) -> DataFrame:
    """Drop times within ``near_ms`` (inclusive) of a kept one, then keep the
    first ``max_points`` per video."""
    kept = min_spacing_filter(points, near_ms + 1)
    order = Window.partitionBy("video_id").orderBy("timestamp_ms")
    return (
        kept.withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= max(1, max_points))
        .drop("_n")
    )


def bucket_top_k(
    points: DataFrame, limit: int, k: int = 2, bucket_ms: int = 60_000
) -> DataFrame:
    """Earliest ``k`` distinct times per bucket, then the earliest ``limit`` per
    video. Times outside the video (``duration_ms``, if positive) are left out."""
    inside = points.where(
        (F.col("timestamp_ms") >= 0)
        & ((F.col("duration_ms") <= 0) | (F.col("timestamp_ms") < F.col("duration_ms")))
    )
    distinct = inside.select("video_id", "timestamp_ms").distinct()
    bucket = Window.partitionBy(
        "video_id", F.floor(F.col("timestamp_ms") / bucket_ms)
    ).orderBy("timestamp_ms")
    video = Window.partitionBy("video_id").orderBy("timestamp_ms")
    few = distinct.withColumn("_n", F.row_number().over(bucket)).where(F.col("_n") <= k)
    return (
        few.drop("_n")
        .withColumn("_n", F.row_number().over(video))
        .where(F.col("_n") <= limit)
        .drop("_n")
    )
