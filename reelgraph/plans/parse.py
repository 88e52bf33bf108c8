"""The whole parse of many videos: from frames and sections to ranked evidence."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgraph import config
from reelgraph.operators import dedup, intervals, quality, ranking, scenes, scoring
from reelgraph.session import cut_lineage


class Parsed(NamedTuple):
    members: DataFrame  # duplicate groups of the usable frames per section
    ranked: DataFrame  # kept frames per section with score, evidence and rank
    best: DataFrame  # the one frame shown per section


def parse_videos(
    frames: DataFrame,
    sections: DataFrame,
    features: Callable[[DataFrame], DataFrame],
    graphs: DataFrame,
    detections: DataFrame,
    synonyms: Mapping[str, str] | None = config.LABEL_SYNONYMS,
    pad_ms: int = config.SECTION_PADDING_MS,
    limits: config.DedupLimits = config.DEDUP,
    bucket_ms: int = intervals.BUCKET_MS,
    chunk_ms: int = 6 * 3_600_000,
    counted: DataFrame | None = None,
) -> Parsed:
    """Gate, window, group, score and rank, each step on what the last one kept.

    frames carry their quality measures; sections carry start_ms, end_ms,
    graph_id and frame_type; ``features`` adds histogram and phash to frame
    rows; detections are normalised. Frames without a detector result rank
    behind with score 0. ``counted``: rows with frame_id to count instead of the detections.

    What several steps read is written once: the kept pairs, the detections of their frames
    (others cannot reach a match), and the matches, which ranks read twice.
    """
    gated = quality.with_quality_score(quality.quality_gate(frames))
    usable = gated.where("passed").select("video_id", "frame_id", "timestamp_ms", "quality_score")
    windowed = intervals.frames_in_sections(usable, sections, pad_ms, bucket_ms=bucket_ms)
    members = dedup.near_duplicate_groups(
        features(windowed), limits, chunk_ms=chunk_ms
    )
    kept = members.where("is_representative").select(
        *scoring.PAIR, "timestamp_ms", "quality_score"
    )
    pairs = cut_lineage(kept.join(
        sections.select("video_id", "section_index", "graph_id", "frame_type"),
        ["video_id", "section_index"],
    ))
    shown = cut_lineage(
        detections.join(pairs.select("frame_id"), "frame_id", "left_semi").select("frame_id", *scoring.THING)
    )
    counted = shown if counted is None else counted
    seen = shown.select("frame_id").distinct()
    found = scenes.scene_relations(shown, counted=counted)
    signs = scenes.frame_scenes(
        frames.select("frame_id", "blur_score").join(seen, "frame_id", "left_semi"),
        shown,
        found,
    )
    scored = scoring.match_score(
        pairs, graphs, scenes.fill_image_size(shown), signs, synonyms, counted=counted
    )
    times = pairs.select(*scoring.PAIR, "timestamp_ms").dropDuplicates(list(scoring.PAIR))
    missed = scoring.default_match(pairs, graphs, signs).join(times, list(scoring.PAIR))
    ranked = ranking.rank_frames(cut_lineage(scoring.all_matches(scored, missed)))
    best = ranking.best_frame_per_section(
        ranked.select(
            *scoring.PAIR, "score", F.col("rank").alias("position"),
            F.lit(1).alias("source_priority"),
        )
    )
    return Parsed(members, ranked, best)
