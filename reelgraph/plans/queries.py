"""Registered queries: each runs one operator over the whole bound tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelgraph import config
from reelgraph.functions import geometry, responses, text, vectors
from reelgraph.functions.rows import keep_where
from reelgraph.operators import (
    catalogue,
    dataset,
    dedup,
    documents,
    intervals,
    quality,
    querygraph,
    ranking,
    scenes,
    scoring,
    selection,
    timestamps,
    transcript,
    usage,
)
from reelgraph.plans import bindings as b
from reelgraph.plans import parse
from reelgraph.session import cut_lineage, shared_dir
from reelgraph.sources import artifacts, images, inventory
from reelgraph.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def windowed(spark: SparkSession, sf_dir: str, frames: DataFrame | None = None) -> DataFrame:
    frames = b.frames(spark, sf_dir) if frames is None else frames
    return intervals.frames_in_sections(
        frames.drop("event_type"), b.sections(spark, sf_dir), b.PAD_MS, bucket_ms=b.BUCKET_MS
    )


@query
def best_usable_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: frames in each section's window, gated, scored and ranked."""
    usable = quality.quality_gate(b.frames(spark, sf_dir)).where("passed")
    scored = quality.with_quality_score(windowed(spark, sf_dir, usable), "score")
    ranked = ranking.rank_frames(scored)
    return ranked.select(
        "video_id", "section_index", "frame_id", "timestamp_ms",
        F.round("score", 6).alias("score"), "rank",
    )


@query
def frames_in_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed(spark, sf_dir).select(
        "video_id", "section_index", "frame_id", "window_start_ms", "window_end_ms"
    )


@query
def frames_in_sections_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.frames_in_sections_strict(
        b.frames(spark, sf_dir), b.sections(spark, sf_dir), b.BUCKET_MS
    ).select("video_id", "section_index", "frame_id")


@query
def relevant_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = b.frames(spark, sf_dir).select("video_id", "frame_id", "timestamp_ms")
    return intervals.relevant_frames(
        frames, b.sections(spark, sf_dir), b.PAD_MS, bucket_ms=b.BUCKET_MS
    )


@query
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = quality.with_quality_score(quality.quality_gate(b.frames(spark, sf_dir)))
    return gated.select(
        "video_id", "frame_id", F.array_join("failures", ", ").alias("failures"), "passed",
        F.round("quality_score", 6).alias("quality_score"), "quality_reason",
    )


def members_of(spark: SparkSession, sf_dir: str, inside: DataFrame) -> DataFrame:
    """Duplicate groups of the passed frames among gated and windowed ones."""
    passed = inside.where("passed").drop("passed", "failures", "quality_reason")
    return dedup.near_duplicate_groups(b.features(spark, sf_dir, passed), b.DEDUP, chunk_ms=b.CHUNK_MS)


def usable_features(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """Passed frames per section with the features duplicates are judged by."""
    passed = quality.with_quality_score(
        quality.quality_gate(b.frames(spark, sf_dir)).where("passed")
    ).select("video_id", "frame_id", "timestamp_ms", "quality_score", "event_type")
    return b.features(spark, sf_dir, windowed(spark, sf_dir, passed), *names)


@query
def duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = dedup.duplicate_pairs(
        usable_features(spark, sf_dir, "phash"), b.DEDUP,
        histograms=lambda rows: b.features(spark, sf_dir, rows, "histogram"),
    )
    return pairs.withColumn("hash_distance", F.col("hash_distance").cast("bigint")).withColumn(
        "correlation", F.round("correlation", 6)
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicate_groups(usable_features(spark, sf_dir), b.DEDUP, chunk_ms=b.CHUNK_MS)


@query
def near_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return members(spark, sf_dir).drop("timestamp_ms", "quality_score")


@query
def dedup_frame_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup_frame_report(members(spark, sf_dir)).withColumn(
        "quality_score", F.round("quality_score", 6)
    )


@query
def dedup_group_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup_group_report(members(spark, sf_dir)).withColumn(
        "frame_ids", F.array_join(F.col("frame_ids").cast("array<string>"), ",")
    )


def with_score(rows: DataFrame) -> DataFrame:
    score = ((F.col("frame_id") * 31 + F.col("section_index") * 17) % 1000) / 1000.0
    return rows.select("video_id", "section_index", "frame_id", "timestamp_ms", score.alias("score"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_score(windowed(spark, sf_dir))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, s, v = F.col("frame_id"), F.col("section_index"), F.col("video_id")
    return windowed(spark, sf_dir).select(
        "video_id",
        "section_index",
        f.alias("position"),
        F.when(f % 5 > 0, f).alias("frame_id"),
        F.when(f % 10 > 0, F.concat(F.lit("k"), (f % 50).cast("string"))).alias("object_key"),
        F.when(f % 3 > 0, F.concat(F.lit("u"), (f % 20).cast("string"))).alias("url"),
        F.when(f % 11 > 0, ((f * 31 + s * 17) % 100) / 100.0).alias("score"),
        F.when(s % 2 == 0, (f * 7 + v) % 3 + 1).otherwise((f * 7 + v) % 2 + 2).alias(
            "source_priority"
        ),
    )


@query
def rank_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank_frames(scored(spark, sf_dir)).drop("timestamp_ms")


@query
def best_section_per_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.best_section_per_frame(scored(spark, sf_dir)).drop("timestamp_ms")


@query
def best_frame_per_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.best_frame_per_section(candidates(spark, sf_dir))


@query
def distinct_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.distinct_keep_first(
        candidates(spark, sf_dir), ranking.SECTION, "position"
    ).drop("score", "source_priority")


@query
def top_n_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        ranking.top_n_display(scored(spark, sf_dir))
        .drop("timestamp_ms")
        .withColumn("rank", F.col("rank").cast("bigint"))
    )


@query
def top_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_matches(candidates(spark, sf_dir)).withColumn(
        "rank", F.col("rank").cast("bigint")
    )


@query
def find_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = candidates(spark, sf_dir)
    target = ranking.first_row(listed, ranking.SECTION, -F.col("position"))
    found = ranking.find_frame(listed, target.drop("position", "score", "source_priority"))
    return found.select("video_id", "section_index", F.col("position").alias("found_position"))


@query
def resolve_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames meet their sections once; what was outside and what was a duplicate follow."""
    frames = b.frames(spark, sf_dir)
    gated = quality.with_quality_score(quality.quality_gate(frames)).select(
        "video_id", "frame_id", "timestamp_ms", "quality_score", "event_type", "passed", "quality_reason"
    )
    inside = cut_lineage(windowed(spark, sf_dir, gated))
    evaluated = inside.select("video_id", "frame_id", "passed", "quality_reason").distinct()
    report = dedup.dedup_frame_report(members_of(spark, sf_dir, inside))
    kept = report.where(F.col("dedup_status") == "kept").select(
        "video_id", "section_index", "frame_id"
    )
    score = ((F.col("frame_id") * 31 + F.col("section_index") * 17) % 1000) / 1000.0
    best = ranking.best_section_per_frame(kept.withColumn("score", score))
    return selection.resolve_selection(
        frames.select("video_id", "frame_id"), evaluated, report, best
    ).withColumn("duplicate_sections", F.col("duplicate_sections").cast("bigint"))


@query
def dense_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamps.dense_grid(b.videos_with_duration(spark, sf_dir))


@query
def timeline_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamps.timeline_grid(b.videos_with_duration(spark, sf_dir), 3)


@query
def scene_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamps.scene_changes(b.scene_scores(spark, sf_dir))


@query
def min_spacing_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamps.min_spacing_filter(b.scene_points(spark, sf_dir), 5_000)


@query
def candidate_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamps.candidate_timestamps(
        b.videos_with_duration(spark, sf_dir), b.scene_points(spark, sf_dir)
    )


@query
def spacing_with_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamps.spacing_with_cap(b.scene_points(spark, sf_dir), 4)


@query
def bucket_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamps.bucket_top_k(b.long_scene_points(spark, sf_dir), 5)


@query
def segments_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    sentences = b.sentences(spark, sf_dir)
    windows = sentences.select(
        "video_id",
        F.col("sentence_index").alias("section_index"),
        (F.col("start_seconds") - 5).alias("start_seconds"),
        (F.col("end_seconds") + 12).alias("end_seconds"),
    )
    return intervals.segments_overlapping(
        sentences, windows.where(F.col("end_seconds") >= F.col("start_seconds")), 30.0
    ).select("video_id", "section_index", "sentence_index")


@query
def catalogue_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalogue.catalogue_filter(b.catalogue(spark, sf_dir), " P_1", "completed")
    return found.select("id", "title", "filename", "status")


@query
def page_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.page_info(b.catalogue(spark, sf_dir), 10**6, 20)


@query
def catalogue_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.catalogue_page(b.catalogue(spark, sf_dir), 3, 20, "low")[0]


@query
def catalogue_page_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last page, found through day counts."""
    return catalogue.catalogue_page(
        b.catalogue(spark, sf_dir), 10**6, 7, status="failed", sort="asc", shallow_rows=100
    )[0]


@query
def recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.recent(b.catalogue(spark, sf_dir))


@query
def public_job_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = b.catalogue(spark, sf_dir).withColumn(
        "error_message", F.when(F.col("id") % 2 == 0, F.concat(F.lit("trace "), F.col("title")))
    )
    return catalogue.public_job_view(jobs)


@query
def frame_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.frame_view(b.stored_frames(spark, sf_dir)).withColumn(
        "timestamp_seconds", F.round("timestamp_seconds", 3)
    )


@query
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = b.table(spark, sf_dir, "customer").where(F.col("c_custkey") % 9 == 0)
    return catalogue.latest_state(
        b.job_events(spark, sf_dir), gone.select(F.col("c_custkey").alias("id")), b.EVENT_TERMINAL
    )[0]


@query
def apply_job_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.apply_job_updates(
        b.customer_jobs(spark, sf_dir), b.field_updates(spark, sf_dir)
    )


@query
def unknown_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates set aside because no video has their id; every fifth video is unknown."""
    known = b.customer_jobs(spark, sf_dir).where(F.col("id") % 5 > 0)
    odd = catalogue.unknown_updates(known, b.field_updates(spark, sf_dir))
    return odd.select("id", "seq", "status", "reason")


@query
def job_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which jobs may be deleted, and which may be parsed again."""
    return b.catalogue(spark, sf_dir).select(
        "id", catalogue.deletable("status").alias("deletable"), catalogue.parseable("status").alias("parseable")
    )


@query
def fail_interrupted(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit(b.ORIGIN_MS).cast("bigint")
    return catalogue.fail_interrupted(b.catalogue(spark, sf_dir), now)


def _purge_inputs(spark: SparkSession, sf_dir: str):
    requested = b.table(spark, sf_dir, "customer").select(
        F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit("../"), F.col("c_custkey")))
        .otherwise((F.col("c_custkey") * 12).cast("string"))
        .alias("id")
    )
    return b.catalogue(spark, sf_dir), b.stored_frames(spark, sf_dir), requested


@query
def purge_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    videos, frames, _ = catalogue.purge_videos(*_purge_inputs(spark, sf_dir))
    kept = frames.groupBy(F.col("video_id").alias("id")).agg(F.count("*").alias("frames"))
    return videos.join(kept, "id", "left").select(
        "id", "status", F.coalesce("frames", F.lit(0)).cast("bigint").alias("frames")
    )


@query
def purge_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.purge_videos(*_purge_inputs(spark, sf_dir))[2]


@query
def buckets_to_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    videos = b.catalogue(spark, sf_dir).select(
        "id",
        F.concat(F.lit("src-"), F.col("title")).alias("source_bucket"),
        F.when(F.col("id") % 2 == 0, F.lit("main")).otherwise(F.lit("")).alias(
            "analysis_video_bucket"
        ),
    )
    return catalogue.buckets_to_clean(videos, b.stored_frames(spark, sf_dir), "main")


@query
def usage_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.usage_calls(spark, sf_dir).select("id", *[
        c.alias(n) for n, c in usage.usage_tokens("response").items()
    ])


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = b.usage_calls(spark, sf_dir).withColumn(
        "response_model", F.coalesce(F.get_json_object("response", "$.model"), F.lit(""))
    )
    named = usage.classify_calls(calls).withColumns(usage.usage_tokens("response"))
    # A model call names the first parse of its own video as its parent.
    first = (
        named.where(F.col("interface_type") == "background")
        .groupBy(F.col("video_id").cast("string").alias("_asked_by"))
        .agg(F.min_by("id", "created_at").alias("parent_call_id"))
    )
    return named.join(first, "_asked_by", "left").drop("_asked_by", "response", "mode")


@query
def classify_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).select("id", "feature_name", "model", "parent_call_id")


@query
def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.usage_rollup(ledger(spark, sf_dir)).select(
        "id", "video_id", "feature_name", "prompt_tokens", "completion_tokens", "total_tokens"
    )


@query
def usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = usage.usage_summary(usage.usage_rollup(ledger(spark, sf_dir)))
    return summary.select(
        "id", "video_id", "feature_name", "model", "total_tokens", "status", "status_label"
    )


@query
def usage_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = usage.usage_summary(usage.usage_rollup(ledger(spark, sf_dir)))
    return usage.usage_total(usage.usage_search(summary, model="SAM2", status="completed"))


@query
def extract_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.extract_sentences(b.speech_responses(spark, sf_dir))[0]


@query
def rejected_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.extract_sentences(b.speech_responses(spark, sf_dir))[1]


@query
def asr_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    spoken = responses.asr_text("response")
    return b.speech_responses(spark, sf_dir).select(
        "video_id", F.md5(spoken).alias("text_md5"), F.length(spoken).cast("bigint").alias("chars")
    )


@query
def model_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = responses.model_json(b.chat_answers(spark, sf_dir), "content")
    read = good.select(
        "video_id",
        F.lit("ok").alias("outcome"),
        F.get_json_object("json", "$.title").alias("title"),
        F.length(F.get_json_object("json", "$.text")).cast("bigint").alias("chars"),
    )
    return read.unionByName(
        bad.select(
            "video_id", F.col("reason").alias("outcome"), F.lit(None).cast("string").alias("title"),
            F.lit(None).cast("bigint").alias("chars"),
        )
    )


@query
def validate_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.validate_sections(b.raw_sections(spark, sf_dir), b.sentences(spark, sf_dir))[1]


@query
def valid_section_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    sentences = b.sentences(spark, sf_dir)
    good, _ = transcript.validate_sections(b.raw_sections(spark, sf_dir), sentences)
    ranges = transcript.section_ranges(good, sentences)
    return ranges.select(
        "video_id", "section_index", F.round("start_seconds", 6).alias("start_seconds"),
        F.round("end_seconds", 6).alias("end_seconds"),
    )


@query
def section_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.section_texts(b.raw_sections(spark, sf_dir), b.sentences(spark, sf_dir))


@query
def repair_section_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = b.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("video_id"), F.col("turn").alias("section_index"),
        (F.col("turn") * 7.0).alias("start_seconds"),
        (F.col("turn") * 7.0 + F.length("text") % 40 - 5).alias("end_seconds"),
        (F.col("conv_id") % 3 * 30.0).alias("duration_seconds"),
    )
    return transcript.repair_section_ranges(sections)


@query
def model_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = transcript.extract_sentences(b.speech_responses(spark, sf_dir))[0]
    context = transcript.model_context(lines, 2_000)
    return context.select(
        "video_id", F.md5("context").alias("context_md5"),
        F.length("context").cast("bigint").alias("chars"), "whole_chars",
    )


def checked_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return querygraph.validate_query_graphs(b.graph_answers(spark, sf_dir), "graph")


@query
def validate_query_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked_graphs(spark, sf_dir).select(
        "graph_id", "reason", F.array_join(querygraph.graph_terms("nodes"), "|").alias("terms")
    )


@query
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return querygraph.graph_nodes(checked_graphs(spark, sf_dir), "graph_id").withColumn(
        "node_no", F.col("node_no").cast("bigint")
    )


@query
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return querygraph.graph_edges(checked_graphs(spark, sf_dir), "graph_id").withColumn(
        "edge_no", F.col("edge_no").cast("bigint")
    )


@query
def retry_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = keep_where(checked_graphs(spark, sf_dir), F.col("reason").isNotNull())
    return transcript.retry_set(bad.select("graph_id", "attempt", "reason")).withColumn(
        "attempt", F.col("attempt").cast("bigint")
    )


@query
def query_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = querygraph.query_spec(b.titled_sections(spark, sf_dir))
    return spec.select(
        "video_id", "frame_type", "target",
        F.array_join("graph_terms", "|").alias("graph_terms"),
        F.md5(F.array_join("query_terms", "|")).alias("query_terms_md5"),
        F.size("query_terms").cast("bigint").alias("query_terms"),
        F.array_join("expected_signals", "|").alias("expected_signals"),
    )


@query
def label_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label and id normalisers over part names joined with their types."""
    raw = F.concat(F.lit("  "), F.upper("p_name"), F.lit("--/"), F.col("p_type"), F.lit("_  "))
    return b.table(spark, sf_dir, "part").select(
        "p_partkey",
        text.normalize_label_plain(raw).alias("label"),
        text.normalize_label("p_name", b.SYNONYMS).alias("synonym"),
        text.normalize_id(raw).alias("graph_id"),
        text.safe_filename(F.concat(raw, F.lit(".PNG")), F.col("p_partkey")).alias("file_name"),
    )


@query
def time_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds read from numbers, clocks and text, and written back."""
    raw = (
        F.when(F.col("o_orderkey") % 4 == 0, F.col("o_totalprice").cast("string"))
        .when(F.col("o_orderkey") % 4 == 1, F.concat_ws(
            ":", (F.col("o_orderkey") % 3).cast("string"), (F.col("o_custkey") % 60).cast("string"),
            (F.col("o_orderkey") % 50).cast("string")))
        .when(F.col("o_orderkey") % 4 == 2, F.lit("n/a"))
        .otherwise(F.concat(F.lit(" "), (F.col("o_orderkey") % 100).cast("string")))
    )
    seconds = text.parse_seconds(raw, F.col("o_orderkey") % 8 == 0)
    name = F.concat(F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), F.when(
        F.col("o_orderkey") % 2 == 0, F.lit(".jpg")).otherwise(F.lit("x.jpg")))
    return b.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.round(seconds, 6).alias("seconds"),
        text.format_timestamp(F.floor(seconds) + 0.5).alias("clock"),
        text.format_duration(F.floor(seconds) * 1000 - 5000).alias("duration"),
        text.frame_timestamp_from_name(name).alias("frame_ms"),
    )


@query
def clipped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents: whitespace collapsed, clipped, summarised, escaped."""
    return b.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.md5(text.collapse_ws("text")).alias("collapsed_md5"),
        F.md5(text.clip_text("text", 500)).alias("clipped_md5"),
        F.length(text.summarize("text", 100)).cast("bigint").alias("summary_chars"),
        F.md5(text.yaml_escape("text")).alias("escaped_md5"),
    )


@query
def object_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = b.table(spark, sf_dir, "pages").select(
        F.col("url").alias("object_key"), F.encode("html", "UTF-8").alias("content")
    )
    return inventory.object_inventory(pages)


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[
        F.round(f.name, places).alias(f.name) if f.dataType.simpleString() == "double"
        else F.col(f.name).cast("bigint").alias(f.name) if f.dataType.simpleString() == "int"
        else F.array_join(f.name, "|").alias(f.name) if f.dataType.simpleString() == "array<string>"
        else F.col(f.name)
        for f in df.schema
    ])


@query
def normalize_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(b.detections(spark, sf_dir).drop("width", "height"))


@query
def mask_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = scenes.mask_metrics(b.masked_detections(spark, sf_dir), b.mask_pixels(spark, sf_dir))
    return _rounded(
        scenes.normalize_detections(masked, b.SYNONYMS).select(
            "frame_id", "det_no", "label", *scenes.MASK_BOX, "area", "centroid_x", "centroid_y",
            "touches_border",
        )
    )


@query
def object_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box measures of every detection, and its quality per frame type."""
    rows = b.detections(spark, sf_dir)
    center = geometry.image_center_distance(
        F.col("centroid_x"), F.col("centroid_y"), F.col("width"), F.col("height")
    )
    kinds = {
        f"quality_{k}": geometry.object_quality(
            F.col("confidence"), F.col("area"), center, F.col("touches_border"),
            geometry.ideal_area(F.lit(k)),
        )
        for k in ("operation_frame", "alignment_frame", "other")
    }
    return _rounded(
        rows.withColumns(kinds).withColumn("center_distance", center).select(
            "frame_id", "det_no", "center_distance", *kinds
        ),
        9,
    )


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes.scene_relations(
        b.detections(spark, sf_dir), counted=b.detection_keys(spark, sf_dir)
    )


@query
def scene_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations(spark, sf_dir).withColumn("relation_no", F.col("relation_no").cast("bigint"))


@query
def image_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes per frame where a quarter of the images lacks a width, another a height."""
    f = F.col("frame_id")
    raw = b.raw_detections(spark, sf_dir).withColumns({
        "width": F.when(f % 4 != 0, F.col("width")), "height": F.when(f % 4 == 1, F.lit(0)).otherwise(F.col("height")),
    })
    sized = scenes.fill_image_size(scenes.normalize_detections(raw, b.SYNONYMS))
    return sized.groupBy("frame_id").agg(
        F.max("width").cast("bigint").alias("width"), F.max("height").cast("bigint").alias("height"),
        F.count(F.lit(1)).alias("detections"),
    )


def order_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes.frame_scenes(
        b.order_frames(spark, sf_dir), b.detections(spark, sf_dir), relations(spark, sf_dir)
    )


@query
def frame_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = scenes.signal_map(order_scenes(spark, sf_dir))
    shown = F.array_sort(F.map_keys(F.map_filter("signals", lambda k, v: v)))
    return mapped.select(
        "frame_id", F.array_join(shown, "|").alias("signals"),
        F.size("signals").cast("bigint").alias("known"),
    )


@query
def match_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.match_nodes(
        b.scoring_pairs(spark, sf_dir), b.brand_graphs(spark, sf_dir),
        b.detections(spark, sf_dir), b.SYNONYMS, counted=b.detection_keys(spark, sf_dir),
    )
    return _rounded(
        rows.select(
            *scoring.PAIR, "node_no", F.col("node.label").alias("node_label"),
            F.col("object.label").alias("object_label"), F.col("object.det_no").alias("det_no"),
            "node_score",
        )
    )


def scored_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.match_score(
        b.scoring_pairs(spark, sf_dir), b.brand_graphs(spark, sf_dir), b.detections(spark, sf_dir),
        order_scenes(spark, sf_dir), b.SYNONYMS, counted=b.detection_keys(spark, sf_dir),
    )


@query
def match_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scored_matches(spark, sf_dir), 9)


@query
def default_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(
        scoring.default_match(
            b.scoring_pairs(spark, sf_dir), b.brand_graphs(spark, sf_dir),
            b.order_frames(spark, sf_dir),
        )
    )


@query
def slim_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidates(spark, sf_dir).withColumn(
        "caption", F.when(F.col("position") % 2 == 0, F.lit("seen"))
    )
    slim = documents.slim_frames(rows)
    return slim.groupBy("video_id", "section_index").agg(
        F.count("*").alias("frames"), F.count("id").alias("with_id"),
        F.count_if(F.col("caption") == config.DEFAULT_CAPTION).alias("default_captions"),
    )


@query
def attach_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = candidates(spark, sf_dir).select(
        "video_id", "section_index", "position", F.col("frame_id").alias("business_frame_id")
    )
    return documents.attach_report(b.sections(spark, sf_dir), report)


@query
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = members(spark, sf_dir).where("is_representative")
    told = b.sections(spark, sf_dir).withColumn(
        "graph_id", F.when(F.col("section_index") % 2 == 0, F.col("section_index"))
    )
    return documents.run_summary(b.frames(spark, sf_dir), kept, told)


@query
def render_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.render_transcript(
        b.document_sections(spark, sf_dir), b.document_videos(spark, sf_dir)
    )


@query
def render_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.render_markdown(
        b.document_sections(spark, sf_dir), b.document_videos(spark, sf_dir)
    )


@query
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = b.document_sections(spark, sf_dir).where(F.col("object_key").isNotNull())
    return documents.unique_names(
        entries.select("video_id", "object_key", (F.col("section_index") - 1).alias("position"))
    )


@query
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = b.document_sections(spark, sf_dir)
    stored = sections.where(F.col("section_index") % 2 == 0).select("object_key")
    whole = documents.manifest(sections, b.document_videos(spark, sf_dir), stored)
    entry = F.explode(F.from_json(
        F.get_json_object("manifest", "$.sections"),
        "array<struct<index:bigint,title:string,start_time:string,"
        "business_frame:struct<timestamp:string,score:double,path:string>>>",
    )).alias("s")
    return whole.select(
        "video_id", F.get_json_object("manifest", "$.filename").alias("filename"), entry
    ).select(
        "video_id", "filename", F.col("s.index").alias("section_index"), "s.title",
        "s.start_time", F.col("s.business_frame.timestamp").alias("timestamp"),
        F.col("s.business_frame.score").alias("score"), F.col("s.business_frame.path").alias("path"),
    )


@query
def semantic_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames meet their sections once; status, matches and windows all follow from that."""
    gated = quality.with_quality_score(quality.quality_gate(b.frames(spark, sf_dir))).select(
        "video_id", "frame_id", "timestamp_ms", "quality_score", "event_type", "passed"
    )
    rows = cut_lineage(windowed(spark, sf_dir, gated).select(
        "video_id", "section_index", "frame_id", "timestamp_ms", "quality_score", "passed",
        "window_start_ms", "window_end_ms",
    ))
    windows = rows.select(
        "video_id", "section_index", "window_start_ms", "window_end_ms"
    ).distinct()
    status = dedup.dedup_frame_report(members_of(spark, sf_dir, rows)).select(
        "video_id", "section_index", "frame_id", F.col("dedup_status").alias("filter_status")
    )
    raw = rows.select("video_id", "section_index", "frame_id", "timestamp_ms").join(
        status, ["video_id", "section_index", "frame_id"], "left"
    )
    ranked = ranking.rank_frames(with_score(rows))
    return documents.semantic_report(windows, raw, ranked, 5 * b.DAY_MS)


@query
def output_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = documents.transcript_lineage()
    return b.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("video_id"), artifacts.artifact_key("transcript_tree", "doc_id")
        .alias("object_key"), stamp.alias("generation"),
    )


@query
def parse_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document texts as stored JSON, every seventh cut short, every ninth empty."""
    body = F.to_json(F.struct(F.col("lang").alias("title"), F.col("text").alias("text")))
    stored = b.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("video_id"),
        F.when(F.col("doc_id") % 9 == 0, F.lit(" "))
        .when(F.col("doc_id") % 7 == 0, F.expr("substring(to_json(struct(text)), 1, 9)"))
        .otherwise(body)
        .alias("value"),
    )
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "text")])
    good, bad = artifacts.parse_artifacts(stored, schema)
    return good.select(
        "video_id", "title", F.md5("text").alias("text_md5"),
        F.lit(None).cast("string").alias("reason"),
    ).unionByName(bad, allowMissingColumns=True)


@query
def pair_images_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, missing = dataset.pair_images_labels(
        b.dataset_images(spark, sf_dir), b.dataset_labels(spark, sf_dir)
    )
    return pairs.select("stem", F.lit(True).alias("paired")).unionByName(
        missing.select("stem", F.lit(False).alias("paired"))
    )


def split_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, _ = dataset.pair_images_labels(
        b.dataset_images(spark, sf_dir), b.dataset_labels(spark, sf_dir)
    )
    return dataset.seeded_split(pairs, 0.2, 42)


@query
def seeded_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_pairs(spark, sf_dir).select("stem", "split")


def class_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of a nation as its class file, every sixth line blank."""
    lines = b.table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("dataset"),
        F.col("s_suppkey").alias("line_no"),
        F.when(F.col("s_suppkey") % 6 > 0, F.concat(F.lit(" "), F.lower("s_name")))
        .otherwise(F.lit("  ")).alias("text"),
    )
    return dataset.class_list(lines)


@query
def class_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_rows(spark, sf_dir)


@query
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.split_summary(split_pairs(spark, sf_dir), class_rows(spark, sf_dir))


@query
def data_yaml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.data_yaml(class_rows(spark, sf_dir), "/data/export")


@query
def validate_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, missing = dataset.pair_images_labels(
        b.dataset_images(spark, sf_dir), b.dataset_labels(spark, sf_dir)
    )
    return dataset.validate_labels(
        b.label_lines(spark, sf_dir), 2, split_pairs(spark, sf_dir), missing
    ).withColumn("line_no", F.col("line_no").cast("bigint"))


@query
def image_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = images.image_features(b.pixel_images(spark, sf_dir))
    return _rounded(measured.select(
        "vec_id", "image_width", "blur_score", "mean_brightness", "dark_ratio", "bright_ratio",
        "center_contrast", F.element_at("histogram", 2).alias("histogram_2"),
        F.element_at("histogram", 3).alias("histogram_3"), F.size("histogram").alias("bins"),
    ))


@query
def image_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = images.image_features(b.pixel_images(spark, sf_dir))
    return measured.select("vec_id", "phash", F.size("histogram").alias("bins"))


@query
def phash_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "embeddings").select(
        "vec_id", vectors.pack64(F.col("embedding")).alias("phash")
    )


def _run_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/reelgraph-{name}-{uuid.uuid4().hex}"


#: The parts in which a table arrives at a stream; the last one is a replay.
ARRIVALS = (2, 0, 1, 0)


def _arrivals(spark: SparkSession, table: DataFrame, number: str, folder: str):
    """Append every part of a table to ``folder`` and give the stream over it, part by part.

    Parts are dealt by ``number`` (modulo 7, then 3), so times, ids and numbers of
    different parts mix, and later parts hold earlier rows.
    """
    for part in ARRIVALS:
        table.where(F.col(number) % 7 % 3 == part).write.mode("append").parquet(folder)
        yield spark.readStream.schema(table.schema).parquet(folder)


@query
def latest_state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job states over batches out of order, with a replay and deleted ids."""
    root = _run_dir(spark, "state")
    gone = b.table(spark, sf_dir, "customer").where(F.col("c_custkey") % 9 == 0)
    gone = gone.select(F.col("c_custkey").alias("id"))
    tombstones = _arrivals(spark, gone, "id", f"{root}/gone")
    events = b.table(spark, sf_dir, "events")
    for arrived, deleted in zip(_arrivals(spark, events, "event_id", f"{root}/in"), tombstones):
        jobs.latest_state_stream(
            b.as_job_events(arrived), f"{root}/out", f"{root}/checkpoint", b.EVENT_TERMINAL, deleted, 2
        ).awaitTermination()
    return jobs.current_state(spark, f"{root}/out")


@query
def quarantined_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates without a usable time, set aside by a stream of its own."""
    root = _run_dir(spark, "odd")
    events = b.table(spark, sf_dir, "events")
    for arrived in _arrivals(spark, events, "event_id", f"{root}/in"):
        jobs.quarantine_stream(b.as_job_events(arrived), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query
def intake_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads judged over several batches; ids taken by one are refused to the next."""
    root = _run_dir(spark, "intake")
    events = b.table(spark, sf_dir, "events")
    for arrived in _arrivals(spark, events, "event_id", f"{root}/in"):
        jobs.intake_stream(
            b.media_arrivals(arrived), f"{root}/out", f"{root}/checkpoint", b.MAX_BYTES
        ).awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query
def parse_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole parse: events as frames, line items as their detections."""
    kinds = F.array(*[F.lit(t) for t in b.FRAME_TYPES])
    told = b.sections(spark, sf_dir).withColumns({
        "graph_id": F.concat(
            F.lit("Brand#"), ((F.col("video_id") + F.col("section_index")) % 25 + 1).cast("string")
        ),
        "frame_type": F.element_at(kinds, (F.col("section_index") % 6 + 1).cast("int")),
    })
    parsed = parse.parse_videos(
        b.frames(spark, sf_dir).drop("event_type"), told,
        lambda rows: b.features(spark, sf_dir, rows), b.brand_graphs(spark, sf_dir),
        b.detections(spark, sf_dir), b.SYNONYMS, b.PAD_MS, b.DEDUP, b.BUCKET_MS, b.CHUNK_MS,
        b.detection_keys(spark, sf_dir),
    )
    return _rounded(parsed.ranked.select(
        *scoring.PAIR, "graph_id", "score", "rank", "matched", "missing", "negative_hits"
    ), 6)


@query
def replaced_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame table written, then partly replaced: some videos anew, some cleared."""
    path = f"{_run_dir(spark, 'frames')}/frames"
    stored = b.frames(spark, sf_dir).select("video_id", "frame_id", "timestamp_ms")
    artifacts.replace_frames(spark, stored, path)
    fresh = stored.where("video_id % 3 = 0 AND video_id % 7 > 0 AND frame_id % 2 = 0")
    told = stored.where("video_id % 3 = 0 OR video_id % 7 = 0").select("video_id").distinct()
    artifacts.replace_frames(spark, fresh, path, videos=told)
    return spark.read.parquet(path).select("video_id", "frame_id", "timestamp_ms")


@query
def artifact_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as artifacts of a kind and read back."""
    path = _run_dir(spark, "artifacts")
    docs = b.table(spark, sf_dir, "documents")
    tree = docs.select(F.col("doc_id").alias("video_id"), "lang", "text")
    artifacts.write_artifacts(tree, path, "transcript_tree")
    read = spark.read.schema(tree.schema).json(f"{path}/kind=transcript_tree")
    return read.select("video_id", "lang", F.md5("text").alias("text_md5"))
