"""Sentences and sections: extraction, validation, ranges and model context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgraph import config
from reelgraph.functions import responses as r
from reelgraph.functions import text
from reelgraph.functions.rows import bind, keep_where
from reelgraph.operators.skew import offset_and_total, ordered_parts, previous_and_running_max

SECTION = ("video_id", "section_index")


def _seconds(value: Column) -> Column:
    """Seconds of a JSON value; NULL where it is missing or unreadable."""
    given = F.struct(value.cast("string").alias("t"), r.kind(value).alias("k"))
    return bind(given, lambda g: text.parse_seconds(g["t"], g["k"] == "number"))


def _sentence(item: Column) -> Column:
    words = text.first_filled(*[r.text_field(item, n) for n in ("text", "transcript", "sentence")])
    read = F.struct(
        F.coalesce(text.strip(words), F.lit("")).alias("text"),
        _seconds(r.first_present(item, ("start", "start_seconds", "begin"))).alias("start"),
        _seconds(r.first_present(item, ("end", "end_seconds", "finish"))).alias("end"),
    )

    def paired(s: Column) -> Column:
        pair = [_seconds(F.try_variant_get(item, f"$.timestamp[{i}]", "variant")) for i in (0, 1)]
        # Without a start of its own a sentence takes both ends from the pair.
        both = F.struct(s["text"].alias("text"), pair[0].alias("start"), pair[1].alias("end"))
        has_pair = F.try_variant_get(item, "$.timestamp[1]", "variant").isNotNull()
        return F.when(s["start"].isNull() & has_pair, both).otherwise(s)

    return bind(read, paired)


def extract_sentences(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sentences, rejected videos with a reason).

    responses: video_id, response (JSON text), duration_ms. All work happens
    inside the row of a response, so nothing is shuffled.
    """
    duration = F.round(F.coalesce(F.col("duration_ms"), F.lit(0)) / 1000.0, 3)
    kept = F.filter(F.transform(F.col("_items"), _sentence), lambda s: s["text"] != "")

    def timed(s: Column) -> Column:
        start = F.greatest(F.lit(0.0), s["start"])
        end = F.greatest(F.lit(0.0), s["end"])
        return F.struct(
            s["text"].alias("text"),
            text.clamp_seconds(start, F.col("_duration")).alias("start"),
            text.clamp_seconds(end, F.col("_duration")).alias("end"),
        )

    reason = (
        F.when(F.coalesce(F.size("_items"), F.lit(0)) <= 0, F.lit("no_sentence_timestamps"))
        .when(
            F.exists("_kept", lambda s: s["start"].isNull() | s["end"].isNull()),
            F.lit("missing_timestamps"),
        )
        .when(F.size("_kept") == 0, F.lit("no_usable_sentences"))
        .when(F.exists("_timed", lambda s: s["end"] <= s["start"]), F.lit("end_not_after_start"))
    )
    read = (
        responses.select("video_id", "response", duration.alias("_duration"))
        .withColumn("_items", r.items(F.try_parse_json("response"), "sentences"))
        .withColumn("_kept", kept)
        .withColumn("_timed", F.transform("_kept", timed))
        .withColumn("reason", reason)
    )
    good = (
        read.select(
            "video_id",
            # An empty array gives no rows; a filter would repeat the parsing.
            F.posexplode(F.when(F.col("reason").isNull(), F.col("_timed"))).alias(
                "sentence_index", "s"
            ),
        )
        .select(
            "video_id",
            F.col("sentence_index").cast("bigint").alias("sentence_index"),
            F.round("s.start", 3).alias("start_seconds"),
            F.round("s.end", 3).alias("end_seconds"),
            F.col("s.text").alias("text"),
        )
    )
    bad = keep_where(read, F.col("reason").isNotNull())
    return good, bad.select("video_id", "reason")


def sentences_of_sections(sections: DataFrame, sentences: DataFrame) -> DataFrame:
    """One row per (section, known sentence), with its place in the section."""
    listed = sections.select(
        *SECTION,
        F.posexplode(F.array_sort(F.array_distinct("source_indices"))).alias(
            "place", "sentence_index"
        ),
    )
    return listed.withColumn("sentence_index", F.col("sentence_index").cast("bigint")).join(
        sentences, ["video_id", "sentence_index"]
    )


def section_ranges(sections: DataFrame, sentences: DataFrame) -> DataFrame:
    """Earliest start and latest end of each section's sentences."""
    return (
        sentences_of_sections(sections, sentences)
        .groupBy(*SECTION)
        .agg(
            F.min("start_seconds").alias("start_seconds"),
            F.max("end_seconds").alias("end_seconds"),
        )
    )


def section_texts(
    sections: DataFrame, sentences: DataFrame, part_rows: int = config.PART_ROWS
) -> DataFrame:
    """Text of each section's sentences in order, in parts (see ``ordered_parts``).

    A part after the first begins with the separator, so parts concatenate to the whole.
    """
    rows = sentences_of_sections(sections, sentences).withColumn(
        "text", text.collapse_ws("text")
    )
    parts = ordered_parts(
        rows.where(F.col("text") != ""), SECTION, "place", F.col("text"), " ", "text", part_rows
    )
    first = F.min("part_no").over(Window.partitionBy(*SECTION))
    return parts.withColumn("_first", first).withColumn(
        "text", F.when(F.col("part_no") > F.col("_first"), F.concat(F.lit(" "), "text")).otherwise(F.col("text"))
    ).drop("_first")


def validate_sections(
    sections: DataFrame, sentences: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(sections of faultless videos, violations: video_id, section_index, reason).

    sections: video_id, section_index, title, source_indices, polished_text,
    business_frame_text. A video with any violation is held back whole; a
    violation of the video as such has a NULL section.
    """
    distinct = F.array_distinct("source_indices")
    count = F.coalesce(F.size(distinct), F.lit(0))
    checked = sections.withColumn(
        "_reasons",
        F.array_compact(
            F.array(
                F.when(count <= 0, F.lit("no_source_indices")),
                F.when(
                    F.array_max(distinct) - F.array_min(distinct) + 1 != count,
                    F.lit("indices_not_contiguous"),
                ),
                F.when(text.collapse_ws("polished_text") == "", F.lit("no_polished_text")),
                F.when(
                    text.collapse_ws("business_frame_text") == "", F.lit("no_business_frame_text")
                ),
            )
        ),
    )
    own = checked.select(*SECTION, F.explode("_reasons").alias("reason"))
    used = sections.select(
        *SECTION, F.explode(distinct.cast("array<bigint>")).alias("sentence_index")
    )
    per_sentence = used.groupBy("video_id", "sentence_index").agg(
        F.min("section_index").alias("_first"), F.max("section_index").alias("_last")
    )
    reused = per_sentence.where(F.col("_first") < F.col("_last")).select(
        "video_id", F.col("_last").alias("section_index"), F.lit("sentence_reused").alias("reason")
    )
    told = sections.select("video_id").distinct()
    known = sentences.select("video_id", "sentence_index").join(told, "video_id", "left_semi")
    pair = ["video_id", "sentence_index"]
    uncovered = (
        known.join(per_sentence, pair, "left_anti")
        .select("video_id")
        .unionByName(per_sentence.join(known, pair, "left_anti").select("video_id"))
        .select(
            "video_id",
            F.lit(None).cast(sections.schema["section_index"].dataType).alias("section_index"),
            F.lit("sentences_not_covered").alias("reason"),
        )
    )
    matched = used.join(known, pair, "left_semi").select(*SECTION).distinct()
    untimed = (
        checked.where(count > 0)
        .join(matched, list(SECTION), "left_anti")
        .select(*SECTION, F.lit("timestamps_missing").alias("reason"))
    )
    violations = (
        own.unionByName(reused).unionByName(uncovered).unionByName(untimed).distinct()
    )
    good = sections.join(violations.select("video_id").distinct(), "video_id", "left_anti")
    return good, violations


def repair_section_ranges(sections: DataFrame, block_rows: int = 1_000) -> DataFrame:
    """Make ranges follow each other: no start before the previous end.

    The sequential rule has a closed form: an end is the running maximum of all
    starts and ends so far, a start is its own or that maximum one row before.
    Needs duration_seconds; bounds are clamped to it and rounded to 3 places.
    """
    top = F.greatest("start_seconds", "end_seconds")
    ranged = previous_and_running_max(sections, ["video_id"], "section_index", top, block_rows)
    start = F.greatest("start_seconds", F.coalesce("previous_max", "start_seconds"))

    def bound(value: Column) -> Column:
        return F.round(text.clamp_seconds(value, F.col("duration_seconds")), 3)

    return (
        ranged.withColumn("start_seconds", bound(start))
        .withColumn("end_seconds", bound(F.col("running_max")))
        .withColumn("start_time", text.format_timestamp("start_seconds"))
        .withColumn("end_time", text.format_timestamp("end_seconds"))
        .drop("running_max", "previous_max")
    )


def retry_set(bad: DataFrame, max_attempts: int = config.MAX_STRUCTURE_ATTEMPTS) -> DataFrame:
    """Rejected answers worth another attempt, with feedback for the model."""
    again = keep_where(bad.where(F.col("attempt") < max_attempts), F.col("reason").startswith("query_graph"))
    return (
        again.withColumn("feedback", F.concat(F.lit("validation error: "), F.col("reason")))
        .withColumn("attempt", F.col("attempt") + 1)
    )


def model_context(
    sentences: DataFrame, max_chars: int = 300_000, block_rows: int = 1_000
) -> DataFrame:
    """Numbered ``[i] start-end text`` lines per video, clipped to ``max_chars``.

    Line offsets are known before lines are gathered, so only lines that start
    inside the clip are, and a context never holds more than ``max_chars``.
    """
    line = F.concat(
        F.lit("["), F.col("sentence_index").cast("string"), F.lit("] "),
        text.format_timestamp("start_seconds"), F.lit("-"),
        text.format_timestamp("end_seconds"), F.lit(" "), text.strip("text"),
    )
    lines = sentences.select("video_id", "sentence_index", line.alias("line"))
    placed = offset_and_total(
        lines, ["video_id"], "sentence_index", F.length("line") + 1, block_rows
    )
    items = F.sort_array(F.collect_list(F.struct("sentence_index", "line")))
    joined = F.array_join(F.transform(items, lambda x: x["line"]), "\n")
    whole = F.max("total") - 1
    head = F.regexp_replace(F.substring(joined, 1, max_chars), r"(?U)\s+$", "")
    return (
        placed.where(F.col("offset") <= max_chars)
        .groupBy("video_id")
        .agg(
            F.when(whole > max_chars, F.concat(head, F.lit(config.CLIP_MARKER)))
            .otherwise(joined)
            .alias("context"),
            whole.alias("whole_chars"),
        )
    )
