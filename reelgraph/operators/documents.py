"""Result documents: transcript text, Markdown, manifest and match report.

A document is one text per video, in section order. Texts come in parts (see
``skew.ordered_parts``): an ordinary video has the single part 0, and the parts
of a longer one concatenate to its whole document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgraph import config
from reelgraph.functions import text
from reelgraph.operators.ranking import first_row
from reelgraph.operators.skew import ordered_parts
from reelgraph.session import cut_lineage

SECTION = ("video_id", "section_index")


def slim_frames(frames: DataFrame) -> DataFrame:
    """The eight public fields of a frame; rows without id, key or url go."""
    def given(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in frames.columns else F.lit(None).cast(kind)

    identity = F.coalesce(given("id", "bigint"), given("frame_id", "bigint"))
    known = (
        (F.coalesce(identity, F.lit(0)) != 0)
        | (F.coalesce(given("object_key"), F.lit("")) != "")
        | (F.coalesce(given("url"), F.lit("")) != "")
    )
    kept = [c for c in SECTION if c in frames.columns]
    return frames.where(known).select(
        *kept,
        identity.alias("id"),
        given("timestamp_seconds", "double").alias("timestamp_seconds"),
        given("timestamp_time").alias("timestamp_time"),
        F.coalesce(F.when(given("caption") != "", given("caption")), F.lit(config.DEFAULT_CAPTION))
        .alias("caption"),
        given("object_key").alias("object_key"),
        given("url").alias("url"),
        given("score", "double").alias("score"),
        given("rank", "bigint").alias("rank"),
    )


def attach_report(sections: DataFrame, report: DataFrame, position: str = "position") -> DataFrame:
    """Sections with their report row; the last duplicate of an index wins."""
    last = first_row(report, SECTION, -F.col(position)).drop(position)
    return sections.join(last, list(SECTION), "left")


def run_summary(frames: DataFrame, candidates: DataFrame, sections: DataFrame) -> DataFrame:
    """Counts per video: frames, candidates (distinct, and over sections),
    sections, and sections with a query graph."""
    raw = frames.groupBy("video_id").agg(F.count(F.lit(1)).alias("raw_frame_count"))
    kept = (
        candidates.groupBy("video_id", "frame_id")
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("video_id")
        .agg(
            F.count(F.lit(1)).alias("candidate_frame_count"),
            F.sum("_n").alias("section_candidate_frame_count"),
        )
    )
    told = sections.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("section_count"),
        F.count("graph_id").alias("query_graph_count"),
    )
    joined = raw.join(kept, "video_id", "full").join(told, "video_id", "full")
    return joined.na.fill(0)


def _filled(name: str) -> Column:
    value = text.strip(F.coalesce(F.col(name), F.lit("")))
    return F.when(value != "", value)


def _heading() -> Column:
    return F.concat(
        F.lit("## "), F.col("section_index").cast("string"), F.lit(". "), F.col("title"),
        F.lit("\n\n**时间范围：** "), F.col("start_time"), F.lit(" - "), F.col("end_time"),
    )


def _documents(blocks: DataFrame, head: DataFrame, separator: str, part_rows: int) -> DataFrame:
    """Section blocks per part, behind the head in part 0.

    ``blocks``: video_id, section_index (from 1), block. ``head``: video_id, head.
    """
    parts = ordered_parts(
        blocks.withColumn("_place", F.col("section_index") - 1),
        ["video_id"], "_place", F.col("block"), separator, "body", part_rows,
    )
    order = Window.partitionBy("video_id").orderBy("part_no")
    last = F.lead("part_no").over(order).isNull()
    return (
        parts.withColumn("_end", F.when(last, F.lit("\n")).otherwise(F.lit(separator)))
        .join(head, "video_id", "left")
        .select(
            "video_id",
            "part_no",
            F.concat(
                F.when(F.col("part_no") == 0, F.col("head")).otherwise(F.lit("")), "body", "_end"
            ).alias("document"),
        )
    )


def render_transcript(
    sections: DataFrame, videos: DataFrame, part_rows: int = config.PART_ROWS
) -> DataFrame:
    """Plain transcript per video: every section's text, edited text and query."""
    unknown = F.lit(config.UNKNOWN_TEXT)
    block = F.concat(
        _heading(),
        F.lit("\n\n### 正文\n\n"), F.coalesce(_filled("text"), unknown),
        F.lit("\n\n### 润色后正文\n\n"), F.coalesce(_filled("polished_text"), unknown),
        F.lit("\n\n### 待匹配文本\n\n"), F.coalesce(_filled("business_frame_text"), unknown),
    )
    title = F.coalesce(F.when(F.col("video_title") != "", F.col("video_title")), F.lit("视频转写"))
    head = videos.select("video_id", F.concat(F.lit("# "), title, F.lit("\n\n")).alias("head"))
    return _documents(sections.select(*SECTION, block.alias("block")), head, "\n\n\n", part_rows)


def frame_lines(link: Column | str = "url", embed: bool = False, caption: str = "业务帧") -> Column:
    """Markdown of a section's frame; storage keys never appear.

    Uses frame columns frame_ref (NULL = no frame), timestamp_time,
    frame_caption and score.
    """
    url = F.col(link) if isinstance(link, str) else link
    name = F.coalesce(F.when(F.col("frame_caption") != "", F.col("frame_caption")), F.lit(caption))
    time = F.coalesce(F.when(F.col("timestamp_time") != "", F.col("timestamp_time")), F.lit("未知时间"))
    linked = F.concat(F.lit("![" if embed else "["), name, F.lit("]("), url, F.lit(")"))
    shown = F.when(F.coalesce(url, F.lit("")) != "", linked).otherwise(name)
    score = F.when(
        F.col("score").isNotNull(),
        F.concat(F.lit("\n  - 相似度分数："), F.format_string("%.4f", F.col("score"))),
    )
    line = F.concat(F.lit("- **"), time, F.lit("** "), shown, F.coalesce(score, F.lit("")))
    return F.when(F.col("frame_ref").isNull(), F.lit("- 无")).otherwise(line)


def render_markdown(
    sections: DataFrame,
    videos: DataFrame,
    link: Column | str = "url",
    embed: bool = False,
    part_rows: int = config.PART_ROWS,
) -> DataFrame:
    """Markdown result per video: front matter, then each section with its frame.

    ``sections`` carries the frame columns of ``frame_lines``. ``link`` is the
    address column: an API url, or a path inside an exported folder.
    """
    body = F.coalesce(_filled("polished_text"), _filled("text"), F.lit(config.UNKNOWN_TEXT))
    block = F.concat(
        _heading(), F.lit("\n\n### 润色后正文\n\n"), body, F.lit("\n\n### 业务帧\n\n"),
        frame_lines(link, embed),
    )
    title = F.coalesce(
        F.when(F.col("video_title") != "", F.col("video_title")), F.lit("视频分析结果")
    )

    def entry(key: str, value: Column) -> Column:
        return F.concat(F.lit(f'{key}: "'), text.yaml_escape(value), F.lit('"\n'))

    head = F.concat(
        F.lit('---\ndocument_role: "video_analysis_result"\n'),
        entry("video_id", F.col("video_id").cast("string")),
        entry("video_title", title),
        entry("source_filename", F.col("filename")),
        entry("duration", text.format_duration("duration_ms")),
        F.lit("---\n\n# "), title, F.lit("\n\n"),
    )
    return _documents(
        sections.select(*SECTION, block.alias("block")),
        videos.select("video_id", head.alias("head")),
        "\n\n",
        part_rows,
    )


def unique_names(entries: DataFrame) -> DataFrame:
    """File name per (video_id, object_key): the key's safe name, with the
    position of its first use appended where an earlier key has that name.

    entries: video_id, object_key, position (from 0, each once in a video).
    """
    scope = ["video_id"]
    first = entries.groupBy(*scope, "object_key").agg(F.min("position").alias("position"))
    named = first.withColumn("name", text.safe_filename("object_key", F.col("position")))
    suffixed = F.concat(
        text.file_stem("name"), F.format_string("_%03d", F.col("position")),
        F.regexp_extract("name", text.FILE_SUFFIX, 1),
    )
    owner = named.groupBy(*scope, "name").agg(F.min("position").alias("_owner"))
    judged = cut_lineage(
        named.join(owner, [*scope, "name"])
        .withColumn("suffixed", suffixed)
        .withColumn("_later", F.col("position") > F.col("_owner"))
    )
    # A key moves if an earlier one has its name, or if an earlier moved key's new name is
    # its name. So each key depends on one before it at most, and moves if the first of its
    # chain does. Every round lets a key look twice as far up its chain.
    taken = judged.select(
        *scope, F.col("suffixed").alias("name"), F.col("position").alias("_by"),
        F.col("object_key").alias("_up"), F.col("_later").alias("_moved"),
    )
    links = cut_lineage(
        judged.where("NOT _later").join(taken, [*scope, "name"]).where("_by < position")
        .groupBy(*scope, "object_key").agg(F.max_by(F.struct("_up", "_moved"), F.struct("_moved", "_by")).alias("l"))
        .select(*scope, "object_key", "l.*")
    )
    while not links.where("NOT _moved AND _up IS NOT NULL").isEmpty():
        ahead = links.select(
            *scope, F.col("object_key").alias("_up"), F.col("_up").alias("_next"), F.col("_moved").alias("_there")
        )
        moves = F.col("_moved") | F.coalesce("_there", F.lit(False))
        links = cut_lineage(
            links.join(ahead, [*scope, "_up"], "left").select(
                *scope, "object_key", F.when(~moves, F.col("_next")).alias("_up"), moves.alias("_moved")
            )
        )
    moved = judged.where("_later").select(*scope, "object_key").union(links.where("_moved").select(*scope, "object_key"))
    marked = moved.distinct().withColumn("_moved", F.lit(True))
    return judged.join(marked, [*scope, "object_key"], "left").select(
        *scope, "object_key", "position",
        F.when(F.col("_moved"), F.col("suffixed")).otherwise(F.col("name")).alias("local_name"),
    )


def manifest(
    sections: DataFrame,
    videos: DataFrame,
    inventory: DataFrame,
    folder: str = "frames",
    part_rows: int = config.PART_ROWS,
) -> DataFrame:
    """JSON index per video; a frame has a path only where its image exists.

    sections: as for ``render_markdown`` with object_key; inventory: object_key.
    """
    listed = sections.withColumn("position", F.col("section_index") - 1)
    names = unique_names(
        listed.where(F.coalesce(F.col("object_key"), F.lit("")) != "").select(
            "video_id", "object_key", "position"
        )
    ).drop("position")
    stored = inventory.select("object_key", F.lit(True).alias("_stored")).distinct()
    rows = listed.join(names, ["video_id", "object_key"], "left").join(
        stored, "object_key", "left"
    )
    frame = F.struct(
        F.col("timestamp_time").alias("timestamp"),
        F.col("frame_caption").alias("caption"),
        "score",
        F.when(F.col("_stored"), F.concat(F.lit(folder + "/"), F.col("local_name"))).alias("path"),
    )
    entry = F.struct(
        F.col("section_index").alias("index"), "title", "start_time", "end_time",
        F.when(F.col("frame_ref").isNotNull(), frame).alias("business_frame"),
    )
    gathered = (
        rows.withColumn("part_no", F.floor(F.col("position") / part_rows))
        .groupBy("video_id", "part_no")
        .agg(F.sort_array(F.collect_list(entry)).alias("sections"))
    )
    about = videos.select(
        "video_id", F.struct(
            F.col("video_id").cast("string").alias("video_id"),
            F.col("video_title").alias("title"), "filename", "duration_ms",
        ).alias("_about"),
    )
    keep_nulls = {"ignoreNullFields": "false"}
    return gathered.join(about, "video_id", "left").select(
        "video_id",
        "part_no",
        F.to_json(F.struct("_about.*", "sections"), keep_nulls).alias("manifest"),
    )


def semantic_report(
    sections: DataFrame, raw_frames: DataFrame, ranked: DataFrame, part_ms: int = 3_600_000
) -> DataFrame:
    """Match report as JSON per section and time slice of ``part_ms``.

    sections: section windows. raw_frames: frames of each section with
    filter_status. ranked: matches with rank and evidence. Frames keep a minimum
    spacing, so a slice is bounded whatever the section's length.
    """
    def sliced(df: DataFrame, entry: Column, out: str) -> DataFrame:
        return (
            df.withColumn("part_no", F.floor(F.col("timestamp_ms") / part_ms))
            .groupBy(*SECTION, "part_no")
            .agg(F.sort_array(F.collect_list(entry)).alias(out))
        )

    raw = sliced(
        raw_frames, F.struct("timestamp_ms", "frame_id", "filter_status"), "raw_frames"
    )
    evidence = [c for c in ("matched", "missing", "negative_hits") if c in ranked.columns]
    matches = sliced(ranked, F.struct("rank", "frame_id", "timestamp_ms", "score", *evidence), "matches")
    body = F.struct(
        F.lit(config.REPORT_VERSION).alias("version"),
        "window_start_ms", "window_end_ms", "raw_frames", "matches",
    )
    return (
        raw.join(matches, [*SECTION, "part_no"], "full")
        .join(sections.select(*SECTION, "window_start_ms", "window_end_ms"), list(SECTION))
        .select(*SECTION, "part_no", F.to_json(body).alias("report"))
    )


def lineage(kind: str, version: str, **settings: str) -> Column:
    """Stamp telling what made an output and with which settings."""
    values = {"kind": kind, "version": version, **settings}
    return F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in values.items()]))


def transcript_lineage(raw_settings: dict[str, str] | None = None) -> Column:
    """Lineage of a structured transcript, with that of its raw transcript inside."""
    raw = {
        "kind": config.RAW_TRANSCRIPT_KIND,
        "version": config.RAW_TRANSCRIPT_VERSION,
        "local_asr_model_label": config.ASR_MODEL_LABEL,
        **(raw_settings or {}),
    }
    return F.to_json(
        F.struct(
            F.lit(config.STRUCTURED_TRANSCRIPT_KIND).alias("kind"),
            F.lit(config.STRUCTURED_TRANSCRIPT_VERSION).alias("version"),
            F.struct(*[F.lit(v).alias(k) for k, v in raw.items()]).alias("raw"),
            F.lit(config.STRUCTURE_MODEL).alias("transcript_structure_model"),
            F.lit(config.BUSINESS_FRAME_MODE).alias("transcript_business_frame_mode"),
        )
    )
