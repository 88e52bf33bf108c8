"""Video catalogue: search, paging, public views, job state and removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgraph import config
from reelgraph.functions import text
from reelgraph.operators.ranking import first_row
from reelgraph.operators.skew import rank_in_key

# Pages ending within this many rows are taken with a bounded top-k; deeper
# pages first find the creation days they fall on.
SHALLOW_ROWS = 10_000


def catalogue_filter(videos: DataFrame, query: str = "", status: str = "") -> DataFrame:
    """Literal, case-insensitive substring of title or filename, and a status."""
    needle = query.strip()
    if needle:
        wanted = F.lower(F.lit(needle))
        videos = videos.where(
            F.contains(F.lower("title"), wanted) | F.contains(F.lower("filename"), wanted)
        )
    return videos.where(F.col("status") == status) if status else videos


def page_info(videos: DataFrame, page: int, size: int) -> DataFrame:
    """One row: total, total_pages (at least 1) and the page, clamped to them."""
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / size))
    return (
        videos.agg(F.count(F.lit(1)).alias("total"))
        .withColumn("total_pages", pages)
        .withColumn("page", F.least(F.lit(page).cast("bigint"), F.col("total_pages")))
    )


def _page_order(sort: str) -> list[Column]:
    columns = (F.col("created_at"), F.col("id"))
    return [c.asc() if sort == "asc" else c.desc() for c in columns]


def catalogue_page(
    videos: DataFrame,
    page: int,
    size: int,
    query: str = "",
    status: str = "",
    sort: str = "desc",
    shallow_rows: int = SHALLOW_ROWS,
    day_ms: int = 86_400_000,
) -> tuple[DataFrame, DataFrame]:
    """(rows of the page, page_info). ``created_at`` is epoch milliseconds.

    The total decides the clamped page, as one count does in any paging
    service. A page deep in the list does not pull everything before it to one
    place: day counts locate its days, and only those are ordered.
    """
    found = catalogue_filter(videos, query, status)
    info = page_info(found, page, size)
    at = int(info.first()["page"])
    offset = (at - 1) * size
    if offset + size <= shallow_rows:
        return found.orderBy(*_page_order(sort)).offset(offset).limit(size), info

    day = F.floor(F.col("created_at") / day_ms)
    key = F.col("_day").asc() if sort == "asc" else F.col("_day").desc()
    upto = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    days = (
        found.groupBy(day.alias("_day"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_end", F.sum("_n").over(upto))
        .withColumn("_begin", F.col("_end") - F.col("_n"))
        .where((F.col("_end") > offset) & (F.col("_begin") < offset + size))
        .select("_day", "_begin")
    )
    touched = found.withColumn("_day", day).join(days, "_day")
    minute = F.floor(F.col("created_at") / (day_ms / 1440))
    ranked = rank_in_key(
        touched, ["_day"], _page_order(sort), minute if sort == "asc" else -minute, "_rank"
    )
    place = F.col("_begin") + F.col("_rank")
    rows = ranked.where((place > offset) & (place <= offset + size))
    return rows.orderBy(*_page_order(sort)).drop("_day", "_begin", "_rank"), info


def recent(videos: DataFrame, n: int = config.RECENT_LIMIT) -> DataFrame:
    return videos.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n)


# --- fixed values -----------------------------------------------------------
LIST_STATUS_LABELS = {
    "uploaded": "待解析",
    "queued": "排队中",
    "processing": "处理中",
    "completed": "已完成",
    "completed_with_warnings": "完成（有警告）",
    "failed": "失败",
    "deleting": "删除未完成",
}
UNKNOWN_STATUS = "未知状态"
# --- end of fixed values ----------------------------------------------------


def public_job_view(videos: DataFrame) -> DataFrame:
    """What a client may see of a job: errors of failed jobs are masked."""
    error = F.when(F.col("status") == "failed", F.lit(config.FAILED_PUBLIC_MESSAGE)).otherwise(
        F.coalesce(F.col("error_message"), F.lit(""))
    )
    label = F.coalesce(text.lookup(LIST_STATUS_LABELS, F.col("status")), F.lit(UNKNOWN_STATUS))
    view = videos.withColumn("error_message", error).withColumn("status_label", label)
    if "stage_message" in videos.columns:
        view = view.withColumn("stage_message", F.coalesce("stage_message", F.lit("")))
    return view.drop("audio_temp_path")


def frame_view(frames: DataFrame) -> DataFrame:
    """Public columns of a frame with its derived address and defaults."""
    name = text.base_name("object_key")
    url = F.concat(
        F.lit("/api/videos/"), F.col("video_id").cast("string"), F.lit("/frames/"), name
    )
    return frames.select(
        "video_id",
        "frame_id",
        "timestamp_ms",
        (F.col("timestamp_ms") / 1000.0).alias("timestamp_seconds"),
        text.format_timestamp(F.col("timestamp_ms") / 1000.0).alias("timestamp_time"),
        "object_key",
        url.alias("url"),
        F.coalesce("selection_status", F.lit("pending")).alias("selection_status"),
        "selection_score",
        "matched_section_index",
    )


def latest_order(terminal: tuple[str, ...] = config.TERMINAL_STATUSES) -> Column:
    """Newest update wins; at equal times a terminal state holds."""
    return F.struct(
        F.col("updated_at"), F.col("status").isin(*terminal).cast("int"), F.col("seq")
    )


def latest_state(
    updates: DataFrame,
    tombstones: DataFrame | None = None,
    terminal: tuple[str, ...] = config.TERMINAL_STATUSES,
) -> tuple[DataFrame, DataFrame]:
    """(latest row per id, quarantined updates without a usable time).

    An aggregate, so updates of a hot id combine before the shuffle. Ids in
    ``tombstones`` never return.
    """
    timed = updates.where(F.col("updated_at").isNotNull())
    if tombstones is not None:
        timed = timed.join(tombstones.select("id").distinct(), "id", "left_anti")
    rest = [c for c in updates.columns if c != "id"]
    state = timed.groupBy("id").agg(
        F.max_by(F.struct(*rest), latest_order(terminal)).alias("_row")
    )
    return state.select("id", "_row.*"), updates.where(F.col("updated_at").isNull())


# Update fields and how a new value is stored.
_PERCENT = ("progress_percent",)
_COUNTERS = ("stage_processed", "stage_total")


def unknown_updates(videos: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates whose id no video has: ``apply_job_updates`` has no row to put them in."""
    return updates.join(videos.select("id"), "id", "left_anti").withColumn("reason", F.lit("unknown_id"))


def apply_job_updates(videos: DataFrame, updates: DataFrame) -> DataFrame:
    """Partial updates in ``seq`` order: only non-NULL fields overwrite.

    Per id and field the last non-NULL value is one aggregate; progress is kept
    in 0..100, counters at 0 or more and the message at 255 characters.
    """
    fields = [c for c in updates.columns if c not in ("id", "seq", "updated_at")]
    last = updates.groupBy("id").agg(
        *[
            F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"_{c}")
            for c in fields
        ],
        F.max("updated_at").alias("_updated_at"),
    )

    def stored(c: str) -> Column:
        value = F.col(f"_{c}")
        if c in _PERCENT:
            return F.greatest(F.lit(0), F.least(F.lit(100), value.cast("bigint")))
        if c in _COUNTERS:
            return F.greatest(F.lit(0), value.cast("bigint"))
        return F.substring(value, 1, 255) if c == "stage_message" else value

    kept = [c for c in videos.columns if c not in (*fields, "updated_at")]
    return videos.join(last, "id", "left").select(
        *kept,
        *[
            F.when(F.col(f"_{c}").isNotNull(), stored(c)).otherwise(F.col(c)).alias(c)
            for c in fields
        ],
        F.coalesce("_updated_at", "updated_at").alias("updated_at"),
    )


def fail_interrupted(videos: DataFrame, now: Column) -> DataFrame:
    """Jobs left processing by a stopped service become failed."""
    hit = F.col("status") == "processing"
    changes = {
        "current_stage": F.lit("failed"),
        "progress_percent": F.lit(100).cast("bigint"),
        "error_message": F.lit(config.INTERRUPTED_MESSAGE),
        "completed_at": now,
        "updated_at": now,
        "status": F.lit("failed"),
    }
    old = {c: F.col(c) if c in videos.columns else F.lit(None) for c in changes}
    return videos.withColumns(
        {c: F.when(hit, new).otherwise(old[c]) for c, new in changes.items()}
    )


def deletable(status: Column | str) -> Column:
    return text._col(status).isin(*config.DELETABLE_STATUSES)


def parseable(status: Column | str) -> Column:
    return ~text._col(status).isin(*config.UNPARSEABLE_STATUSES)


def purge_videos(
    videos: DataFrame, frames: DataFrame, requested: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(remaining videos, remaining frames, refused requests with a reason).

    Usage records are not an input: they outlive their video.
    """
    asked = requested.select(F.col("id").cast("string").alias("id")).distinct()
    known = videos.select(F.col("id").cast("string").alias("id"), "status")
    judged = asked.join(known, "id", "left").withColumn(
        "reason",
        F.when(~F.col("id").rlike(config.SAFE_VIDEO_ID), F.lit("invalid_id"))
        .when(F.col("status").isNull(), F.lit("not_found"))
        .when(~deletable("status"), F.lit("active")),
    )
    gone = judged.where(F.col("reason").isNull()).select("id")
    left_videos = videos.join(gone, videos["id"].cast("string") == gone["id"], "left_anti")
    left_frames = frames.join(gone, frames["video_id"].cast("string") == gone["id"], "left_anti")
    return left_videos, left_frames, judged.where(F.col("reason").isNotNull()).select("id", "reason")


def owned_objects(objects: DataFrame, purged: DataFrame) -> DataFrame:
    """Stored objects under exactly ``videos/{id}/`` of a purged id."""
    owner = F.regexp_extract("object_key", "^videos/([A-Za-z0-9_-]{1,64})/", 1)
    ids = purged.select(F.col("id").cast("string").alias("_owner")).distinct()
    return objects.withColumn("_owner", owner).join(ids, "_owner", "left_semi").drop("_owner")


def buckets_to_clean(
    videos: DataFrame, frames: DataFrame, default_bucket: str
) -> DataFrame:
    """Distinct (video_id, bucket) over the four places an object may be in."""
    ids = videos.select(F.col("id").alias("video_id"), "source_bucket", "analysis_video_bucket")
    sources = ids.select("video_id", F.lit(default_bucket).alias("bucket")).unionByName(
        ids.select("video_id", F.col("source_bucket").alias("bucket"))
    )
    sources = sources.unionByName(
        ids.select("video_id", F.col("analysis_video_bucket").alias("bucket"))
    ).unionByName(frames.join(ids, "video_id", "left_semi").select("video_id", "bucket"))
    return sources.where(text.strip("bucket") != "").distinct()
