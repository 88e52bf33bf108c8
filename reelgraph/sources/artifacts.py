"""Per-video documents and frame tables on shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelgraph.functions import text
from reelgraph.session import cut_lineage

# --- fixed values -----------------------------------------------------------
ARTIFACT_KEYS = {
    "transcript_tree": "transcript/transcript_tree.json",
    "transcript_raw": "transcript/transcript_raw.json",
    "transcript_rendered": "transcript/transcript_rendered.txt",
    "frame_quality_report": "frames/frame_quality_report.json",
    "frame_dedup_report": "frames/frame_dedup_report.json",
    "semantic_frame_matches": "frames/semantic_frame_matches.json",
    "markdown": "markdown/result.md",
}
VIDEO_IN_PATH = r"videos/([A-Za-z0-9_-]{1,64})/"
# --- end of fixed values ----------------------------------------------------

FRAME_BUCKETS = 1024


def artifact_key(kind: str, video_id: str = "video_id"):
    return F.concat(
        F.lit("videos/"), F.col(video_id).cast("string"), F.lit("/" + ARTIFACT_KEYS[kind])
    )


def parse_artifacts(documents: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(documents read by ``schema``, documents with a reason).

    documents: video_id, value (JSON text).
    """
    read = documents.select(
        "video_id", "value", F.try_parse_json("value").isNotNull().alias("_json"),
        F.from_json("value", schema).alias("_doc"),
    )
    reason = F.when(text.strip("value") == "", F.lit("empty")).when(~F.col("_json"), F.lit("corrupt"))
    judged = read.withColumn("reason", reason)
    good = judged.where(F.col("reason").isNull()).select("video_id", "_doc.*")
    return good, judged.where(F.col("reason").isNotNull()).select("video_id", "reason")


def read_artifacts(
    spark: SparkSession, path: str, schema: T.StructType
) -> tuple[DataFrame, DataFrame]:
    """One JSON document per video below ``path``; corrupt and empty ones come apart.

    Spark's readers skip files of zero bytes: those come from the listing.
    """
    documents = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.input_file_name(), VIDEO_IN_PATH, 1).alias("video_id"), "value"
    )
    empty = spark.createDataFrame([(p, "") for p in _empty_files(spark, path)], "path string, value string")
    empty = empty.select(F.regexp_extract("path", VIDEO_IN_PATH, 1).alias("video_id"), "value")
    return parse_artifacts(documents.unionByName(empty), schema)


def write_artifacts(df: DataFrame, path: str, kind: str, fmt: str = "json") -> None:
    """Write a document table as ``path``/kind=.../shard=...

    Videos share a bounded number of folders (a folder per video would be
    millions); rows of a video lie together in part order.
    """
    order = [c for c in ("video_id", "section_index", "part_no") if c in df.columns]
    (
        df.withColumn("shard", F.pmod(F.xxhash64("video_id"), F.lit(FRAME_BUCKETS)))
        .repartition("shard")
        .sortWithinPartitions("shard", *order)
        .write.mode("overwrite")
        .partitionBy("shard")
        .format(fmt)
        .save(f"{path.rstrip('/')}/kind={kind}")
    )


def replace_frames(
    spark: SparkSession, frames: DataFrame, path: str, buckets: int = FRAME_BUCKETS,
    videos: DataFrame | None = None,
) -> None:
    """Replace all frames of the given videos, and of no other video.

    ``videos`` (video_id) names videos that lose their old frames even if ``frames`` has
    none for them.

    The table is partitioned by a hash bucket of the video. Touched buckets are
    rewritten as old rows of other videos plus the new rows; other buckets are
    not read or written.
    """
    bucket = F.pmod(F.xxhash64("video_id"), F.lit(buckets)).cast("int")
    new = frames.withColumn("bucket", bucket)
    out = new
    if _exists(spark, path):
        ids = new.select("video_id", "bucket")
        if videos is not None:
            ids = ids.union(videos.select("video_id").withColumn("bucket", bucket))
        ids = ids.distinct()
        touched = ids.select("bucket").distinct()
        kept = (
            spark.read.parquet(path)
            .join(F.broadcast(touched), "bucket", "left_semi")  # at most ``buckets`` rows
            .join(ids.select("video_id"), "video_id", "left_anti")
        )
        kept = cut_lineage(kept)
        out = new.unionByName(kept)
        # A bucket without rows is not overwritten: at most ``buckets`` numbers.
        left = out.select("bucket").distinct()
        for row in touched.join(left, "bucket", "left_anti").collect():
            _remove(spark, f"{path.rstrip('/')}/bucket={row['bucket']}")
    (
        out.repartition("bucket")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket")
        .parquet(path)
    )


def _empty_files(spark: SparkSession, pattern: str) -> list[str]:
    where = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return [s.getPath().toString() for s in found or () if s.isFile() and s.getLen() == 0]


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_label_export(
    spark: SparkSession, path: str
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(class lines, images, label files, label lines) of an annotation export.

    Line numbers are positions inside a file.
    """
    root = path.rstrip("/")
    name = F.regexp_extract(F.input_file_name(), "([^/]+)$", 1)
    stem, suffix = F.regexp_extract("name", r"^(.+?)(\.[^.]*)?$", 1), F.regexp_extract("name", r"(\.[^.]*)$", 1)

    def lines(where: str) -> DataFrame:
        files = spark.read.text(where, wholetext=True).select(name.alias("name"), "value")
        return files.select("name", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "text"))

    listed = spark.read.format("binaryFile").load(f"{root}/images/*").select(
        F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length"
    )
    images = listed.select(stem.alias("stem"), F.lower(suffix).alias("suffix"), "length")
    found = spark.read.format("binaryFile").load(f"{root}/labels/*.txt").select(
        F.regexp_extract("path", "([^/]+)$", 1).alias("name")
    )
    labels = lines(f"{root}/labels/*.txt").where(F.trim("text") != "")
    return (
        lines(f"{root}/classes.txt").select("line_no", "text"),
        images,
        found.select(stem.alias("stem")),
        labels.select(stem.alias("stem"), "line_no", F.col("text").alias("line")),
    )
