"""Stored objects: key, media type, size and checksum."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgraph.functions import text


def object_inventory(objects: DataFrame) -> DataFrame:
    """``objects``: object_key and binary content."""
    name = F.regexp_replace(text.base_name("object_key"), r"[?#].*$", "")
    return objects.select(
        "object_key",
        text.media_type(text.file_suffix(name)).alias("media_type"),
        F.length("content").cast("bigint").alias("size_bytes"),
        F.sha2("content", 256).alias("checksum"),
    )


def read_objects(spark: SparkSession, path: str, root: str) -> DataFrame:
    """Files below ``path`` as objects; keys are relative to ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    key = F.regexp_replace("path", "^.*?" + root.rstrip("/") + "/", "")
    return files.select(key.alias("object_key"), "content", "length")
