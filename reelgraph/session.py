"""Session settings the library relies on."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Collecting aggregates turn to sorting at 128 groups per task by default.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "50000",
}


def configure(spark: SparkSession) -> SparkSession:
    """The one setting that results depend on; what a job tunes stays the caller's."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send the package to executors that do not have it on their path."""
    package = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="reelgraph-ship-"), "reelgraph"), "zip",
        os.path.dirname(package), os.path.basename(package),
    )
    spark.sparkContext.addPyFile(archive)


def local_session(cpus: int | str = "*", app: str = "reelgraph", **extra: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", extra.pop("driver_memory", "8g"))
        .config("spark.sql.shuffle.partitions", extra.pop("shuffle_partitions", "8"))
    )
    for key, value in {**RUNTIME_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only where the setting is absent (local tests) a temporary folder is made.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="reelgraph-"))
    return sc.getCheckpointDir().rstrip("/").rsplit("/", 1)[0]


def cut_lineage(df):
    """Write ``df`` to the shared folder and continue from the written copy."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df):
    """Rows dealt over as many tasks as a shuffle has.

    For small files whose rows cost much: a file of a few MB is one split, however many
    rows it holds.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
