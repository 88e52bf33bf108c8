"""Shared folders, table reading and word rules of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run without these six characters.
SPACE = r"[\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Shared:
    """Written tables of one run, in the folder the cluster shares.

    The folder is the session's ``spark.checkpoint.dir``. Only where that is unset
    (tests on one machine) a temporary one is made.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            root = tempfile.mkdtemp(prefix="reelgraph-llm-")
            spark.conf.set("spark.checkpoint.dir", root)
        self.root = f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back: lineage ends, shuffle files of the job go."""
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(_CLEANUP)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Remove a table of this run that nothing reads any more."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        path = hadoop.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows that a scan meets, as a small table.

    Spark reads partition after partition until it has enough, where a limit inside a plan
    would bring ``n`` rows of every partition to one task.
    """
    return df.sparkSession.createDataFrame(df.limit(n).collect(), df.schema)


def words_column(text) -> F.Column:
    """Words of a text; none for null or for white space only."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE)
    return F.filter(parts, lambda w: w != F.lit(""))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
