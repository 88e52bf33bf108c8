import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCS = StructType([
    StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
    StructField("source", StringType()), StructField("n_chars", LongType()),
])


@pytest.fixture
def documents(spark):
    """A table of documents from (doc_id, text) pairs."""
    def make(pairs):
        return spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in pairs], DOCS)

    return make
