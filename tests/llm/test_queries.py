"""The registered queries and the pipeline on the smallest tables, and odd documents."""

import os

import pytest

import __spark_entry__
import corpus_pipeline
from reelgraph.llm import queries

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@needs_data
def test_all_are_registered():
    names = set(__spark_entry__.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= names
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}


@needs_data
@pytest.mark.parametrize("name", ["op1_quality_rules", "op2_best_fit_packing", "op8_hash_tree_sharding"])
def test_rows_of_a_query(spark, name):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.QUERIES[name](spark, SF)
    assert got.select("doc_id").distinct().count() == documents.count()


def test_pipeline_on_odd_documents(spark, documents):
    plain = " ".join(f"w{i}" for i in range(80))
    other = " ".join(f"v{i}" for i in range(80))
    rows = [
        (1, plain), (2, plain), (3, plain + " more"), (4, None), (5, ""), (None, other), (6, other + " token=abcdef99"),
        (6, other + " token=abcdef99"), (7, "short"), (8, "same " * 90),
        (9, " ".join(f"u{i}" for i in range(60)) + " " + " ".join(f"w{i}" for i in range(20, 50))),
    ]
    docs = documents(rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name == "best_fit_packing":
            assert {r.doc_id for r in out.collect()} == {None, 1, 6, 9}
            break
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        found = sorted(((r.doc_id or 0, r.text) for r in docs.collect()))
        if name == "quality_rules":
            assert [i for i, _ in found] == [0, 1, 2, 3, 6, 6, 9]
        if name == "ngram_jaccard_join":
            assert [i for i, _ in found] == [0, 1, 6, 9]
        if name == "substring_dedup":
            assert dict(found)[9] == " ".join(f"u{i}" for i in range(60)) and dict(found)[1] == plain
        if name == "secret_scans":
            assert dict(found)[6] == other + " <secret>"


def test_empty_tables(spark, documents):
    docs = documents([])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


@needs_data
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    from compare import connect, difference, spark_result, sql_result

    got = spark_result(queries.QUERIES[name](spark, SF))
    assert difference(got, sql_result(connect(SF), queries.SQL[name])) is None
