"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
and read back as the next one's ``docs``. All but the last return the columns of
``documents``, with ``n_chars`` that of the text they return.

Defined cases: what each operator defines for nulls, empty and long texts, ties, repeated
rows and empty tables holds for its stage; columns beyond those of ``documents`` are
carried to the last stage. A document that loses all its words to substring dedup stays,
with an empty text. Rows with a null id are never near duplicates.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgraph.llm import ngram_join, packing, quality_rules, secret_scans, substring_dedup
from reelgraph.llm.common import Shared, read_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Near duplicates: shingles of five words, a similarity of 0.8 or more.
SHINGLE, PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group; of equal rows one."""
    groups = ngram_join.join(docs, SHINGLE, PERCENT)
    stays = groups.where("doc_id = component_id").select(F.col("doc_id").alias("_stays")).hint("merge")
    named = docs.join(stays, F.col("doc_id") == F.col("_stays"), "left_semi")
    return named.dropDuplicates(["doc_id", "text"]).unionByName(docs.where("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without passages that an earlier document has; untouched texts stay as they are."""
    cut = substring_dedup.cut(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return _with_text(cut, text).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With every secret replaced by a mark."""
    clean = secret_scans.redact(docs, ratios=secret_scans.train(docs))
    return _with_text(clean, F.col("text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    pieces = packing.tokenize_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def _with_text(docs: DataFrame, text) -> DataFrame:
    df = docs.withColumn("text", text)
    return df.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in df.columns else df


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("secret_scans", secrets),
    ("best_fit_packing", pack),
]

#: The tokenizer and the character models are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    shared = Shared(spark)
    for name, stage in STAGES[:-1]:
        docs = shared.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
