"""Registered queries of this subpackage: thin, one per operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgraph.llm import (
    decontaminate, lexical_rank, ngram_join, packing, pieces, quality_classifier, quality_rules, secret_scans,
    sharding, spelling, substring_dedup, topk, toxicity,
)
from reelgraph.llm.bits import rows_that_may_join
from reelgraph.llm.common import read_table
from reelgraph.llm.oracle import SQL  # noqa: F401

SHARDS = 8


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(read_table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    cut = packing.tokenize_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return topk.search(vectors, 5, lambda vec_id: F.pmod(vec_id, F.lit(50)) == 0)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.cut(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


def op6_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    coded = pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids_text", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scans.find(docs, ratios=secret_scans.train(docs))

    def count(kind: int):
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secret_scans.spans_text(F.col("base_spans")), 256).alias("base_sha256"),
        secret_scans.spans_text(F.col("spans")).alias("spans"),
    )


def op8_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    tree = sharding.even_tree(SHARDS)
    rows = sharding.assign(rows, tree, "doc_id")
    rows = sharding.assign(rows, sharding.grow(tree, SHARDS), "doc_id", "grown_shard")
    return sharding.number_slots(rows)


def _held_out(doc_id: str = "doc_id"):
    """Rows whose labels nothing may learn from."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0


def _training(spark: SparkSession, sf_dir: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Documents as (key, text), and labels as (key, label) without the held-out ones."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    labels = read_table(spark, sf_dir, "labels").where(~_held_out())
    return docs, labels.select(F.col("doc_id").alias("key"), F.col(label).alias("label"))


def _predicted(scored: DataFrame, least: float) -> DataFrame:
    return scored.select(
        "doc_id", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= least).cast("int").alias("predicted"),
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _training(spark, sf_dir, "toxic")
    # Without it the whole texts of all documents would be shuffled, not those with labels alone.
    model = toxicity.train(rows_that_may_join(docs, labels, "key").join(labels, "key"))
    return _predicted(toxicity.score(read_table(spark, sf_dir, "documents"), model), 0.5)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = quality_classifier.train(*_training(spark, sf_dir, "quality"))
    return _predicted(quality_classifier.score(read_table(spark, sf_dir, "documents"), model), 0.3)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(read_table(spark, sf_dir, "documents"))


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op12_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_rank.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), 20)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_quality_rules, op2_best_fit_packing, op6_piece_encoding, op7_secret_scans,
        op8_hash_tree_sharding, op3_exact_top_k, op4_toxicity, op9_quality_classifier,
        op10_ngram_jaccard_join, op5_substring_dedup, op11_benchmark_decontamination,
        op12_ranked_lexical_search, op13_spelling_variants,
    )
}
