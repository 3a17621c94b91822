"""The dealt operators as registered queries, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribeprint.llm import (decontamination, hard_negatives, licenses, mixing, near_dedup, quality_rules,
                             radix_resampling, resampling, secrets, substring_dedup, token_counts, token_files, warc)
from scribeprint.llm.scratch import documents


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    taken = mixing.taken_words(documents(spark, sf_dir, "doc_id", "text", "source"))
    return taken.select("doc_id", "size", "source_size", "target", "taken")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op3_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(documents(spark, sf_dir, "doc_id", "text", "source"), keep_text=False)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept")


def op5_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex",
                        F.sha2(secrets.written_spans("base_spans"), 256).alias("base_sha256"),
                        secrets.written_spans("spans").alias("spans"))


def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their importance weight; kept is the Gumbel top-k sample."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = labels.filter("quality = 1").select("doc_id")
    return resampling.resample(documents(spark, sf_dir, "doc_id", "text"), good,
                               resampling.good_share(labels))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring_dedup.remove_repeats(documents(spark, sf_dir, "doc_id", "text"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word",
                        F.array_join("base_labels", ",").alias("base_labels"),
                        F.array_join("labels", ",").alias("labels"), "score")


def op8_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_prefixes(
        documents(spark, sf_dir, "doc_id", "text"),
        public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op9_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_benchmark(documents(spark, sf_dir, "doc_id", "text"),
                                           spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = decontamination.n_hit_words()
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"),
                        F.size("items").cast("long").alias("n_items"),
                        decontamination.items_digest().alias("items_sha256"),
                        (n_hit > 0).alias("contaminated"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(documents(spark, sf_dir, "doc_id", "text"),
                                  public_tokenizers.path("word_bpe_49k.json"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every seventh vector the label is shifted, so that some near neighbours have another one."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    label = F.col("label").cast("long")
    shifted = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(vectors.withColumn("label", shifted))


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = radix_resampling.resample_to_target(documents(spark, sf_dir, "doc_id", "text"),
                                                spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {f.__name__: f for f in (
    op1_source_mix, op2_minhash_near_dedup, op3_host_quality, op4_importance_resampling,
    op5_markov_secrets, op6_substring_dedup, op7_license_scan, op8_prefix_token_counts,
    op9_warc_round_trip, op10_benchmark_decontamination, op11_token_files, op12_hard_negatives,
    op13_target_resampling)}
