"""The thin queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import audio, decontaminate, order_minhash, pii, raking, recompress_dedup, reshard, suffix_dedup, zstd_classifiers
from lamina.llm.common import documents, held_out


def op1_quality_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = zstd_classifiers.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rated = zstd_classifiers.rate(docs.select("doc_id", "text"), model)
    return rated.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_pred").alias("predicted"))


def op2_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = audio.audio_features(documents(spark, sf_dir))
    return got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "n_segments", "segments", "logmel", "span_s")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_substrings(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_language_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    got = zstd_classifiers.identify(docs.select("doc_id", "text"), zstd_classifiers.fit_language(docs))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_margin").alias("margin"), F.col("lang_rejected").alias("rejected"))


def op6_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = raking.mix_sources(documents(spark, sf_dir))
    named = lambda c: F.coalesce(F.col(c), F.lit("(null)")).alias(c)
    return got.select("doc_id", named("source"), named("lang"), "topic", "n_tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "sampled")


def op7_pii_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pii.find_personal_data(docs, pii.fit(docs))


def op8_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress_dedup.dedup_words(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_min_cost_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return reshard.assign(docs, reshard.plan(docs))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_zstd": op1_quality_zstd,
    "op2_spaced_seeds": op2_spaced_seeds,
    "op3_audio_features": op3_audio_features,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_language_zstd": op5_language_zstd,
    "op6_raking": op6_raking,
    "op7_pii_skip_chain": op7_pii_skip_chain,
    "op8_recompression": op8_recompression,
    "op9_min_cost_resharding": op9_min_cost_resharding,
    "op10_order_minhash": op10_order_minhash,
}

ORACLES: dict[str, str] = {"op2_spaced_seeds": decontaminate.oracle(), "op6_raking": raking.oracle()}
