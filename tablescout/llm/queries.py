"""The queries that apply each operator, with its production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescout.llm import oracles
from tablescout.llm.divergence import source_divergence
from tablescout.llm.fingerprint import compare_with_next
from tablescout.llm.jaccard import jaccard_components
from tablescout.llm.language import fit_language_model, identify_languages, remainder
from tablescout.llm.leaks import find_leaks, mark_leaks
from tablescout.llm.main_text import extract_main_text
from tablescout.llm.merkle import merkle_manifest, proof_digest
from tablescout.llm.pieces import PieceVocabulary, encode_and_check
from tablescout.llm.quality import fit_quality_model, score_quality
from tablescout.llm.repeats import remove_repeats
from tablescout.llm.secrets import find_secrets, report
from tablescout.llm.sharding import assign_shards
from tablescout.llm.toxicity import fit_toxicity_model, score_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    # A null id has no remainder: such a row is not held out, and not learned from.
    model = fit_language_model(docs.filter(remainder("doc_id", 4) != 2))
    out = identify_languages(docs.select("doc_id", "text"), model)
    return out.select(
        "doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
        "lang_pred", F.col("lang_score").alias("score"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").filter(remainder("doc_id", 5) != 0)
    out = score_quality(docs.select("doc_id", "text"), fit_quality_model(docs, labels))
    return out.select(
        "doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        F.col("quality_score").alias("score"), F.col("quality_label").alias("predicted"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


SHARDS = [f"shard-{i:02d}" for i in range(32)]


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return assign_shards(docs.select("doc_id"), F.col("doc_id"), SHARDS)


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(find_secrets(_table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = encode_and_check(docs.select("doc_id", "text"), PieceVocabulary.load())
    return out.select("doc_id", "n_tokens", "token_ids", "decoded_sha256", "round_trip")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mark_leaks(docs, find_leaks(docs, _table(spark, sf_dir, "benchmark"))).withColumnRenamed("id", "doc_id")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = merkle_manifest(docs, tampered=remainder("doc_id", 3) == 0)
    return out.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").filter(remainder("doc_id", 5) != 0)
    out = score_toxicity(docs.select("doc_id", "text"), fit_toxicity_model(docs, labels))
    return out.select(
        "doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        F.col("toxicity_score").alias("score"), F.col("toxicity_label").alias("predicted"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_sharding": op4_sharding,
    "op5_document_fingerprints": op5_document_fingerprints,
    "op6_secret_scans": op6_secret_scans,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_html_extraction": op10_html_extraction,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_toxicity": op12_toxicity,
    "op13_source_divergence": op13_source_divergence,
}

ORACLES = {
    "op3_ngram_jaccard_join": oracles.JACCARD,
    "op4_sharding": oracles.sharding(SHARDS),
    "op6_secret_scans": oracles.SECRETS,
    "op7_substring_dedup": oracles.REPEATS,
    "op11_merkle_manifest": oracles.MERKLE,
    "op13_source_divergence": oracles.DIVERGENCE,
}
