"""Queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hardneg, imatch, langid, linededup, mixing, ngramjoin, oracles, quality, secrets, suffixdedup, toxicity, whitening
from .bpe import encode_documents
from .common import is_held_out, table


def op1_byte_conv_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs, langid.train(docs), keep=["doc_id"])
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_secret_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.link_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixdedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return imatch.fingerprint_documents(docs, imatch.build_lexicon(docs))


def op7_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model, keep=["doc_id"])


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), keep=["doc_id"])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op10_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_documents(docs, model, keep=["doc_id"])
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vector")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(e.select("vec_id", label.alias("label"), "vector"), F.col("vec_id") % 50 == 0)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    model = whitening.fit(e)
    return whitening.components_of(whitening.whiten(e, model, keep=["vec_id"]), model, "vec_id")


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


QUERIES = {f.__name__: f for f in (
    op1_byte_conv_langid, op2_secret_battery, op3_spaced_seed_decontamination, op4_ngram_jaccard, op5_suffix_dedup, op6_imatch_fingerprints, op7_ordinal_toxicity, op8_byte_bpe, op9_line_dedup, op10_quality_qda,
    op11_hard_negatives, op12_embedding_whitening, op13_source_mix,
)}
ORACLE_SQL: dict[str, str] = {
    "op3_spaced_seed_decontamination": oracles.OP3_SPACED_SEED_DECONTAMINATION,
    "op4_ngram_jaccard": oracles.OP4_NGRAM_JACCARD,
    "op9_line_dedup": oracles.OP9_LINE_DEDUP,
    "op11_hard_negatives": oracles.OP11_HARD_NEGATIVES,
    "op13_source_mix": oracles.OP13_SOURCE_MIX,
}
