"""The training-data pipeline over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame: low-quality texts go, near-
duplicate lines are removed, one document of each group of near duplicates stays, documents
that hold benchmark passages go, and the rest is encoded. Stages work on whole texts and on
all that the stage before kept. All but the last return the columns that they were given.
Null and empty texts, repeated rows and further columns are as each operator defines them; a
document whose lines were all removed stays, with an empty text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girasol.llm import bpe, decontaminate, linededup, ngramjoin, quality
from girasol.llm.common import table
from girasol.session import shared_folder


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score_documents(docs, model).where("predicted = 1").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that match an earlier one; n_chars follows the text."""
    found = linededup.dedup_lines(docs).select(docs.columns)
    if "n_chars" not in docs.columns:
        return found
    return found.withColumn("n_chars", F.length(F.col("text")).cast(docs.schema["n_chars"].dataType))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group that shares four fifths of its five-word grams."""
    return ngramjoin.first_of_groups(docs, size=5, percent=80, staged=True, bitmap_words=16, slice_bytes=1 << 18)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, token_ids and token_ends."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_documents(docs, path, keep=["doc_id"], with_ids=True, slice_bytes=1 << 18, cache_limit=100_000)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]
#: SQL can't express the stages; tests/llm holds them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What the others return is written as Parquet in the shared checkpoint
    folder and read again, so that no stage is computed twice."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
