"""What the training-data operators share: table access, folds and Arrow text batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_held_out(doc_id: Column) -> Column:
    """The fold that no model learns from: crc32 of the id's text, mod 5, is 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def text_slices(
    batches: Iterator[pa.RecordBatch], max_bytes: int, column: str = "text"
) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut Arrow batches by text size, so that memory does not depend on rows a batch.

    A row is never split: a text beyond ``max_bytes`` is a slice of its own.
    Nulls come out as empty strings; the batch still tells them apart.
    """
    for batch in batches:
        at = batch.schema.get_field_index(column)
        col = batch.column(at)
        sizes = pc.fill_null(pc.binary_length(col), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and held + n > max_bytes:
                part = batch.slice(start, i - start)
                yield part, [x or "" for x in part.column(at).to_pylist()]
                start, held = i, 0
            held += n
        if start < len(sizes):
            part = batch.slice(start)
            yield part, [x or "" for x in part.column(at).to_pylist()]
