"""An inverted index with places: for a token, where it occurs in which document.

A token's occurrences are lists of differences, each within a block of neighbouring documents, so a token of
all documents is many rows of bounded size. Rows are parted by a hash of the token: a lookup reads the parts
of what it wants and no others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


#: Places that one step of a task packs at most, beyond its last document.
STEP = 1 << 20


def _packed(span: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (doc, tokens) to rows of the index: what a step's documents have of a token in one block."""

    def rows(docs: np.ndarray, lists: pa.Array) -> pa.RecordBatch:
        sizes = np.diff(lists.offsets.to_numpy())
        words = lists.flatten()
        doc, place = np.repeat(docs, sizes), np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        kept = np.flatnonzero(words.is_valid().to_numpy(zero_copy_only=False))
        coded = words.take(pa.array(kept)).dictionary_encode()
        code, doc, place = coded.indices.to_numpy(), doc[kept], place[kept]
        order = np.lexsort((place, doc, code))
        code, doc, place = code[order], doc[order], place[order]
        block = doc // span
        new = np.r_[True, (code[1:] != code[:-1]) | (block[1:] != block[:-1])] if len(code) else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        back = np.r_[0, doc[:-1]][: len(doc)]
        docs_by = np.where(new, 0, doc - back)
        places_by = np.where(new | (docs_by != 0), place, place - np.r_[0, place[:-1]][: len(place)])
        offsets = pa.array(np.r_[starts, len(code)].astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [coded.dictionary.take(pa.array(code[starts])), pa.array(block[starts]), pa.array(np.diff(np.r_[starts, len(code)]).astype(np.int32)), pa.array(doc[starts]),
             pa.ListArray.from_arrays(offsets, pa.array(docs_by)), pa.ListArray.from_arrays(offsets, pa.array(places_by.astype(np.int32)))],
            names=["tok", "block", "n", "first", "docs", "places"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, lists = batch.column(0).to_numpy(), batch.column(1)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(docs):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, side="right")))
                yield rows(docs[at:to], pa.concat_arrays([lists.slice(at, to - at)]))
                at = to

    return run


def write_index(docs: DataFrame, key: str, tokens: Column, path: str, *, buckets: int = 256, span: int = 4096, spread: int = 4) -> None:
    """Index the array ``tokens`` of documents by the whole number ``key``.

    A row has places in documents of one block of ``span`` neighbouring keys, as many as a task met in one step; a
    block may be several rows. They are made where documents are read, so only packed lists are shuffled. A part
    is written by ``spread`` tasks. Documents without a key, and null tokens, have no places. A key that is
    there twice has the places of both."""
    found = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), tokens.alias("toks"))
    kind = found.schema["toks"].dataType.elementType.simpleString()
    rows = found.mapInArrow(_packed(span), f"tok {kind}, block long, n int, first long, docs array<long>, places array<int>").withColumn("bucket", _bucket(F.col("tok"), buckets))
    dealt = rows.repartition(F.col("bucket"), F.pmod(F.col("block"), F.lit(spread))).sortWithinPartitions("bucket", "tok", "block")
    dealt.write.partitionBy("bucket").parquet(f"{path}/data")
    docs.sparkSession.createDataFrame([(buckets, span)], "buckets int, span int").write.parquet(f"{path}/meta")


def blocks_of(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The index's rows of the tokens of ``wanted`` (tok), out of their parts only."""
    buckets = spark.read.parquet(f"{path}/meta").first()["buckets"]
    asked = wanted.select("tok").where("tok IS NOT NULL").distinct()
    parts = [r[0] for r in asked.select(_bucket(F.col("tok"), buckets)).distinct().collect()]
    return spark.read.parquet(f"{path}/data").where(F.col("bucket").isin(parts)).join(asked, "tok", "left_semi")


def counts(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(tok, n, first_doc) without a look at the places."""
    return blocks_of(spark, path, wanted).groupBy("tok").agg(F.sum("n").alias("n"), F.min("first").alias("first_doc"))


def places(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(tok, doc, place): all occurrences of the tokens of ``wanted`` (tok)."""
    found = blocks_of(spark, path, wanted).select("tok", "first", "docs", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                docs, places = (batch.column(i).slice(k, 1).flatten().to_numpy(zero_copy_only=False) for i in (2, 3))
                new = np.flatnonzero(docs != 0)
                new = new if len(new) and new[0] == 0 else np.r_[0, new]
                total = np.cumsum(places, dtype=np.int64)
                # A document's first place is itself, the others are differences.
                back = np.repeat(total[new] - places[new], np.diff(np.r_[new, len(places)]))
                token = batch.column(0).slice(k, 1).take(pa.array(np.zeros(len(docs), np.int64)))
                yield pa.RecordBatch.from_arrays([token, pa.array(batch.column(1)[k].as_py() + np.cumsum(docs, dtype=np.int64)), pa.array(total - back)], names=["tok", "doc", "place"])

    kind = found.schema["tok"].dataType.simpleString()
    return found.mapInArrow(run, f"tok {kind}, doc long, place long")
