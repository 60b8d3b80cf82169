"""I-Match document fingerprints over several randomised lexicons.

Terms (lower-case, split at white space) are kept if their document frequency is in a
band; the distinct kept terms, sorted, are hashed once for each random subset of the
lexicon. The likeness of two fingerprints is the share of equal hashes among subsets
that are not empty in both.
"""

from __future__ import annotations

import bisect
import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sha256_hex, text_slices

#: Shares of the lexicon that the random subsets hold; PER_RATE subsets have each share.
RATES = (1 / 3, 1 / 8, 1 / 20, 1 / 50, 1 / 128, 1 / 400, 1 / 1500)
PER_RATE = 12
SUBSETS = len(RATES) * PER_RATE
#: Hexadecimal digits of one subset's hash; an empty subset has as many dashes.
DIGITS = 4


def terms(text: str) -> set[str]:
    return set(text.lower().split())


def _draw(term: str) -> tuple[int, np.ndarray]:
    """A term's digest, and the subsets that it belongs to; both depend on the term alone."""
    raw = term.encode("utf-8", "replace")
    lots = np.frombuffer(hashlib.shake_256(raw).digest(2 * SUBSETS), "<u2").astype(np.uint32)
    limits = np.repeat(np.array([int(65536 * r) for r in RATES], np.uint32), PER_RATE)
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little"), lots < limits


@dataclass
class Lexicon:
    """The terms in the band, in order, with their digests and subsets."""

    ids: dict[str, int]
    digests: np.ndarray
    member: np.ndarray

    @staticmethod
    def of(words: list[str]) -> Lexicon:
        words = sorted(words)
        drawn = [_draw(w) for w in words]
        return Lexicon(
            {w: i for i, w in enumerate(words)}, np.array([d for d, _ in drawn], np.uint64),
            np.array([m for _, m in drawn], bool).reshape(-1, SUBSETS),
        )

    def fingerprint(self, text: str) -> str:
        """A text without terms in the band, as an empty one, has an all-dash fingerprint."""
        get = self.ids.get
        at = np.sort(np.array([i for w in terms(text) if (i := get(w)) is not None], np.int64))
        digests, member = self.digests[at], self.member[at]
        parts = []
        for j, some in enumerate(member.any(0).tolist()):
            if some:
                chosen = digests[member[:, j]].tobytes()
                parts.append(hashlib.blake2b(chosen, digest_size=DIGITS // 2).hexdigest())
            else:
                parts.append("-" * DIGITS)
        return "".join(parts)


def likeness(a: str, b: str) -> float:
    """0 to 1; equal fingerprints are wholly alike, those of two texts without terms in the band too."""
    if a == b:
        return 1.0
    pairs = [(a[i : i + DIGITS], b[i : i + DIGITS]) for i in range(0, len(a), DIGITS)]
    held = [(x, y) for x, y in pairs if x[0] != "-" or y[0] != "-"]
    return sum(x == y for x, y in held) / max(len(held), 1)


def document_frequencies(docs: DataFrame, *, flush: int = 300_000, slice_bytes: int = 4 << 20) -> DataFrame:
    """(term, n): in how many texts each term is. Counted within each task first; a task
    holds at most about ``flush`` terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

        for _, texts in text_slices(batches, slice_bytes, "__girasol_text"):
            for text in texts:
                counts.update(terms(text))
            if len(counts) > flush:
                yield out()
                counts.clear()
        if counts:
            yield out()

    source = docs.select(F.col("text").cast("string").alias("__girasol_text"))
    return source.mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, *, least: float = 0.001, most: float = 0.02, limit: int = 2_000_000) -> Lexicon:
    """Terms whose document frequency is at least 2 and a share ``least`` of the rows, and at
    most the share ``most``.

    The share bounds the lexicon: there are no more such terms than a text's mean number
    of different terms over ``least``, whatever the number of documents. ``limit`` only
    guards the driver: beyond it the function raises instead of cutting terms off.
    """
    rows = docs.count()
    band = document_frequencies(docs).where((F.col("n") >= max(2.0, least * rows)) & (F.col("n") <= max(2.0, most * rows)))
    words = band.select("term").limit(limit + 1).toArrow().column("term").to_pylist()
    if len(words) > limit:
        raise ValueError(f"more than {limit} terms in the band: raise `least`")
    return Lexicon.of(words)


def with_next(docs: DataFrame, *, rows_a_block: int = 2048, blocks: int = 4096, sample: int = 65_536) -> DataFrame:
    """(doc_id, text) in blocks of descending ids: _block, _copy, doc_id, _text.

    Rows follow each other by falling id, null last, then by a hash of the text. Each block ends with a copy
    of the row that comes next (after the last: the first), so a block can be streamed row by row without
    the others. Blocks are even in rows, whatever the ids: their edges are taken from about ``sample`` rows,
    and rows of one id may be parted by their texts; only rows that repeat an id and its text stay together.
    There are at most ``blocks`` blocks, so that many edges reach the driver.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("__girasol_text"), F.xxhash64(text).alias("_hash"))
    n = docs.count()
    count = max(1, min(blocks, n // rows_a_block + 1))
    share = F.pmod(F.xxhash64("doc_id", "_hash", F.lit(7)), F.lit(1 << 30)).cast("double") * F.lit(float(n)) < F.lit(float(sample) * (1 << 30))
    drawn = source.select("doc_id", "_hash").where(share).distinct().limit(4 * sample) if count > 1 else None
    edges = _edges([tuple(r) for r in drawn.collect()], count) if drawn is not None else []

    @F.pandas_udf("int")
    def block(ids: pd.Series, hashes: pd.Series, missing: pd.Series) -> pd.Series:
        places = zip(missing.tolist(), ids.tolist(), hashes.tolist())
        return pd.Series([bisect.bisect_right(edges, (m, -i, h)) for m, i, h in places], dtype="int32")

    own = block(F.coalesce("doc_id", F.lit(0).cast("long")), "_hash", F.col("doc_id").isNull()) if edges else F.lit(0)
    blocked = source.withColumn("_block", own)
    order = F.struct(F.col("doc_id").isNull().alias("m"), F.coalesce(-F.col("doc_id").cast("decimal(20,0)"), F.lit(0)).alias("i"), F.col("_hash").alias("h"))
    heads = sorted((r["_block"], r.head) for r in blocked.groupBy("_block").agg(F.min(order).alias("head")).collect())
    to = [(None if head.m else int(-head.i), head.h, heads[k - 1][0]) for k, (_, head) in enumerate(heads)]
    firsts = F.broadcast(docs.sparkSession.createDataFrame(to, "_id long, _print long, _to int"))
    copies = source.join(firsts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_print")))
    copies = copies.select("doc_id", "__girasol_text", "_hash", F.col("_to").alias("_block"), F.lit(True).alias("_copy"))
    both = blocked.select("doc_id", "__girasol_text", "_hash", "_block", F.lit(False).alias("_copy")).unionByName(copies)
    return both.repartition("_block").sortWithinPartitions("_block", "_copy", F.desc_nulls_last("doc_id"), "_hash", "__girasol_text").drop("_hash")


def _edges(drawn: list[tuple], count: int) -> list[tuple]:
    """Places that part a sample of (id, hash) evenly into ``count``."""
    places = sorted((i is None, 0 if i is None else -i, h) for i, h in drawn)
    return sorted({places[k * len(places) // count] for k in range(1, count)}) if places else []


def edited(text: str, after: str) -> str:
    """The last half (rounded down) replaced by as many characters of the next text's start."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def fingerprint_documents(docs: DataFrame, lexicon: Lexicon, *, slice_bytes: int = 4 << 20) -> DataFrame:
    """One row a document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.

    The next document is the one with the next lower id (rows with equal ids follow each
    other by a hash of the text; null ids come last); after the last comes the first. Null texts are
    empty. Equal texts have equal fingerprints.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, last = shared.value, None
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for part, texts in text_slices(batches, slice_bytes, "__girasol_text"):
            rows = []
            blocks, ids, copies = (part.column(c).to_pylist() for c in ("_block", "doc_id", "_copy"))
            for block, doc_id, copy, text in zip(blocks, ids, copies, texts):
                # Of a block's copies only the first, the row next to the block's last, counts.
                if copy and (last is None or last[0] != block):
                    continue
                own = lexicon.fingerprint(text)
                if last is not None and last[0] == block:
                    other = edited(last[2], text)
                    print_ = lexicon.fingerprint(other)
                    sha = sha256_hex(other.encode("utf-8", "replace"))
                    rows.append((last[1], len(last[2]), sha, last[3], print_, likeness(last[3], print_), likeness(last[3], own)))
                last = None if copy else (block, doc_id, text, own)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * 7, types)], names=names)

    return with_next(docs).mapInArrow(run, schema)
