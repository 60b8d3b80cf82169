"""Text and token expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(t: Column) -> Column:
    """Cut all Unicode white space at both ends, as Spark's trim does not."""
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def normal_form(t: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(t), r"\s+", " "))


def tokens(t: Column) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.regexp_extract_all(F.lower(t), F.lit("[a-z0-9]+"), F.lit(0))


def words(t: Column) -> Column:
    """Parts between white space; none for an empty text."""
    return F.filter(F.split(t, r"\s+"), lambda w: w != "")


def token_ids(t: Column, vocabulary: int = 65536) -> Column:
    """A number for each token of a text."""
    return numbers(tokens(t), vocabulary)


def numbers(words: Column, vocabulary: int = 65536) -> Column:
    """The first 32 bits of a token's md5, modulo the vocabulary."""
    return F.transform(words, lambda w: (F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("long") % vocabulary).cast("int"))


def span_hash(ids: Column, digits: int = 16) -> Column:
    """The first hexadecimal digits of the sha1 of 32-bit little-endian ids."""

    def little(x: Column) -> Column:
        h = F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")
        return F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)])

    return F.substring(F.sha1(F.unhex(F.array_join(F.transform(ids, little), ""))), 1, digits)


def windows(ids: Column, size: int, *, keep_tail: bool = False) -> Column:
    """Consecutive slices of ``size``; a shorter last one is dropped unless kept."""
    n = F.size(ids)
    count = F.ceil(n / F.lit(size)) if keep_tail else F.floor(n / F.lit(size))
    last = count.cast("int") - 1
    every = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(ids, i * size + 1, F.lit(size)))
    return F.when(last >= 0, every).otherwise(F.slice(every, 1, 0))


def span(ids: Column, at: Column, most: int) -> Column:
    """The up to ``most`` values that end at the zero-based place ``at``."""
    start = F.greatest(at - most + 1, F.lit(0))
    return F.slice(ids, start + 1, at - start + 1)


def type_token_ratio(parts: Column, least: int = 4) -> Column:
    """Distinct over all; 1 with fewer than ``least``."""
    return F.when(F.size(parts) < least, 1.0).otherwise(F.size(F.array_distinct(parts)) / F.size(parts))


def first_integer(t: Column, low: int = 0, high: int = 100) -> Column:
    """The first integer of a reply, clamped; NULL without one."""
    found = F.try_to_number(F.nullif(F.regexp_extract(t, r"\d{1,9}", 0), F.lit("")), F.lit("999999999")).cast("int")
    return F.when(found.isNotNull(), F.greatest(F.least(found, F.lit(high)), F.lit(low)))
