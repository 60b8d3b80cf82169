"""Vector expressions on ARRAY columns; all arithmetic is in doubles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def scale(v: Column, by: Column) -> Column:
    return F.transform(doubles(v), lambda x: x * by)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where the value is made once however often f names it, in lambdas too."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def unit(v: Column) -> Column:
    """NULL for a zero vector."""
    return bound(doubles(v), lambda d: bound(norm(d), lambda n: F.when(n > 0, F.transform(d, lambda x: x / n))))


def centred(v: Column, mean: Column) -> Column:
    return F.zip_with(doubles(v), doubles(mean), lambda x, m: x - m)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def is_finite(v: Column) -> Column:
    """No NULL, NaN or infinity among the values."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return v.isNotNull() & ~F.exists(doubles(v), bad)


def block_norms(v: Column, width: int) -> Column:
    """Norms of consecutive blocks of ``width`` values."""
    blocks = F.sequence(F.lit(0), F.floor(F.size(v) / F.lit(width)).cast("int") - 1)
    return F.transform(blocks, lambda g: norm(F.slice(v, g * width + 1, F.lit(width))))


def relu_encode(x: Column, w: Column, b_enc: Column, b_dec: Column | None = None, threshold: float | None = None) -> Column:
    """relu((x - b_dec) . w + b_enc); with a threshold, 0 up to and including it."""
    a = F.greatest(F.lit(0.0), dot(centred(x, b_dec) if b_dec is not None else x, w) + b_enc)
    return a if threshold is None else F.when(a > threshold, a).otherwise(0.0)
