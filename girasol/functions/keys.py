"""Deterministic random order: a keyed hash instead of a generator's draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from girasol.functions import vec


def hkey(seed: int, *ids: Column) -> Column:
    """md5 of 'seed:id[:id...]': an order that any engine and any partitioning reproduces."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[i.cast("string") for i in ids]).cast("binary"))


def normals(seed: int, n: Column, *ids: Column) -> Column:
    """n values of a standard normal distribution: two of the key's 32-bit parts make two of them."""

    def pair(k: Column) -> Column:
        part = lambda h, at: F.conv(F.substring(h, at, 8), 16, 10).cast("double")
        radius = lambda h: F.sqrt(-2 * F.log((part(h, 1) + 1) / F.lit(4294967296.0)))
        angle = lambda h: 2 * F.pi() * (part(h, 9) / F.lit(4294967296.0))
        polar = vec.bound(hkey(seed, *ids, k), lambda h: F.struct(radius(h).alias("r"), angle(h).alias("a")))
        return vec.bound(polar, lambda p: F.array(p["r"] * F.cos(p["a"]), p["r"] * F.sin(p["a"])))

    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(n / 2).cast("int") - 1, F.lit(0))), pair)
    return F.slice(F.flatten(pairs), F.lit(1), n)


def fraction(seed: int, *ids: Column) -> Column:
    """The key's first 32 bits as a number in [0, 1)."""
    return F.conv(F.substring(hkey(seed, *ids), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
