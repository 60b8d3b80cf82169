"""A learning rate that warms up linearly and falls as a cosine, and its sum in closed form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lr_at(step: Column, warm: Column, total: Column) -> Column:
    """The rate at a step from 1 to total, as a share of the highest."""
    falling = 0.5 * (1 + F.cos(F.pi() * (step - warm) / (total - warm)))
    return F.when(step <= warm, step / warm).otherwise(falling)


def cum_lr(step: Column, warm: Column, total: Column) -> Column:
    """The sum of the rates up to a step: a triangle, then half the steps and half a sum of cosines."""
    up = F.least(step, warm)
    down, n = F.greatest(step - warm, F.lit(0)), total - warm
    cosines = F.sin(F.pi() * (down + 0.5) / n) / (2 * F.sin(F.pi() / (2 * n))) - 0.5
    return up * (up + 1) / (2 * warm) + F.when(down > 0, down / 2 + cosines / 2).otherwise(0.0)
