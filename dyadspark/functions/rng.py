"""Reproducible draws: a hash of seed and position, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGE = 4294967296


def draw(seed: int, *position: Column) -> Column:
    """A uniform integer below 2**32."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in position])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def bernoulli(p: Column | float, seed: int, *position: Column) -> Column:
    return draw(seed, *position) < (F.lit(p) if isinstance(p, float | int) else p) * RANGE
