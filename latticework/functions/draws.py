"""Random numbers that depend on a seed and a place alone, so on no partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, sample: Column, idx: Column, tag: str) -> Column:
    """Between 0 and 1, from 48 bits of a digest."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), sample.cast("string"), idx.cast("string"), F.lit(tag)))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def normal(seed: int, sample: Column, idx: Column, tag: str = "") -> Column:
    """Standard normal, by Box and Muller; tag tells the parts of a complex draw apart."""
    return F.sqrt(-2 * F.ln(uniform(seed, sample, idx, tag + "a"))) * F.cos(2 * math.pi * uniform(seed, sample, idx, tag + "b"))
