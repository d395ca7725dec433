"""Draws that depend on a key and a seed alone: the same on every partitioning, and in SQL."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: str, *key: Column) -> Column:
    """A number in [0, 1): the first 32 bits of md5('seed-key'), as a share of 2**32."""
    text = F.concat_ws("-", F.lit(seed), *[k.cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def lowest(n: int, most: int) -> int:
    """A signed 64-bit hash that ``most`` of ``n`` rows, and some to spare, do not exceed; the largest there is where those are all."""
    share = (most + 6 * most**0.5 + 10) / n
    return int(((1 << 64) - 1) * share) - (1 << 63) if share < 1 else (1 << 63) - 1
