"""Small numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tidy(column: Column | str, digits: int = 6) -> Column:
    """Round for comparison between engines, without a negative zero."""
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value.cast("double"), digits) + F.lit(0.0)


def clip(value: Column, low: Column | float, high: Column | float) -> Column:
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    return F.least(F.greatest(value, low), high)


def hash_order(seed: int | str, *columns: Column | str) -> Column:
    """A repeatable pseudo-random key of a row; independent of partitioning."""
    parts = [F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]]
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def hash_int(seed: int | str, *columns: Column | str) -> Column:
    """The first 32 bits of ``hash_order`` as a number."""
    return F.conv(F.substring(hash_order(seed, *columns), 1, 8), 16, 10).cast("bigint")
