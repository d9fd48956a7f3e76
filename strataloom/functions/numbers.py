"""Column expressions whose results do not depend on the order of addition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(x: Column | str) -> Column:
    """Exact two-digit decimal, so that sums do not depend on partitions."""
    return (F.col(x) if isinstance(x, str) else x).cast("decimal(18,2)")


def total(x: Column | str) -> Column:
    """Exact sum of two-digit amounts, as double."""
    return F.sum(money(x)).cast("double")


def rounded(x: Column, digits: int) -> Column:
    """Half-up rounding of doubles by floor, the same in any engine."""
    return F.floor(x * 10.0**digits + 0.5) / 10.0**digits


def ratio(a: Column, b: Column, digits: int, factor: float = 1.0) -> Column:
    """factor * a / b, null where b is 0 or null."""
    b = b.cast("double")
    return rounded(factor * a.cast("double") / F.when(b != 0, b), digits)


def day(x: str) -> Column:
    return F.col(x).cast("date").cast("string")


def month(x: str) -> Column:
    return F.substring(day(x), 1, 7)
