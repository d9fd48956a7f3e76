"""Values that are computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind value to a name, so that a lambda in body may use it without evaluating it for each element."""
    return F.transform(F.array(value), body)[0]


def rows_of(df: DataFrame, keep: list[str], values: Column, name: str, position: str | None = None) -> DataFrame:
    """A row for each value of an array that holds no null; null and empty arrays give none.

    Spark puts a check of the array's size before an inner explode, which computes a costly array twice.
    """
    made = F.posexplode_outer(values).alias(position, name) if position else F.explode_outer(values).alias(name)
    return df.select(*keep, made).where(F.col(position or name).isNotNull())
