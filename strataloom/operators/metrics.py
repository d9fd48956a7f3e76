"""Metric queries and roll-ups over fact tables.

Every function takes DataFrames and column names and returns a DataFrame. Amounts are summed exactly, ratios
are null over a zero denominator, orders are total, and dates come from parameters, never from the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions.numbers import rounded, ratio
from strataloom.functions.storage import materialise


def change_between(df: DataFrame, entity: str, period: str, value: str, first: str, second: str) -> DataFrame:
    """Two periods of each entity side by side, difference and change in percent; entities must have both."""
    a = df.where(F.col(period) == first).select(entity, F.col(value).alias("base_value"))
    b = df.where(F.col(period) == second).select(entity, F.col(value).alias("compare_value"))
    diff = F.col("compare_value") - F.col("base_value")
    return a.join(b, entity).select(entity, "base_value", "compare_value", rounded(diff, 2).alias("diff"), ratio(diff, F.col("base_value"), 2, 100.0).alias("pct"))


def periods_as_columns(df: DataFrame, entity: str, period: str, value: Column, periods: list[str], prefix: str = "p_") -> DataFrame:
    """One column for each period, null where it has no rows; a fixed list keeps the plan to one shuffle."""
    aggs = [F.sum(F.when(F.col(period) == p, value)).cast("double").alias(prefix + p.replace("-", "_")) for p in periods]
    return df.where(F.col(period).isin(periods)).groupBy(entity).agg(*aggs)


def change_over_time(series: DataFrame, order: str, value: str, lag: int = 1, keys: list[str] | None = None) -> DataFrame:
    """Difference and change in percent against `lag` rows before."""
    w = Window.partitionBy(*(keys or [])).orderBy(order)
    before = F.lag(value, lag).over(w)
    out = series.withColumn("before", before)
    diff = F.col(value) - F.col("before")
    return out.withColumn("diff", rounded(diff, 2)).withColumn("pct", ratio(diff, F.col("before"), 2, 100.0))


def with_share(df: DataFrame, value: str, keys: list[str] | None = None, digits: int = 2, name: str = "share_pct") -> DataFrame:
    """Percent of the total, or of the group's total; totals come from an aggregate, not from one task's window."""
    if not keys:
        whole = df.agg(F.sum(value).alias("__whole"))
        return df.crossJoin(F.broadcast(whole)).withColumn(name, ratio(F.col(value), F.col("__whole"), digits, 100.0)).drop("__whole")
    return df.withColumn(name, ratio(F.col(value), F.sum(value).over(Window.partitionBy(*keys)), digits, 100.0))


def pareto(df: DataFrame, key: str) -> DataFrame:
    """Count, percent and cumulative percent by falling count; ties by key, one row at a time.

    Keys are ordered across partitions, so that each runs up its own, on top of the sums of those before it: only
    one number for each partition goes through a window of all.
    """
    counts = df.groupBy(key).agg(F.count("*").alias("cnt"))
    parted = materialise(counts.orderBy(F.desc("cnt"), F.asc(key)).withColumn("part", F.spark_partition_id()), "ordered")
    run = Window.rowsBetween(Window.unboundedPreceding, 0)
    sums = parted.groupBy("part").agg(F.sum("cnt").alias("own"))
    ahead = sums.select("part", (F.sum("own").over(run.orderBy("part")) - F.col("own")).alias("ahead"))
    own = F.sum("cnt").over(run.partitionBy("part").orderBy(F.desc("cnt"), F.asc(key)))
    running = with_share(parted, "cnt", digits=1, name="pct").withColumn("own", own).join(F.broadcast(ahead), "part").withColumn("running", F.col("own") + F.col("ahead"))
    whole = parted.agg(F.sum("cnt").alias("whole"))
    return running.crossJoin(F.broadcast(whole)).select(key, "cnt", "pct", ratio(F.col("running"), F.col("whole"), 1, 100.0).alias("cum_pct"))


def volatility(df: DataFrame, key: str, period: str, value: Column, calm: float = 10.0, wild: float = 30.0) -> DataFrame:
    """Mean, population deviation, peak, trough and their ratio in percent over the sums of periods."""
    sums = df.groupBy(key, period).agg(F.sum(value).cast("double").alias("v"))
    out = sums.groupBy(key).agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.max("v").alias("peak"), F.min("v").alias("trough"), F.count("*").alias("periods"))
    cv = 100 * F.col("s") / F.when(F.col("m") != 0, F.col("m"))
    label = F.when(cv < calm, "stable").when(cv < wild, "moderate").otherwise("volatile")
    return out.select(key, "periods", rounded(F.col("m"), 1).alias("mean"), rounded(F.col("s"), 1).alias("deviation"), "peak", "trough", rounded(cv, 1).alias("cv_pct"), label.alias("label"))


def durations(df: DataFrame, keys: list[str], start: str, end: str, as_of: str) -> DataFrame:
    """Average, shortest and longest difference in days; open rows end at as_of."""
    days = F.datediff(F.coalesce(F.col(end).cast("date"), F.lit(as_of).cast("date")), F.col(start).cast("date"))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), ratio(F.sum(days), F.count(days), 1).alias("avg_days"), F.min(days).cast("long").alias("min_days"), F.max(days).cast("long").alias("max_days"))


def ratio_at_grain(num: DataFrame, den: DataFrame, grain: list[str], num_value: str, den_value: str, digits: int = 2) -> DataFrame:
    """Sums of two facts, brought to the same grain before they are joined; keys of the first stay."""
    a = num.groupBy(*grain).agg(F.sum(num_value).cast("double").alias("numerator"))
    b = den.groupBy(*grain).agg(F.sum(den_value).cast("double").alias("denominator"))
    return a.join(b, grain, "left").select(*grain, "numerator", "denominator", ratio(F.col("numerator"), F.col("denominator"), digits).alias("value"))


def composition(df: DataFrame, period: str, category: str, value: Column, categories: list[str]) -> DataFrame:
    """Wide composition of each period in percent."""
    aggs = [F.sum(F.when(F.col(category) == c, value).otherwise(0)).alias(f"__{i}") for i, c in enumerate(categories)]
    sums = df.groupBy(period).agg(F.sum(value).cast("double").alias("whole"), *aggs)
    return sums.select(period, "whole", *(ratio(F.col(f"__{i}"), F.col("whole"), 2, 100.0).alias(f"{c.lower().replace('-', '_').replace(' ', '_')}_pct") for i, c in enumerate(categories)))


def outer_union_of_keys(a: DataFrame, b: DataFrame, keys: list[str], zero: list[str]) -> DataFrame:
    """Rows of both aggregates at a common grain, absent measures as 0."""
    return a.join(b, keys, "full_outer").fillna(0, zero)


def rfm(orders: DataFrame, user: str, when: str, amount: Column, paid: Column, as_of: str, window_days: int = 90) -> DataFrame:
    """Recency, frequency and money of each user up to as_of, and a segment."""
    age = F.datediff(F.lit(as_of).cast("date"), F.col(when).cast("date"))
    recent = age <= window_days
    out = orders.groupBy(user).agg(F.min(age).cast("long").alias("recency_days"), F.count_if(recent).alias("frequency"), F.coalesce(F.sum(F.when(recent & paid, amount)).cast("double"), F.lit(0.0)).alias("monetary"))
    r, f, m = F.col("recency_days"), F.col("frequency"), F.col("monetary")
    segment = F.when((r <= 14) & (f >= 8) & (m >= 3000), "high_value").when((r <= 30) & (f >= 4), "steady").when((r > 60) & (f <= 1), "dormant").otherwise("ordinary")
    return out.withColumn("segment", segment)


def calendar(spark, first: str, last: str) -> DataFrame:
    """One row for each day as a string."""
    days = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return spark.range(1).select(F.explode(days).alias("d")).select(F.col("d").cast("string").alias("dt"))
