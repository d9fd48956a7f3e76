"""Column profiles of whole tables.

Columns of one type are profiled together: they are unpivoted to (column, value) in their own type, counted, and
turned into text only then, once for each distinct value. Counting combines in the tasks first, which bounds what a
skewed column shuffles; of long texts only a head and 128 bits of hash are shuffled. Every measure is an aggregate
of the counts by column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.functions.numbers import ratio, rounded
from strataloom.functions.storage import materialise


def type_class(declared: Column) -> Column:
    """numeric, datetime, text or other, by what the declared type contains."""
    low = F.lower(declared)
    lists = low.rlike("enum|set")
    return (
        F.when(low.rlike("date|time") & ~lists, "datetime")
        .when(low.rlike("int|numeric|decimal|float|double|real") & ~lists, "numeric")
        .when(low.rlike("char|text|string|enum|set"), "text")
        .otherwise("other")
    )


#: Characters of a value that are counted as they are; of longer ones a head of this length and a hash of the whole.
HEAD = 80


def families(df: DataFrame, columns: list[str]) -> list[tuple[T.DataType, list[str]]]:
    """Columns by type, with all integers as one."""
    found: dict[T.DataType, list[str]] = {}
    for c in columns:
        kind = df.schema[c].dataType
        kind = T.LongType() if isinstance(kind, T.IntegralType) else T.StringType() if isinstance(kind, (T.CharType, T.VarcharType)) else kind
        found.setdefault(kind, []).append(c)
    return list(found.items())


def unpivot(df: DataFrame, kind: T.DataType, columns: list[str]) -> DataFrame:
    """(col, x) for every cell of columns of one type."""
    return df.select(*(F.col(f"`{c}`").cast(kind).alias(c) for c in columns)).unpivot([], [F.col(f"`{c}`") for c in columns], "col", "x")


def marks(x: Column, head: int | None) -> tuple[Column, Column]:
    """Two hashes of a text that is longer than head; null for others."""
    long = F.lit(False) if head is None else F.length(x) > head
    return F.when(long, F.xxhash64(x)), F.when(long, F.xxhash64(F.lit(1), x))


def value_counts(df: DataFrame, columns: list[str] | None = None, head: int | None = HEAD) -> DataFrame:
    """(col, value, mark, other_mark, n) for each distinct value as text, nulls included.

    Of texts longer than head characters value holds the head, and the marks tell them apart; other marks are null.
    Without a head values are whole. Negative zero is a value of its own, as its text is.
    """
    parts = []
    for kind, names in families(df, columns or df.columns):
        cells, x = unpivot(df, kind, names), F.col("x")
        if isinstance(kind, T.StringType):
            mark, other = marks(x, head)
            part = cells.groupBy("col", (x if head is None else F.substring(x, 1, head)).alias("value"), mark.alias("mark"), other.alias("other_mark")).agg(F.count("*").alias("n"))
        else:
            # grouping takes both zeros for one
            minus = F.when(x == 0, x.cast("string").startswith("-")) if isinstance(kind, T.FractionalType) else F.lit(None).cast("boolean")
            text = F.when(F.col("minus"), "-0.0").otherwise(x.cast("string"))
            none = F.lit(None).cast("long")
            part = cells.groupBy("col", "x", minus.alias("minus")).agg(F.count("*").alias("n")).select("col", text.alias("value"), none.alias("mark"), none.alias("other_mark"), "n")
        parts.append(part)
    return reduce(DataFrame.unionAll, parts)


def null_measures(rows: Column, null: Column) -> list[Column]:
    return [rows.alias("rows"), null.alias("null_count"), (rows - null).alias("non_null_count"), ratio(null, rows, 6).alias("null_ratio"), rounded(1 - null / F.when(rows > 0, rows), 6).alias("completeness")]


def nulls(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows and nulls of each column, in one aggregate of the table."""
    made = [F.struct(F.lit(c).alias("col"), F.count("*").alias("rows"), F.count_if(F.col(f"`{c}`").isNull()).alias("null")) for c in columns or df.columns]
    return df.agg(F.array(*made).alias("x")).select(F.inline("x")).select("col", *null_measures(F.col("rows"), F.col("null")))


def spectrum(counts: DataFrame) -> DataFrame:
    """(col, full, n, kinds): how many values of a column occur n times; full is false for null.

    A column of r rows has at most the root of 2 r rows here, so that what follows is small.
    """
    return counts.groupBy("col", F.col("value").isNotNull().alias("full"), "n").agg(F.count("*").alias("kinds"))


def distinct_measures(kinds: Column, full: Column) -> list[Column]:
    return [kinds.alias("distinct_count"), ratio(kinds, full, 6).alias("distinct_ratio"), rounded(1 - kinds / F.when(full > 0, full), 6).alias("duplicate_ratio")]


def distinct(counts: DataFrame) -> DataFrame:
    kinds, full = (F.sum(F.when(F.col("full"), x).otherwise(0)) for x in (F.col("kinds"), F.col("n") * F.col("kinds")))
    return spectrum(counts).groupBy("col").agg(*distinct_measures(kinds, full))


def top_values(df: DataFrame, counts: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent values of each column of df with rank and share, out of its counts; ties by value.

    The spectrum of the counts tells how often a value must occur. Of those that occur so often all are kept that are
    not behind k others by count and head, so none is lost where heads are equal. Only their whole texts are looked
    up, by their marks.
    """
    # filters of nulls would go below the counts, which then could not be shared with the spectrum
    upto = F.sum("kinds").over(Window.partitionBy("col", "full").orderBy(F.desc("n")))
    n = F.when(F.col("full"), F.col("n"))
    # one row for each column
    least = spectrum(counts).withColumn("upto", upto).groupBy("col").agg(F.coalesce(F.max(F.when(F.col("upto") >= k, n)), F.min(n)).alias("least"), F.sum(n * F.col("kinds")).alias("all"))
    often = counts.join(F.broadcast(least), "col").where(F.when(F.col("value").isNotNull(), F.col("n")) >= F.col("least"))
    ahead = F.rank().over(Window.partitionBy("col").orderBy(F.desc("n"), F.asc("value")))
    few = often.withColumn("ahead", ahead).where(F.col("ahead") <= k).select("col", "value", "mark", "other_mark", "n", "all")
    long = [c for kind, names in families(df, scalar_columns(df)) if isinstance(kind, T.StringType) for c in names]
    if long:
        few = materialise(few, "candidates")
        cells = unpivot(df, T.StringType(), long).where(F.length("x") > HEAD)
        mark, other = marks(F.col("x"), HEAD)
        asked = few.where(F.col("mark").isNotNull()).select("col", "mark", "other_mark", "n", "all")
        texts = cells.select("col", "x", mark.alias("mark"), other.alias("other_mark")).join(asked, ["col", "mark", "other_mark"]).groupBy("col", "mark", "other_mark", "n", "all").agg(F.min("x").alias("value"))
        few = few.where(F.col("mark").isNull()).unionByName(texts)
    place = F.row_number().over(Window.partitionBy("col").orderBy(F.desc("n"), F.asc("value")))
    return few.withColumn("rank", place).where(F.col("rank") <= k).select("col", "rank", "value", "n", ratio(F.col("n"), F.col("all"), 6).alias("share"))


def numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """min, max and mean, and the shares of zero and negative values."""
    made = [F.struct(F.lit(c).alias("col"), F.min(f"`{c}`").cast("double").alias("min"), F.max(f"`{c}`").cast("double").alias("max"), F.sum(F.col(f"`{c}`").cast("decimal(28,4)")).cast("double").alias("sum"), F.count(f"`{c}`").alias("n"), F.count_if(F.col(f"`{c}`") == 0).alias("zero"), F.count_if(F.col(f"`{c}`") < 0).alias("negative")) for c in columns]
    out = df.agg(F.array(*made).alias("x")).select(F.inline("x"))
    return out.select("col", "min", "max", ratio(F.col("sum"), F.col("n"), 4).alias("mean"), ratio(F.col("zero"), F.col("n"), 6).alias("zero_ratio"), ratio(F.col("negative"), F.col("n"), 6).alias("negative_ratio"))


#: Inverse of the rank error of the sketch that brackets a percentile.
ACCURACY = 10_000


def percentiles(df: DataFrame, columns: list[str], shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Exact percentiles by floor rank: the max(1, floor(n * p))-th smallest value.

    A mergeable sketch brackets each percentile between two values of about its rank. A second pass counts what lies
    below the bracket, and only the values inside it, some 4 in ACCURACY, are put in order. Where rounding puts the
    rank just below the bracket, it is that of the largest value below.
    """
    cells = df.select(*(F.col(f"`{c}`").cast("double").alias(c) for c in columns)).unpivot([], columns, "col", "value").where(F.col("value").isNotNull())
    edges = [min(1.0, max(0.0, p + d * 2 / ACCURACY)) for p in shares for d in (-1, 1)]
    sketch = cells.groupBy("col").agg(F.count("*").alias("n"), F.percentile_approx("value", edges, ACCURACY).alias("e"))
    brackets = F.array(*(F.struct(F.lit(int(100 * p)).alias("share"), F.get("e", F.lit(2 * i)).alias("low"), F.get("e", F.lit(2 * i + 1)).alias("high"), F.greatest(F.lit(1), F.floor(F.col("n") * p)).alias("rank")) for i, p in enumerate(shares)))
    # a row for each column and share
    asked = materialise(sketch.select("col", F.explode(brackets).alias("x")).select("col", "x.*"), "brackets")
    near = cells.join(F.broadcast(asked), "col")
    below = F.col("value") < F.col("low")
    under = near.groupBy("col", "share", "rank").agg(F.count_if(below).alias("under"), F.max(F.when(below, F.col("value"))).alias("last"))
    inside = near.where(F.col("value").between(F.col("low"), F.col("high"))).groupBy("col", "share", "value").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("col", "share").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    placed = inside.withColumn("upto", upto).join(F.broadcast(under), ["col", "share"])
    hit = F.when(F.col("upto") + F.col("under") >= F.col("rank"), F.col("value"))
    found = placed.groupBy("col", "share").agg(F.min(F.when(F.col("under") >= F.col("rank"), F.col("last")).otherwise(hit)).alias("value"))
    return found.groupBy("col").agg(*(F.max(F.when(F.col("share") == int(100 * p), F.col("value"))).alias(f"p{int(100 * p)}") for p in shares))


def iqr_outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Values beyond one and a half interquartile ranges, for columns whose range is positive."""
    p = F.broadcast(percentiles(df, columns).withColumn("iqr", F.col("p75") - F.col("p25")))
    cells = df.select(*(F.col(f"`{c}`").cast("double").alias(c) for c in columns)).unpivot([], columns, "col", "value").where(F.col("value").isNotNull())
    out = (F.col("value") < F.col("p25") - 1.5 * F.col("iqr")) | (F.col("value") > F.col("p75") + 1.5 * F.col("iqr"))
    return cells.join(p.where("iqr > 0"), "col").groupBy("col").agg(F.count_if(out).alias("outliers"), ratio(F.count_if(out), F.count("*"), 6).alias("outlier_ratio"))


def type_valid(counts: DataFrame, classes: DataFrame) -> DataFrame:
    """Share of the values that parse as their column's class; 1 for text and for columns without values.

    Texts that are checked for numbers or dates must be counted whole.
    """
    value = F.trim("value")
    good = F.when(F.col("class") == "numeric", value.try_cast("double").isNotNull()).when(F.col("class") == "datetime", value.try_cast("timestamp").isNotNull()).otherwise(F.lit(True))
    full = F.col("value").isNotNull()
    n = F.sum(F.when(full, F.col("n")))
    return counts.join(F.broadcast(classes), "col").groupBy("col", "class").agg(F.coalesce(ratio(F.sum(F.when(full & good, F.col("n")).otherwise(0)), n, 6), F.lit(1.0)).alias("valid_ratio"))


def future_time(df: DataFrame, columns: list[str], as_of: str) -> DataFrame:
    made = [F.struct(F.lit(c).alias("col"), F.count(f"`{c}`").alias("n"), F.count_if(F.col(f"`{c}`").cast("timestamp") > F.lit(as_of).cast("timestamp")).alias("later")) for c in columns]
    return df.agg(F.array(*made).alias("x")).select(F.inline("x")).select("col", ratio(F.col("later"), F.col("n"), 6).alias("future_ratio"))


def text(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share with outer white space, and shortest, longest and mean length."""
    made = []
    for c in columns:
        x = F.col(f"`{c}`")
        made.append(F.struct(F.lit(c).alias("col"), F.count(x).alias("n"), F.count_if(x != F.trim(x)).alias("odd"), F.min(F.length(x)).cast("long").alias("min_length"), F.max(F.length(x)).cast("long").alias("max_length"), F.sum(F.length(x)).alias("chars")))
    out = df.agg(F.array(*made).alias("x")).select(F.inline("x"))
    return out.select("col", ratio(F.col("odd"), F.col("n"), 6).alias("format_issue_ratio"), "min_length", "max_length", ratio(F.col("chars"), F.col("n"), 1).alias("avg_length"))


def risk(null_ratio: Column, duplicate_ratio: Column, top1_ratio: Column, valid_ratio: Column) -> tuple[Column, Column]:
    """(points, level)."""
    points = F.when(null_ratio > 0.2, 4).when(null_ratio > 0.05, 1).otherwise(0)
    for bad in (duplicate_ratio > 0.3, top1_ratio > 0.9, valid_ratio < 0.95):
        points = points + F.when(bad, 1).otherwise(0)
    return points.cast("long"), F.when(points >= 3, "high").when(points >= 1, "medium").otherwise("low")


def observed_enum(counts: DataFrame, columns: list[str], least: int = 2, most: int = 36) -> DataFrame:
    """Sorted values of text columns that have few and short ones; id columns only if very few."""
    kept = counts.where(F.col("col").isin(columns) & F.col("value").isNotNull() & (F.trim("value") != ""))
    # columns with too many values are dropped by their counts before any value is gathered
    facts = kept.groupBy("col").agg(F.count_distinct(F.trim("value")).alias("k"), F.max(F.length("value")).alias("longest"))
    fit = facts.where((F.col("k").between(least, most)) & (F.col("longest") <= 64) & ~(F.col("col").endswith("_id") & (F.col("k") > 12)) & ~F.col("col").rlike("(?i)(name|comment|remark|description|address|text|note)"))
    return kept.join(F.broadcast(fit.select("col")), "col").groupBy("col").agg(F.sort_array(F.collect_set(F.trim("value"))).alias("enum_values"))


def declared_enum(declared: Column) -> Column:
    """Values of an enum(...) or set(...) type text, empty for other types."""
    listed = F.regexp_extract(declared, r"(?is)^\s*(?:enum|set)\s*\((.*)\)", 1)
    return F.transform(F.regexp_extract_all(listed, F.lit(r"'((?:[^']|'')*)'"), F.lit(1)), lambda x: F.replace(x, F.lit("''"), F.lit("'")))


def merge_enums(columns: DataFrame, seen: DataFrame) -> DataFrame:
    """Add values seen in code to a column's enum: at least two, only new ones, never over a declared enum."""
    joined = columns.join(seen, "col", "left")
    old, new = F.coalesce("enum_values", F.array().cast("array<string>")), F.array_except("code_values", "enum_values")
    add = ~F.col("declared") & (F.size("code_values") >= 2)
    return joined.select("col", "declared", F.array_sort(F.when(add, F.array_union(old, F.coalesce(new, F.col("code_values")))).otherwise(old)).alias("enum_values"))


def column_role(class_: Column, name: Column, null_ratio: Column, distinct_count: Column) -> Column:
    """metric, time, id or dimension; null for columns that say nothing."""
    role = F.when(class_ == "datetime", "time").when(F.lower(name).rlike("(^|_)id$|key$"), "id").when(class_ == "numeric", "metric").otherwise("dimension")
    return F.when((null_ratio <= 0.95) & (distinct_count > 1), role)


def classes(df: DataFrame) -> DataFrame:
    """(col, class) from the schema."""
    spark = df.sparkSession
    rows = [(f.name, f.dataType.simpleString()) for f in df.schema]
    return spark.createDataFrame(rows, "col string, type string").select("col", type_class(F.col("type")).alias("class"))


def scalar_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]


#: Types whose values are valid as they are.
NATIVE = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType)


def report(df: DataFrame) -> DataFrame:
    """One row for each column: class, nulls, distinct values, top values, validity, risk and role."""
    df = df.select(*(F.col(f"`{c}`") for c in scalar_columns(df)))
    counts, kinds = value_counts(df), classes(df)
    tops = top_values(df, counts).groupBy("col").agg(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))).alias("top_values"))
    full, cells = F.col("full"), F.col("n") * F.col("kinds")
    told = spectrum(counts).groupBy("col").agg(F.sum(cells).alias("all"), F.sum(F.when(full, cells).otherwise(0)).alias("filled"), F.sum(F.when(full, F.col("kinds")).otherwise(0)).alias("different"), F.max(F.when(full, F.col("n"))).alias("top"))
    measures = told.select("col", *null_measures(F.col("all"), F.col("all") - F.col("filled")), *distinct_measures(F.col("different"), F.col("filled")), ratio(F.col("top"), F.col("filled"), 6).alias("top1_ratio"))
    odd = [c for kind, names in families(df, df.columns) if not isinstance(kind, NATIVE) for c in names]
    valid = type_valid(value_counts(df, odd), kinds).drop("class") if odd else kinds.select("col", F.lit(1.0).alias("valid_ratio")).where("false")
    out = measures.join(F.broadcast(kinds), "col").join(valid, "col", "left").join(tops, "col", "left").withColumn("valid_ratio", F.coalesce("valid_ratio", F.lit(1.0)))
    points, level = risk(F.col("null_ratio"), F.coalesce("duplicate_ratio", F.lit(0.0)), F.coalesce("top1_ratio", F.lit(0.0)), F.col("valid_ratio"))
    return out.withColumns({"risk_points": points, "risk": level, "role": column_role(F.col("class"), F.col("col"), F.col("null_ratio"), F.col("distinct_count"))})
