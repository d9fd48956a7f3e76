"""Profiles of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.operators import profile as P
from strataloom.plans.metrics import _r
from strataloom.registry import query

ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _cells(table, columns):
    return "(" + " UNION ALL ".join(f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS value FROM {table}" for c in columns) + ")"


def _numbers(table, columns):
    return "(" + " UNION ALL ".join(f"SELECT '{c}' AS col, CAST({c} AS DOUBLE) AS value FROM {table}" for c in columns) + ")"


LABELLED = "(SELECT doc_id, lang, source, quality FROM documents LEFT JOIN labels USING (doc_id))"


def _labelled(t):
    return t.documents.select("doc_id", "lang", "source").join(t.labels.select("doc_id", "quality"), "doc_id", "left")


LABELLED_COLUMNS = ["doc_id", "lang", "source", "quality"]


@query("""SELECT col, CASE WHEN regexp_matches(lower(type), 'date|time') AND NOT regexp_matches(lower(type), 'enum|set') THEN 'datetime' WHEN regexp_matches(lower(type), 'int|numeric|decimal|float|double|real') AND NOT regexp_matches(lower(type), 'enum|set') THEN 'numeric'
  WHEN regexp_matches(lower(type), 'char|text|string|enum|set') THEN 'text' ELSE 'other' END AS class FROM (SELECT column_name AS col, data_type AS type FROM duckdb_columns() WHERE table_name = 'lineitem')""")
def prof_type_class(t):
    return P.classes(t.lineitem)


@query(f"""SELECT col, count(*) AS rows, count(*) - count(value) AS null_count, count(value) AS non_null_count, {_r('CAST(count(*) - count(value) AS DOUBLE) / count(*)', 6)} AS null_ratio, {_r('1 - CAST(count(*) - count(value) AS DOUBLE) / count(*)', 6)} AS completeness FROM {_cells(LABELLED, LABELLED_COLUMNS)} GROUP BY 1""")
def prof_nulls(t):
    return P.nulls(_labelled(t))


@query(f"""SELECT col, count(DISTINCT value) AS distinct_count, {_r('CAST(count(DISTINCT value) AS DOUBLE) / count(value)', 6)} AS distinct_ratio, {_r('1 - CAST(count(DISTINCT value) AS DOUBLE) / count(value)', 6)} AS duplicate_ratio FROM {_cells('orders', ORDER_COLUMNS)} GROUP BY 1""")
def prof_distinct(t):
    return P.distinct(P.value_counts(t.orders, ORDER_COLUMNS))


@query(f"""SELECT col, CAST(rank AS INTEGER) AS rank, value, n, {_r('CAST(n AS DOUBLE) / full_n', 6)} AS share FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, value) AS rank, sum(n) OVER (PARTITION BY col) AS full_n FROM (SELECT col, value, count(*) AS n FROM {_cells('orders', ORDER_COLUMNS)} WHERE value IS NOT NULL GROUP BY 1, 2)) WHERE rank <= 10""")
def prof_top_values(t):
    return P.top_values(t.orders.select(*ORDER_COLUMNS), P.value_counts(t.orders, ORDER_COLUMNS))


@query("SELECT list(x ORDER BY k) AS samples FROM (SELECT o_orderkey AS k, o_orderpriority AS x FROM orders WHERE o_orderpriority IS NOT NULL ORDER BY 1 LIMIT 5)")
def prof_samples(t):
    first = t.orders.where("o_orderpriority IS NOT NULL").select("o_orderkey", "o_orderpriority").orderBy("o_orderkey").limit(5)
    return first.agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("x")).select(F.col("x.o_orderpriority").alias("samples"))


@query(f"""SELECT col, min(value) AS min, max(value) AS max, {_r('CAST(sum(CAST(value AS DECIMAL(28,4))) AS DOUBLE) / count(value)', 4)} AS mean FROM {_numbers('lineitem', NUMBERS)} GROUP BY 1""")
def prof_numeric(t):
    return P.numeric(t.lineitem, NUMBERS).select("col", "min", "max", "mean")


_RANKED = f"""(SELECT *, row_number() OVER (PARTITION BY col ORDER BY value) AS i, count(*) OVER (PARTITION BY col) AS n FROM {_numbers('lineitem', NUMBERS)} WHERE value IS NOT NULL)"""
_PERCENTILES = "SELECT col, " + ", ".join(f"max(CASE WHEN i = greatest(1, CAST(floor(n * {p}) AS BIGINT)) THEN value END) AS p{int(100 * p)}" for p in (0.25, 0.5, 0.75)) + f" FROM {_RANKED} GROUP BY 1"


@query(_PERCENTILES)
def prof_percentiles(t):
    return P.percentiles(t.lineitem, NUMBERS)


@query(f"""SELECT col, {_r('CAST(count(*) FILTER (value = 0) AS DOUBLE) / count(value)', 6)} AS zero_ratio, {_r('CAST(count(*) FILTER (value < 0) AS DOUBLE) / count(value)', 6)} AS negative_ratio FROM {_numbers('lineitem', NUMBERS)} GROUP BY 1
  UNION ALL SELECT 'c_acctbal', {_r('CAST(count(*) FILTER (c_acctbal = 0) AS DOUBLE) / count(*)', 6)}, {_r('CAST(count(*) FILTER (c_acctbal < 0) AS DOUBLE) / count(*)', 6)} FROM customer""")
def prof_zero_neg(t):
    return P.numeric(t.lineitem, NUMBERS).unionByName(P.numeric(t.customer, ["c_acctbal"])).select("col", "zero_ratio", "negative_ratio")


_OUT = "value < p25 - 1.5 * (p75 - p25) OR value > p75 + 1.5 * (p75 - p25)"


@query(f"""WITH p AS ({_PERCENTILES}) SELECT col, count(*) FILTER ({_OUT}) AS outliers, {_r(f'CAST(count(*) FILTER ({_OUT}) AS DOUBLE) / count(*)', 6)} AS outlier_ratio FROM {_numbers('lineitem', NUMBERS)} JOIN p USING (col) WHERE p75 > p25 GROUP BY 1""")
def prof_iqr_outliers(t):
    return P.iqr_outliers(t.lineitem, NUMBERS)


@query(f"""SELECT 'key_text' AS col, 'numeric' AS class, {_r("CAST(count(TRY_CAST(x AS DOUBLE)) AS DOUBLE) / count(x)", 6)} AS valid_ratio FROM (SELECT CASE WHEN o_orderkey % 10 = 3 THEN 'n/a' ELSE CAST(o_orderkey AS VARCHAR) END AS x FROM orders)
  UNION ALL SELECT 'day_text', 'datetime', {_r("CAST(count(*) FILTER (x <> 'soon') AS DOUBLE) / count(x)", 6)} FROM (SELECT CASE WHEN o_orderkey % 7 = 3 THEN 'soon' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS x FROM orders)""")
def prof_type_valid(t):
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date").cast("string")
    made = t.orders.select(F.when(key % 10 == 3, "n/a").otherwise(key.cast("string")).alias("key_text"), F.when(key % 7 == 3, "soon").otherwise(day).alias("day_text"))
    kinds = t.spark.createDataFrame([("key_text", "numeric"), ("day_text", "datetime")], "col string, class string")
    return P.type_valid(P.value_counts(made, head=None), kinds)


@query(f"SELECT 'o_orderdate' AS col, {_r('''CAST(count(*) FILTER (o_orderdate > TIMESTAMP '1997-06-30 00:00:00') AS DOUBLE) / count(o_orderdate)''', 6)} AS future_ratio FROM orders")
def prof_future_time(t):
    return P.future_time(t.orders, ["o_orderdate"], "1997-06-30 00:00:00")


@query("SELECT col, " + _r("CAST(count(*) FILTER (value <> trim(value, ' ')) AS DOUBLE) / count(value)", 6) + " AS format_issue_ratio, min(length(value)) AS min_length, max(length(value)) AS max_length, " + _r("CAST(sum(length(value)) AS DOUBLE) / count(value)", 1) + f" AS avg_length FROM {_cells('(SELECT text, lang FROM documents)', ['text', 'lang'])} GROUP BY 1")
def prof_text(t):
    return P.text(t.documents, ["text", "lang"])


_RISK = f"""WITH c AS (SELECT col, value, count(*) AS n FROM {_cells(LABELLED, LABELLED_COLUMNS)} GROUP BY 1, 2),
  a AS (SELECT col, CAST(sum(n) FILTER (value IS NULL) AS DOUBLE) / sum(n) AS null_ratio, 1 - CAST(count(value) AS DOUBLE) / sum(n) FILTER (value IS NOT NULL) AS dup, CAST(max(n) FILTER (value IS NOT NULL) AS DOUBLE) / sum(n) FILTER (value IS NOT NULL) AS top1 FROM c GROUP BY 1),
  b AS (SELECT col, CASE WHEN coalesce(null_ratio, 0) > 0.2 THEN 4 WHEN coalesce(null_ratio, 0) > 0.05 THEN 1 ELSE 0 END + CASE WHEN dup > 0.3 THEN 1 ELSE 0 END + CASE WHEN top1 > 0.9 THEN 1 ELSE 0 END AS risk_points FROM a)
  SELECT col, CAST(risk_points AS BIGINT) AS risk_points, CASE WHEN risk_points >= 3 THEN 'high' WHEN risk_points >= 1 THEN 'medium' ELSE 'low' END AS risk FROM b"""


@query(_RISK)
def prof_risk(t):
    return P.report(_labelled(t)).select("col", "risk_points", "risk")


@query(f"""SELECT col, list_sort(list(DISTINCT trim(value))) AS enum_values FROM {_cells('(SELECT o_orderstatus, o_orderpriority, CAST(o_custkey AS VARCHAR) AS cust_id FROM orders)', ['o_orderstatus', 'o_orderpriority', 'cust_id'])} WHERE value IS NOT NULL GROUP BY 1 HAVING count(DISTINCT trim(value)) BETWEEN 2 AND 36 AND col <> 'cust_id'""")
def prof_enum_observed(t):
    made = t.orders.select("o_orderstatus", "o_orderpriority", F.col("o_custkey").cast("string").alias("cust_id"))
    return P.observed_enum(P.value_counts(made), made.columns)


@query("""SELECT p_partkey, [p_brand, split_part(p_type, ' ', 1)] AS enum_values FROM part""")
def prof_enum_declared(t):
    declared = F.concat(F.lit("ENUM('"), "p_brand", F.lit("', '"), F.split("p_type", " ")[0], F.lit("')"))
    return t.part.select("p_partkey", P.declared_enum(declared).alias("enum_values"))


@query("""WITH o AS (SELECT CAST(n_regionkey AS VARCHAR) AS col, list_sort(list(DISTINCT n_name)) AS e FROM nation WHERE n_nationkey % 2 = 0 GROUP BY 1), s AS (SELECT CAST(n_regionkey AS VARCHAR) AS col, list(DISTINCT n_name) AS c FROM nation WHERE n_nationkey % 3 = 0 GROUP BY 1)
  SELECT o.col, o.col = '0' AS declared, CASE WHEN o.col <> '0' AND len(c) >= 2 THEN list_sort(list_distinct(list_concat(e, c))) ELSE e END AS enum_values FROM o LEFT JOIN s ON o.col = s.col""")
def prof_enum_merge(t):
    key = F.col("n_regionkey").cast("string").alias("col")
    known = t.nation.where("n_nationkey % 2 = 0").groupBy(key).agg(F.collect_set("n_name").alias("enum_values")).withColumn("declared", F.col("col") == "0")
    return P.merge_enums(known, t.nation.where("n_nationkey % 3 = 0").groupBy(key).agg(F.collect_set("n_name").alias("code_values")))


@query("""SELECT col, CASE WHEN k <= 1 THEN NULL WHEN col = 'o_orderdate' THEN 'time' WHEN col LIKE '%key' THEN 'id' WHEN col = 'o_totalprice' THEN 'metric' ELSE 'dimension' END AS role FROM (""" + " UNION ALL ".join(f"SELECT '{c}' AS col, count(DISTINCT {c}) AS k FROM orders" for c in ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]) + ")")
def prof_column_role(t):
    return P.report(t.orders).select("col", "role")


_LINES = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query(f"""WITH c AS (SELECT col, value, count(*) AS n FROM {_cells('lineitem', _LINES)} GROUP BY 1, 2), a AS (SELECT col, sum(n) AS rows, sum(n) FILTER (value IS NULL) AS nulls, count(value) AS kinds FROM c GROUP BY 1),
  p AS (SELECT col, value, n, row_number() OVER (PARTITION BY col ORDER BY n DESC, value) AS rank FROM c WHERE value IS NOT NULL), b AS (SELECT col, string_agg(value || '=' || n, ' ' ORDER BY rank) AS top_values, max(n) AS top FROM p WHERE rank <= 10 GROUP BY 1),
  r AS (SELECT col, CASE WHEN col IN ('l_returnflag', 'l_linestatus') THEN 'text' WHEN col = 'l_shipdate' THEN 'datetime' ELSE 'numeric' END AS class, rows, coalesce(nulls, 0) AS null_count, kinds, top, top_values, CAST(rows - coalesce(nulls, 0) AS DOUBLE) AS filled FROM a JOIN b USING (col)),
  d AS (SELECT *, {_r('1 - kinds / filled', 6)} AS duplicate_ratio, {_r('top / filled', 6)} AS top1_ratio FROM r), z AS (SELECT *, CASE WHEN duplicate_ratio > 0.3 THEN 1 ELSE 0 END + CASE WHEN top1_ratio > 0.9 THEN 1 ELSE 0 END AS risk_points FROM d)
  SELECT col, class, CAST(rows AS BIGINT) AS rows, CAST(null_count AS BIGINT) AS null_count, CAST(kinds AS BIGINT) AS distinct_count, {_r('kinds / filled', 6)} AS distinct_ratio, duplicate_ratio, top1_ratio, top_values, 1.0::DOUBLE AS valid_ratio, CAST(risk_points AS BIGINT) AS risk_points, CASE WHEN risk_points >= 3 THEN 'high' WHEN risk_points >= 1 THEN 'medium' ELSE 'low' END AS risk,
    CASE WHEN kinds <= 1 THEN NULL WHEN class = 'datetime' THEN 'time' WHEN col LIKE '%key' THEN 'id' WHEN class = 'numeric' THEN 'metric' ELSE 'dimension' END AS role FROM z""")
def prof_table(t):
    told = P.report(t.lineitem.select(*_LINES))
    top = F.array_join(F.transform("top_values", lambda x: F.concat_ws("=", x["value"], x["n"])), " ")
    return told.select("col", "class", "rows", "null_count", "distinct_count", "distinct_ratio", "duplicate_ratio", "top1_ratio", top.alias("top_values"), "valid_ratio", "risk_points", "risk", "role")
