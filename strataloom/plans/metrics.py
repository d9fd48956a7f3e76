"""Metric queries and roll-ups over orders, line items and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataloom.functions.numbers import day, money, month, ratio, rounded, total
from strataloom.operators import metrics as M
from strataloom.registry import query

PAID = ("F", "P")
M2 = "CAST({} AS DECIMAL(18,2))"


def _m(x):
    return M2.format(x)


def _r(x, d):
    return f"floor(({x}) * {10.0**d} + 0.5) / {10.0**d}"


@query(f"""SELECT l_returnflag, l_linestatus, CAST(sum({_m('l_quantity')}) AS DOUBLE) AS sum_qty, {_r(f"CAST(sum({_m('l_extendedprice')}) AS DOUBLE)/count(*)", 2)} AS avg_price,
  count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price, {_r('stddev_pop(l_quantity)', 2)} AS sd_qty
  FROM lineitem GROUP BY 1, 2""")
def m_group_agg(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        total("l_quantity").alias("sum_qty"), rounded(total("l_extendedprice") / F.count("*"), 2).alias("avg_price"), F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("suppliers"),
        F.min("l_extendedprice").alias("min_price"), F.max("l_extendedprice").alias("max_price"), rounded(F.stddev_pop("l_quantity"), 2).alias("sd_qty"))


@query(f"""SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS large, CAST(sum(CASE WHEN value > 50 THEN {_m('value')} END) AS DOUBLE) AS large_value,
  {_r("100.0 * count(*) FILTER (value > 50) / nullif(count(*), 0)", 2)} AS large_pct FROM events GROUP BY 1""")
def m_filtered_agg(t):
    large = F.col("value") > 50
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(large).alias("large"), F.sum(F.when(large, money("value"))).cast("double").alias("large_value"), ratio(F.count_if(large), F.count("*"), 2, 100.0).alias("large_pct"))


@query("""SELECT grain, CAST(period AS VARCHAR) AS period, n, amount FROM (
  SELECT 'day' AS grain, CAST(date_trunc('day', o_orderdate) AS DATE) AS period, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM orders GROUP BY 2 UNION ALL
  SELECT 'week', CAST(date_trunc('week', o_orderdate) AS DATE), count(*), CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) FROM orders GROUP BY 2 UNION ALL
  SELECT 'month', CAST(date_trunc('month', o_orderdate) AS DATE), count(*), CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) FROM orders GROUP BY 2 UNION ALL
  SELECT 'quarter', CAST(date_trunc('quarter', o_orderdate) AS DATE), count(*), CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) FROM orders GROUP BY 2 UNION ALL
  SELECT 'year', CAST(date_trunc('year', o_orderdate) AS DATE), count(*), CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) FROM orders GROUP BY 2)""")
def m_time_series(t):
    # the finest grain is aggregated once; week and month roll up from days
    days = t.orders.groupBy(F.col("o_orderdate").cast("date").alias("d")).agg(F.count("*").alias("n"), F.sum(money("o_totalprice")).alias("amount"))
    grains = F.explode(F.array(*(F.struct(F.lit(g).alias("grain"), F.date_trunc(g, "d").cast("date").cast("string").alias("period")) for g in ("day", "week", "month", "quarter", "year"))))
    return days.select(grains.alias("g"), "n", "amount").groupBy("g.grain", "g.period").agg(F.sum("n").alias("n"), F.sum("amount").cast("double").alias("amount"))


_BY_YEAR = "WITH y AS (SELECT o_orderpriority, CAST(year(o_orderdate) AS VARCHAR) AS yr, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM orders GROUP BY 1, 2)"


def _by_year(t):
    return t.orders.groupBy("o_orderpriority", F.year("o_orderdate").cast("string").alias("yr")).agg(total("o_totalprice").alias("amount"))


@query(f"""{_BY_YEAR} SELECT a.o_orderpriority, a.amount AS base_value, b.amount AS compare_value, {_r('b.amount - a.amount', 2)} AS diff, {_r('100.0 * (b.amount - a.amount) / nullif(a.amount, 0)', 2)} AS pct
  FROM y a JOIN y b USING (o_orderpriority) WHERE a.yr = '1995' AND b.yr = '1996'""")
def m_period_compare_join(t):
    return M.change_between(_by_year(t), "o_orderpriority", "yr", "amount", "1995", "1996")


@query("""SELECT o_orderpriority, """ + ", ".join(f"CAST(sum(CASE WHEN year(o_orderdate) = {y} THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE) AS p_{y}" for y in (1994, 1995, 1996)) + """
  FROM orders WHERE year(o_orderdate) IN (1994, 1995, 1996) GROUP BY 1""")
def m_period_compare_pivot(t):
    return M.periods_as_columns(t.orders.withColumn("yr", F.year("o_orderdate").cast("string")), "o_orderpriority", "yr", money("o_totalprice"), ["1994", "1995", "1996"])


@query(f"""WITH s AS (SELECT substr(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), 1, 7) AS month, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM orders GROUP BY 1),
  l AS (SELECT *, lag(amount) OVER (ORDER BY month) AS before, lag(amount, 12) OVER (ORDER BY month) AS year_before FROM s)
  SELECT month, amount, before, {_r('amount - before', 2)} AS diff, {_r('100.0 * (amount - before) / nullif(before, 0)', 2)} AS pct, {_r('100.0 * (amount - year_before) / nullif(year_before, 0)', 2)} AS yoy_pct FROM l""")
def m_mom_yoy(t):
    s = t.orders.groupBy(month("o_orderdate").alias("month")).agg(total("o_totalprice").alias("amount"))
    yoy = M.change_over_time(s, "month", "amount", 12).select("month", F.col("pct").alias("yoy_pct"))
    return M.change_over_time(s, "month", "amount").join(yoy, "month")


@query("""SELECT r_name, n_name, count(o_orderkey) AS orders, count(DISTINCT c_custkey) AS customers, coalesce(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE), 0.0) AS amount
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1, 2""")
def m_star_join(t):
    # orders shrink to one row for each customer before they meet the dimensions
    done = t.orders.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum(money("o_totalprice")).alias("amount"))
    dims = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    facts = t.customer.join(done, F.col("o_custkey") == F.col("c_custkey"), "left")
    return facts.join(dims, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name", "n_name").agg(F.coalesce(F.sum("orders"), F.lit(0)).alias("orders"), F.count("c_custkey").alias("customers"), F.coalesce(F.sum("amount").cast("double"), F.lit(0.0)).alias("amount"))


@query("""WITH s AS (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount, count(*) AS n FROM orders GROUP BY 1)
  SELECT o_custkey, amount, n, rank() OVER (ORDER BY n DESC) AS by_count, dense_rank() OVER (ORDER BY n DESC) AS dense FROM s QUALIFY row_number() OVER (ORDER BY amount DESC, o_custkey) <= 10""")
def m_top_n(t):
    s = t.orders.groupBy("o_custkey").agg(total("o_totalprice").alias("amount"), F.count("*").alias("n"))
    # ranks come from the few distinct counts, not from a window over all rows
    sizes = s.groupBy("n").agg(F.count("*").alias("rows"))
    w = Window.orderBy(F.desc("n"))
    ranks = sizes.select("n", (F.coalesce(F.sum("rows").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1).alias("by_count"), F.dense_rank().over(w).cast("long").alias("dense"))
    return s.orderBy(F.desc("amount"), "o_custkey").limit(10).join(ranks, "n").select("o_custkey", "amount", "n", "by_count", "dense")


@query(f"""WITH s AS (SELECT n_name, r_name, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)
  SELECT n_name, r_name, amount, {_r('100.0 * amount / sum(amount) OVER (PARTITION BY r_name)', 1)} AS region_pct FROM s""")
def m_share(t):
    s = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return M.with_share(s.groupBy("n_name", "r_name").agg(total("o_totalprice").alias("amount")), "amount", ["r_name"], 1, "region_pct")


@query(f"""WITH c AS (SELECT event_type, count(*) AS cnt FROM events GROUP BY 1)
  SELECT event_type, cnt, {_r('100.0 * cnt / sum(cnt) OVER ()', 1)} AS pct, {_r('100.0 * sum(cnt) OVER (ORDER BY cnt DESC, event_type ROWS UNBOUNDED PRECEDING) / sum(cnt) OVER ()', 1)} AS cum_pct FROM c""")
def m_pareto(t):
    return M.pareto(t.events, "event_type")


@query("""SELECT l_suppkey, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM lineitem GROUP BY 1
  HAVING count(*) > 20 AND sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) * 4 > count(*)""")
def m_having(t):
    back = F.count_if(F.col("l_returnflag") == "R")
    return t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"), total("l_extendedprice").alias("amount"), back.alias("back")).where("n > 20 AND back * 4 > n").drop("back")


@query(f"""WITH s AS (SELECT l_returnflag, substr(CAST(CAST(l_shipdate AS DATE) AS VARCHAR), 1, 7) AS month, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2),
  a AS (SELECT l_returnflag, count(*) AS periods, avg(v) AS m, stddev_pop(v) AS s, max(v) AS peak, min(v) AS trough FROM s GROUP BY 1)
  SELECT l_returnflag, periods, {_r('m', 1)} AS mean, {_r('s', 1)} AS deviation, peak, trough, {_r('100 * s / nullif(m, 0)', 1)} AS cv_pct,
  CASE WHEN 100 * s / nullif(m, 0) < 10 THEN 'stable' WHEN 100 * s / nullif(m, 0) < 30 THEN 'moderate' ELSE 'volatile' END AS label FROM a""")
def m_volatility(t):
    return M.volatility(t.lineitem.withColumn("month", month("l_shipdate")), "l_returnflag", "month", money("l_quantity"))


@query(f"""SELECT l_linestatus, substr(CAST(CAST(l_shipdate AS DATE) AS VARCHAR), 1, 7) AS month, count(*) FILTER (l_returnflag = 'R') AS defects, count(*) AS n,
  {_r("1000000.0 * count(*) FILTER (l_returnflag = 'R') / count(*)", 0)} AS dppm FROM lineitem GROUP BY 1, 2""")
def m_dppm(t):
    bad = F.count_if(F.col("l_returnflag") == "R")
    return t.lineitem.groupBy("l_linestatus", month("l_shipdate").alias("month")).agg(bad.alias("defects"), F.count("*").alias("n"), ratio(bad, F.count("*"), 0, 1e6).alias("dppm"))


@query(f"""SELECT o_orderpriority, count(*) AS n, {_r('CAST(sum(d) AS DOUBLE) / count(d)', 1)} AS avg_days, min(d) AS min_days, max(d) AS max_days FROM (
  SELECT o_orderpriority, date_diff('day', CAST(o_orderdate AS DATE), coalesce(CAST(shipped AS DATE), DATE '1998-12-31')) AS d FROM orders LEFT JOIN (
    SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) ON l_orderkey = o_orderkey) GROUP BY 1""")
def m_duration(t):
    shipped = t.lineitem.where("l_linestatus = 'F'").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"))
    return M.durations(t.orders.join(shipped, F.col("l_orderkey") == F.col("o_orderkey"), "left"), ["o_orderpriority"], "o_orderdate", "shipped", "1998-12-31")


@query(f"""SELECT substr(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), 1, 7) AS month, o_orderpriority, count(*) AS n,
  {_r("100.0 * sum(CASE WHEN date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) <= 60 THEN 1 ELSE 0 END) / count(*)", 1)} AS on_time_pct FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def m_on_time_rate(t):
    on_time = F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date")) <= 60
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(month("o_orderdate").alias("month"), "o_orderpriority").agg(F.count("*").alias("n"), ratio(F.count_if(on_time), F.count("*"), 1, 100.0).alias("on_time_pct"))


@query(f"""WITH a AS (SELECT substr(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), 1, 7) AS month, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS numerator FROM orders GROUP BY 1),
  b AS (SELECT substr(CAST(CAST(l_shipdate AS DATE) AS VARCHAR), 1, 7) AS month, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS denominator FROM lineitem GROUP BY 1)
  SELECT month, numerator, denominator, {_r('numerator / nullif(denominator, 0)', 2)} AS value FROM a LEFT JOIN b USING (month)""")
def m_correlated_ratio(t):
    a = t.orders.select(month("o_orderdate").alias("month"), money("o_totalprice").alias("amount"))
    return M.ratio_at_grain(a, t.lineitem.select(month("l_shipdate").alias("month"), money("l_quantity").alias("units")), ["month"], "amount", "units")


@query(f"""SELECT event_type, count(*) AS readings, {_r('100.0 * sum(CASE WHEN value > 10 THEN 1 ELSE 0 END) / count(*)', 1)} AS available_pct, {_r('100.0 * sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN value > 10 THEN 1 ELSE 0 END), 0)', 1)} AS performance_pct,
  sum(CASE WHEN value <= 10 THEN 1 ELSE 0 END) AS stops, {_r('CAST(sum(CASE WHEN value <= 10 THEN CAST(value AS DECIMAL(18,2)) END) AS DOUBLE) / nullif(sum(CASE WHEN value <= 10 THEN 1 ELSE 0 END), 0)', 1)} AS mean_repair FROM events GROUP BY 1""")
def m_availability(t):
    up, full, down = F.count_if(F.col("value") > 10), F.count_if(F.col("value") > 50), F.count_if(F.col("value") <= 10)
    return t.events.groupBy("event_type").agg(F.count("*").alias("readings"), ratio(up, F.count("*"), 1, 100.0).alias("available_pct"), ratio(full, up, 1, 100.0).alias("performance_pct"), down.alias("stops"), ratio(F.sum(F.when(F.col("value") <= 10, money("value"))), down, 1).alias("mean_repair"))


_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("""SELECT month, whole, """ + ", ".join(_r(f"100.0 * CAST(x{i} AS DOUBLE) / nullif(whole, 0)", 2) + f" AS \"{c.lower().replace('-', '_').replace(' ', '_')}_pct\"" for i, c in enumerate(_PRIORITIES)) + """ FROM (
  SELECT substr(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), 1, 7) AS month, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS whole, """ + ", ".join(f"sum(CASE WHEN o_orderpriority = '{c}' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS x{i}" for i, c in enumerate(_PRIORITIES)) + """ FROM orders GROUP BY 1)""")
def m_structure(t):
    return M.composition(t.orders.withColumn("month", month("o_orderdate")), "month", "o_orderpriority", money("o_totalprice"), list(_PRIORITIES))


@query(f"""SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS open_orders, (SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) FROM orders WHERE o_orderstatus = 'F') AS revenue,
  (SELECT count(DISTINCT user_id) FROM events) AS visitors, (SELECT {_r("100.0 * sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) / count(*)", 2)} FROM lineitem) AS return_pct, (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS overdrawn""")
def m_scorecard(t):
    orders = t.orders.agg(F.count_if(F.col("o_orderstatus") == "O").alias("open_orders"), F.sum(F.when(F.col("o_orderstatus") == "F", money("o_totalprice"))).cast("double").alias("revenue"))
    rest = [t.events.agg(F.count_distinct("user_id").alias("visitors")), t.lineitem.agg(ratio(F.count_if(F.col("l_returnflag") == "R"), F.count("*"), 2, 100.0).alias("return_pct")), t.customer.agg(F.count_if(F.col("c_acctbal") < 0).alias("overdrawn"))]
    for one in rest:  # each side is one row
        orders = orders.crossJoin(F.broadcast(one))
    return orders


@query("""SELECT o_orderpriority, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount, max(date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-12-31')) AS oldest_days FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1""")
def m_backlog(t):
    age = F.datediff(F.lit("1998-12-31").cast("date"), F.col("o_orderdate").cast("date"))
    return t.orders.where("o_orderstatus <> 'F'").groupBy("o_orderpriority").agg(F.count("*").alias("n"), total("o_totalprice").alias("amount"), F.max(age).cast("long").alias("oldest_days"))


@query(f"""SELECT l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS units, coalesce(CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS DECIMAL(18,2)) END) AS DOUBLE), 0.0) AS scrap,
  {_r("100.0 * CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS DECIMAL(18,2)) END) AS DOUBLE) / nullif(CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE), 0)", 2)} AS scrap_pct FROM lineitem GROUP BY 1""")
def m_scrap(t):
    bad = F.sum(F.when(F.col("l_returnflag") == "R", money("l_quantity"))).cast("double")
    return t.lineitem.groupBy("l_linestatus").agg(total("l_quantity").alias("units"), F.coalesce(bad, F.lit(0.0)).alias("scrap"), ratio(bad, total("l_quantity"), 2, 100.0).alias("scrap_pct"))


@query(f"""SELECT p_brand, count(*) AS lines, {_r("1000.0 * sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) / nullif(CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE), 0)", 3)} AS defects_per_1000 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def m_density(t):
    joined = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy("p_brand").agg(F.count("*").alias("lines"), ratio(F.count_if(F.col("l_returnflag") == "R"), total("l_quantity"), 3, 1000.0).alias("defects_per_1000"))


@query("""WITH o AS (SELECT l_partkey AS product, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS dt, count(*) AS orders, sum(CASE WHEN o_orderstatus IN ('F', 'P') THEN 1 ELSE 0 END) AS paid_orders, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
  r AS (SELECT l_partkey AS product, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS dt, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS refunds FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1, 2)
  SELECT dt, product, orders, paid_orders, amount, coalesce(refunds, 0.0) AS refunds FROM o LEFT JOIN r USING (product, dt)""")
def r_product_1d(t):
    # orders and refunds are conditional sums of one pass, so no second join is needed
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    back = F.sum(F.when(F.col("l_returnflag") == "R", money("l_extendedprice"))).cast("double")
    return joined.groupBy(day("o_orderdate").alias("dt"), F.col("l_partkey").alias("product")).agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus").isin(*PAID)).alias("paid_orders"), total("l_extendedprice").alias("amount"), F.coalesce(back, F.lit(0.0)).alias("refunds"))


@query("""SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS dt, n_regionkey AS region, count(*) AS orders, count(DISTINCT o_custkey) AS buyers, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def r_region_1d(t):
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy(day("o_orderdate").alias("dt"), F.col("n_regionkey").alias("region")).agg(F.count("*").alias("orders"), F.count_distinct("o_custkey").alias("buyers"), total("o_totalprice").alias("amount"))


@query(f"""WITH e AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS dt, count(DISTINCT user_id) AS visitors, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS carts FROM events GROUP BY 1),
  o AS (SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS dt, sum(CASE WHEN o_orderstatus IN ('F', 'P') THEN 1 ELSE 0 END) AS paid FROM orders GROUP BY 1)
  SELECT dt, coalesce(visitors, 0) AS visitors, CAST(coalesce(carts, 0) AS BIGINT) AS carts, CAST(coalesce(paid, 0) AS BIGINT) AS paid, CASE WHEN coalesce(visitors, 0) > 0 THEN {_r('CAST(coalesce(paid, 0) AS DOUBLE) / visitors', 4)} ELSE 0.0 END AS rate FROM e FULL JOIN o USING (dt)""")
def r_channel_conversion_1d(t):
    e = t.events.groupBy(day("ts").alias("dt")).agg(F.count_distinct("user_id").alias("visitors"), F.count_if(F.col("event_type") == "click").alias("carts"))
    o = t.orders.groupBy(day("o_orderdate").alias("dt")).agg(F.count_if(F.col("o_orderstatus").isin(*PAID)).alias("paid"))
    both = M.outer_union_of_keys(e, o, ["dt"], ["visitors", "carts", "paid"])
    return both.withColumn("rate", F.coalesce(ratio(F.col("paid"), F.col("visitors"), 4), F.lit(0.0)))


@query("""WITH o AS (SELECT o_custkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') AS age, CAST(o_totalprice AS DECIMAL(18,2)) AS p, o_orderstatus FROM orders),
  a AS (SELECT o_custkey, min(age) AS recency_days, count(*) FILTER (age <= 90) AS frequency, coalesce(CAST(sum(CASE WHEN age <= 90 AND o_orderstatus IN ('F', 'P') THEN p END) AS DOUBLE), 0.0) AS monetary FROM o GROUP BY 1)
  SELECT *, CASE WHEN recency_days <= 14 AND frequency >= 8 AND monetary >= 3000 THEN 'high_value' WHEN recency_days <= 30 AND frequency >= 4 THEN 'steady' WHEN recency_days > 60 AND frequency <= 1 THEN 'dormant' ELSE 'ordinary' END AS segment FROM a""")
def r_user_rfm(t):
    return M.rfm(t.orders, "o_custkey", "o_orderdate", money("o_totalprice"), F.col("o_orderstatus").isin(*PAID), "1998-08-02")


@query(f"""WITH d AS (SELECT CAST(CAST(x AS DATE) AS VARCHAR) AS dt FROM generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '1996-12-31', INTERVAL 1 DAY) g(x)),
  o AS (SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS dt, count(*) AS orders, sum(CASE WHEN o_orderstatus IN ('F', 'P') THEN 1 ELSE 0 END) AS paid, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount, count(DISTINCT o_custkey) AS visitors FROM orders GROUP BY 1),
  r AS (SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS dt, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS refunds FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
  SELECT dt, coalesce(orders, 0) AS orders, CAST(coalesce(paid, 0) AS BIGINT) AS paid, coalesce(amount, 0.0) AS amount, coalesce(refunds, 0.0) AS refunds, coalesce(visitors, 0) AS visitors, coalesce({_r('CAST(paid AS DOUBLE) / nullif(visitors, 0)', 4)}, 0.0) AS rate FROM d LEFT JOIN o USING (dt) LEFT JOIN r USING (dt)""")
def r_kpi_1d(t):
    o = t.orders.groupBy(day("o_orderdate").alias("dt")).agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus").isin(*PAID)).alias("paid"), total("o_totalprice").alias("amount"), F.count_distinct("o_custkey").alias("visitors"))
    r = t.lineitem.where("l_returnflag = 'R'").groupBy(day("l_shipdate").alias("dt")).agg(total("l_extendedprice").alias("refunds"))
    out = M.calendar(t.spark, "1995-01-01", "1996-12-31").join(o, "dt", "left").join(r, "dt", "left").fillna(0, ["orders", "paid", "visitors", "amount", "refunds"])
    return out.withColumn("rate", F.coalesce(ratio(F.col("paid"), F.col("visitors"), 4), F.lit(0.0)))
