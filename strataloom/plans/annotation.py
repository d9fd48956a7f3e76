"""Annotation of logged questions and audit of logged statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.operators import code as L
from strataloom.registry import query

_Q = """CASE o_orderkey % 7 WHEN 0 THEN 'compare sales of last 7 days with "' || o_orderpriority || '"' WHEN 1 THEN 'top 5 customers this month for AB-' || (o_custkey + 10) WHEN 2 THEN 'sales trend in 1996-' || (o_custkey % 12 + 1) WHEN 3 THEN 'share of each region last month' WHEN 4 THEN 'total for the last 3 months' WHEN 5 THEN 'drop all of it' ELSE 'hello' END"""


def _asked(t):
    return t.orders.select("o_orderkey", F.expr(_Q).alias("q"))


@query("""SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'comparison' WHEN 1 THEN 'ranking' WHEN 2 THEN 'trend' WHEN 3 THEN 'proportion' WHEN 4 THEN 'aggregation' END AS pattern FROM orders""")
def question_pattern(t):
    return _asked(t).select("o_orderkey", L.question_pattern(F.col("q")).alias("pattern"))


@query("SELECT o_orderkey, CASE o_orderkey % 7 WHEN 5 THEN 'guarded' WHEN 1 THEN 'sql_query' ELSE 'general_qa' END AS intent FROM orders")
def question_intent(t):
    return _asked(t).select("o_orderkey", L.question_intent(F.col("q")).alias("intent"))


@query("SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN [o_orderpriority] WHEN 1 THEN CASE WHEN o_custkey >= 90 THEN ['AB-' || (o_custkey + 10)] ELSE []::VARCHAR[] END ELSE []::VARCHAR[] END AS found FROM orders")
def question_values(t):
    return _asked(t).select("o_orderkey", L.question_values(F.col("q")).alias("found"))


@query("""SELECT o_orderkey, CAST(CASE o_orderkey % 7 WHEN 0 THEN DATE '1998-08-08' WHEN 1 THEN DATE '1998-08-01' WHEN 2 THEN make_date(1996, CAST(o_custkey % 12 + 1 AS INTEGER), 1) WHEN 3 THEN DATE '1998-07-01' WHEN 4 THEN DATE '1998-05-01' END AS VARCHAR) AS first,
  CAST(CASE o_orderkey % 7 WHEN 0 THEN DATE '1998-08-15' WHEN 1 THEN DATE '1998-08-31' WHEN 2 THEN last_day(make_date(1996, CAST(o_custkey % 12 + 1 AS INTEGER), 1)) WHEN 3 THEN DATE '1998-07-31' WHEN 4 THEN DATE '1998-08-31' END AS VARCHAR) AS last, o_orderkey % 7 = 0 AS compare FROM orders""")
def question_time_range(t):
    return _asked(t).select("o_orderkey", L.question_range(F.col("q"), "1998-08-15").alias("r")).select("o_orderkey", "r.*")


_SQL = """CASE o_orderkey % 6 WHEN 0 THEN 'SELECT * FROM t' || (o_custkey % 9) || ' JOIN dim_d ON x = y;' WHEN 1 THEN 'with c as (select 1 from base_' || (o_custkey % 9) || ') select * from c' WHEN 2 THEN 'DELETE FROM t1' WHEN 3 THEN 'select 1; select 2' WHEN 4 THEN ' -- nothing' ELSE 'call p(''drop table x'')' END"""


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'ok' WHEN 2 THEN 'write' WHEN 3 THEN 'multiple' WHEN 4 THEN 'empty' ELSE 'not_allowed' END AS verdict, CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END AS joins,
  CASE o_orderkey % 6 WHEN 0 THEN ['dim_d', 't' || (o_custkey % 9)] WHEN 1 THEN ['base_' || (o_custkey % 9)] WHEN 2 THEN ['t1'] ELSE []::VARCHAR[] END AS tables FROM orders""")
def sql_audit(t):
    return L.audit(t.orders.select("o_orderkey", F.expr(_SQL.replace("p(''drop table x'')", "p(\\'drop table x\\')")).alias("sql"))).drop("sql")
