"""Catalogue and source operators over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strataloom.functions.storage import shared_folder
from strataloom.registry import query
from strataloom.sources import catalog as S

_FIELDS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}
_NAMES = tuple(_FIELDS)


def _frames(t, names=_NAMES):
    return {n: getattr(t, n) for n in names}


def _filled(table, fields):
    """Position, name, type and number of values of each column, and the rows of the table."""
    pairs = [f.split(" ") for f in fields.split(", ")]
    listed = lambda xs: "[" + ", ".join(xs) + "]"
    return f"SELECT '{table}' AS table_name, unnest(generate_series(1, {len(pairs)})) AS position, unnest({listed(repr(c) for c, _ in pairs)}) AS column_name, unnest({listed(repr(k) for _, k in pairs)}) AS type, unnest({listed(f'count({c})' for c, _ in pairs)}) AS filled, count(*) AS rows FROM {table}"


_LISTED = "(" + " UNION ALL ".join(_filled(n, f) for n, f in _FIELDS.items()) + ")"


def _listed(t):
    return S.columns(_frames(t))


@query(f"SELECT table_name, CAST(position AS INTEGER) AS position, column_name, type, rows, filled FROM {_LISTED}")
def cat_columns(t):
    return _listed(t).drop("comment", "nullable")


@query(f"SELECT table_name, '# ' || table_name || chr(10) || string_agg('- ' || column_name || ': ' || filled || ' of ' || rows, chr(10) ORDER BY position) AS body FROM {_LISTED} GROUP BY 1")
def metadata_docs(t):
    return S.metadata_docs(_listed(t))


@query(f"SELECT table_name AS name, count(*) AS columns, any_value(rows) AS rows FROM {_LISTED} GROUP BY 1")
def cat_tables(t):
    return S.table_list(_listed(t))


@query(f"SELECT table_name AS name, 'CREATE TABLE ' || table_name || ' (' || string_agg(column_name || ' ' || type, ', ' ORDER BY position) || ')' AS ddl FROM {_LISTED} GROUP BY 1")
def cat_ddl(t):
    return S.ddl(_listed(t))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1000")
def table_sample(t):
    return S.sample(t.orders.select("o_orderkey", "o_totalprice"), 1000, ["o_orderkey"])


@query(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n FROM {n}" for n in _NAMES))
def row_count(t):
    return S.row_counts(_frames(t))


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority")
def readonly_query(t):
    return S.read_only(t.spark, "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority;", 5000, {"orders": t.orders})


@query("""SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS price, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS at, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, o_orderstatus AS raw FROM orders""")
def result_normalise(t):
    return S.normalise(t.orders.select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"), F.col("o_orderdate").alias("at"), F.col("o_orderdate").cast("date").alias("day"), F.encode("o_orderstatus", "UTF-8").alias("raw")))


@query("SELECT o_orderkey, o_totalprice FROM orders")
def step_checkpoint(t):
    folder = f"{shared_folder(t.spark)}/steps-{uuid.uuid4().hex}"
    S.save_step(t.orders.select("o_orderkey", "o_totalprice"), folder, "r1", "orders")
    return S.load_step(t.spark, folder, "r1", "orders")


@query("SELECT o_orderkey, o_totalprice FROM orders")
def src_hive(t):
    """A table of the session's catalogue, over files in the shared folder."""
    folder = f"{shared_folder(t.spark)}/hive-{uuid.uuid4().hex}"
    t.orders.select("o_orderkey", "o_totalprice").write.parquet(folder)
    # one name, which each call points to its own files; what was read before keeps its own
    t.spark.sql(f"DROP TABLE IF EXISTS {_HIVE}")
    t.spark.catalog.createTable(_HIVE, path=folder, source="parquet")
    return S.hive(t.spark, _HIVE)


#: The table that src_hive leaves in the catalogue.
_HIVE = "strataloom_orders"
