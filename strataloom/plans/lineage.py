"""Code and SQL lineage over statements that are written from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.operators import code as L
from strataloom.registry import query

_T, _S = "'dws_t' || (o_custkey % 40)", "'ods_s' || (o_custkey % 25)"
_KIND = "o_orderkey % 6"


def files(t):
    """One small file for each order: SQL, pandas, Spark, an object mapper or a model, by the order's number."""
    tgt, src = F.concat(F.lit("dws_t"), F.col("o_custkey") % 40), F.concat(F.lit("ods_s"), F.col("o_custkey") % 25)
    k = F.col("o_orderkey") % 6
    body = (
        F.when(k == 0, F.concat(F.lit("INSERT INTO db."), tgt, F.lit("\nSELECT a.x FROM `"), src, F.lit("` a\nLEFT JOIN dim_user u ON a.u = u.id\nJOIN dim_day ON a.d = dim_day.d;")))
        .when(k == 1, F.concat(F.lit("create or replace table "), tgt, F.lit(" as select * from "), src, F.lit(" where x = 1;")))
        .when(k == 2, F.concat(F.lit("df = pd.read_sql(\"SELECT * FROM "), src, F.lit("\", con)\ndf.to_sql('"), tgt, F.lit("', con)\n")))
        .when(k == 3, F.concat(F.lit("spark.sql(\"\"\"INSERT INTO "), tgt, F.lit(" SELECT * FROM "), src, F.lit("\"\"\")\na = spark.table('db."), src, F.lit("')\nb = spark.read.table(\"dim_user\")\nc = a.join(b, on=['user_id'])\nb.createOrReplaceTempView('v"), F.col("o_custkey") % 9, F.lit("')\n")))
        .when(k == 4, F.concat(F.lit("class Left(Base):\n    __tablename__ = '"), src, F.lit("'\n\nsession.query(Left).join(Other)\n\n@dataclass\nclass Row"), F.col("o_orderkey"), F.lit(":\n    \"\"\"A row.\"\"\"\n    a: int\n    b: str\n")))
        .otherwise(F.concat(F.lit("select * from {{ ref('"), src, F.lit("') }}")))
    )
    ext = F.when(k.isin(0, 1), ".sql").when(k.isin(2, 3, 4), ".py").otherwise(".yml")
    return t.orders.select(F.concat(F.lit("src/f"), "o_orderkey", ext).alias("path"), body.alias("body"))


_PATH = f"'src/f' || o_orderkey || CASE WHEN {_KIND} < 2 THEN '.sql' WHEN {_KIND} < 5 THEN '.py' ELSE '.yml' END"


@query(f"""SELECT path, unnest(CASE k WHEN 0 THEN [tgt, src, 'dim_user', 'dim_day'] WHEN 1 THEN [tgt, src] WHEN 2 THEN [src] WHEN 3 THEN [tgt, src] WHEN 4 THEN [src] ELSE [src] END) AS name FROM (SELECT {_PATH} AS path, {_KIND} AS k, {_T} AS tgt, {_S} AS src FROM orders)""")
def code_table_refs(t):
    return L.table_refs(files(t)).where("name <> '{{'")


_SQL_EDGES = f"SELECT {_PATH} AS path, {_S} AS source, {_T} AS target FROM orders WHERE {_KIND} < 2"


@query(_SQL_EDGES)
def sql_lineage(t):
    return L.lineage(files(t).where("path like '%.sql'"))


@query(f"SELECT {_PATH} AS path, unnest(['left', 'inner']) AS kind, {_S} AS left, unnest(['dim_user', 'dim_day']) AS right, unnest(['a.u = u.id', 'a.d = dim_day.d']) AS on_text FROM orders WHERE {_KIND} = 0")
def sql_joins(t):
    return L.joins(files(t).where("path like '%.sql'"))


@query(f"SELECT {_PATH} AS path, {_S} AS source, {_T} AS target FROM orders WHERE {_KIND} = 3")
def embedded_sql(t):
    return L.lineage(L.embedded(files(t)))


py_sql = query(f"SELECT {_PATH} AS path, {_S} AS source, {_T} AS target FROM orders WHERE {_KIND} = 3", "py_sql")(lambda t: L.lineage(L.embedded(files(t).where("path like '%.py'"))))


@query(f"""SELECT path, unnest(['sql', 'join', 'view']) AS kind, unnest([src, src, 'dim_user']) AS source, unnest([tgt, 'dim_user', 'v' || n]) AS target, unnest(['', 'user_id', '']) AS key FROM (SELECT {_PATH} AS path, {_S} AS src, {_T} AS tgt, o_custkey % 9 AS n FROM orders WHERE {_KIND} = 3)""")
def spark_edges(t):
    return L.spark_edges(files(t))


@query(f"SELECT {_PATH} AS path, {_S} AS source, {_T} AS target FROM orders WHERE {_KIND} = 2")
def pandas_edges(t):
    return L.pandas_edges(files(t))


_MERGES = ("pd.merge(a, b, on='user_id')", "a.merge(b, how='left', on=['user_id', 'dt'])", "pd.merge(left=a, right=unread, left_on='u', right_on=\"id\")")


@query(f"""SELECT 'm/' || o_orderkey || '.py' AS path, {_S} AS left, CASE o_custkey % 3 WHEN 2 THEN 'unread' ELSE 'dim_day' END AS right, CASE o_custkey % 3 WHEN 0 THEN 'user_id' WHEN 1 THEN 'user_id,dt' ELSE 'u=id' END AS key FROM orders""")
def pandas_joins(t):
    """Merges of frames that were read from tables, in one of three forms by the order's customer."""
    src = F.concat(F.lit("ods_s"), F.col("o_custkey") % 25)
    merge = F.element_at(F.array(*map(F.lit, _MERGES)), (F.col("o_custkey") % 3 + 1).cast("int"))
    body = F.concat(F.lit("import pandas as pd\na = pd.read_sql(\"SELECT x FROM db."), src, F.lit(" WHERE y\", con)\nb = pd.read_sql_table('dim_day', con)\nc = "), merge, F.lit("\n"))
    return L.pandas_joins(t.orders.select(F.concat(F.lit("m/"), "o_orderkey", F.lit(".py")).alias("path"), body.alias("body")))


@query(f"SELECT {_PATH} AS path, {_S} AS left, 'other' AS right FROM orders WHERE {_KIND} = 4")
def orm_edges(t):
    return L.orm_edges(files(t))


@query(f"SELECT {_PATH} AS path, {_S} AS source, 'f' || o_orderkey AS target FROM orders WHERE {_KIND} = 5")
def dbt_edges(t):
    return L.dbt_edges(files(t))


@query(f"SELECT {_PATH} AS path, 'dataclass' AS kind, 'Row' || o_orderkey AS name, 'A row.' AS label, ['a', 'b'] AS fields FROM orders WHERE {_KIND} = 4")
def code_terms(t):
    return L.code_terms(files(t).where("path like '%.py'"))


_ALL = f"(SELECT {_PATH} AS path, {_S} AS source, CASE WHEN {_KIND} = 5 THEN 'f' || o_orderkey ELSE {_T} END AS target FROM orders WHERE {_KIND} <> 4)"


@query(f"SELECT * FROM {_ALL}")
def code_edges(t):
    return L.all_edges(files(t))


_PAIRS = f"(SELECT DISTINCT source, target FROM {_ALL})"


@query(f"""SELECT CASE i WHEN 0 THEN 'table/' || target ELSE 'lineage/' || substr(sha256(source || '>' || target), 1, 16) END AS s, ['transformsFrom', 'sourceTable', 'targetTable', 'layer'][i + 1] AS p, CASE i WHEN 0 THEN 'table/' || source WHEN 1 THEN source WHEN 2 THEN target ELSE CASE WHEN target LIKE 'dws%' THEN 'DWS' ELSE 'DWD' END END AS o FROM {_PAIRS} CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS i)""")
def edges_to_triples(t):
    return L.edge_triples(L.all_edges(files(t)))


@query(f"""WITH f AS (SELECT CASE WHEN {_KIND} < 2 THEN '.sql' WHEN {_KIND} < 5 THEN '.py' ELSE '.yml' END AS ext, {_KIND} AS k FROM orders) SELECT ext, count(*) AS files, 0::BIGINT AS short, count(*) FILTER (k <> 4) AS edges FROM f GROUP BY 1""")
def code_diagnostics(t):
    return L.diagnostics(files(t))


@query(f"SELECT path, CASE WHEN path LIKE '%.sql' THEN 0 ELSE 2 END AS priority FROM (SELECT {_PATH} AS path FROM orders) WHERE path NOT LIKE '%.yml' ORDER BY priority, path LIMIT 6000")
def code_entry_select(t):
    return L.select_entries(files(t), (".yml", ".ts", ".tsx", ".jsx"), 6000)
