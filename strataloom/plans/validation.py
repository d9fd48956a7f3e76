"""Shapes, integrity, quality, matching and link prediction over the derived triples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.functions.storage import materialise
from strataloom.operators import embeddings as E
from strataloom.operators import matching as M
from strataloom.operators import validation as V
from strataloom.plans.fixtures import KG, kg
from strataloom.plans.metrics import _r
from strataloom.registry import ORACLES, query

_REQUIRED = [("Term", "label", 1, "Violation"), ("Term", "altLabel", 1, "Warning"), ("Metric", "formula", 1, "Violation"), ("Metric", "computedFrom", 1, "Violation"), ("Table", "joinableWith", 1, "Info"), ("Concept", "broader", 1, "Info")]
_VALUES = "(VALUES " + ", ".join(f"('{c}', '{p}', {n}, '{s}')" for c, p, n, s in _REQUIRED) + ") x(class, path, least, severity)"


@query(f"""SELECT t.s, 'min_count' AS shape, x.path, CAST(coalesce(n, 0) AS VARCHAR) AS value, x.severity FROM (SELECT DISTINCT s, o AS class FROM {KG} WHERE p = 'type') t JOIN {_VALUES} USING (class) LEFT JOIN (SELECT s, p AS path, count(*) AS n FROM {KG} GROUP BY 1, 2) h ON h.s = t.s AND h.path = x.path WHERE coalesce(n, 0) < least""")
def shape_min_count(t):
    return V.min_count(kg(t), t.spark.createDataFrame(_REQUIRED, "class string, path string, least int, severity string"))


_KINDS = [("Term", "status", "in", ["approved", "rejected"], None, None, "Violation"), ("Metric", "formula", "min_length", None, 14.0, None, "Warning"), ("Term", "label", "datatype", None, None, None, "Info"), ("Metric", "label", "node", None, None, None, "Info"), ("Table", "label", "range", None, 0.0, 1.0, "Warning")]
_SHAPE = "class string, path string, kind string, allowed array<string>, low double, high double, severity string"


def _values_sql(kind, cls, path, test, severity):
    return f"SELECT k.s, '{kind}' AS shape, '{path}' AS path, k.o AS value, '{severity}' AS severity FROM {KG} k WHERE p = '{path}' AND ({test}) AND s IN (SELECT s FROM {KG} WHERE p = 'type' AND o = '{cls}')"


for _name, _sql in {
    "shape_in": _values_sql("in", "Term", "status", "o NOT IN ('approved', 'rejected')", "Violation"),
    "shape_min_length": _values_sql("min_length", "Metric", "formula", "length(o) < 14", "Warning"),
    "shape_datatype": _values_sql("datatype", "Term", "label", "TRY_CAST(o AS DOUBLE) IS NULL", "Info"),
    "shape_node_kind": _values_sql("node", "Metric", "label", "NOT iri", "Info"),
    "shape_range": _values_sql("range", "Table", "label", "TRY_CAST(o AS DOUBLE) IS NULL OR TRY_CAST(o AS DOUBLE) NOT BETWEEN 0 AND 1", "Warning"),
}.items():
    _kind = {"shape_node_kind": "node"}.get(_name, _name[6:])

    @query(_sql, _name)
    def _values(t, kind=_kind):
        return V.values(kg(t), t.spark.createDataFrame([x for x in _KINDS if x[2] == kind], _SHAPE))


@query(f"SELECT DISTINCT s, 'class' AS shape, 'computedFrom' AS path, o AS value, 'Violation' AS severity FROM {KG} WHERE p = 'computedFrom' AND o NOT IN (SELECT s FROM {KG} WHERE p = 'type' AND o = 'Table')")
def shape_class(t):
    return V.class_of_target(kg(t), "computedFrom", "Table")


#: Events that nations are related to, and lineages of orders, beside the derived triples.
_RULED = f"""(SELECT s, p, o, iri FROM {KG} UNION ALL SELECT DISTINCT 'ev/' || event_type, 'type', 'Event', true FROM events UNION ALL SELECT DISTINCT 'n/' || (user_id % 25), 'relatedTo', 'ev/' || event_type, true FROM events
  UNION ALL SELECT 'lin/' || o_orderkey, 'type', 'Lineage', true FROM orders UNION ALL SELECT 'lin/' || o_orderkey, 'sourceField', o_orderstatus, false FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 'lin/' || o_orderkey, 'targetField', o_orderpriority, false FROM orders WHERE o_orderkey % 4 = 0)"""


def _ruled(t):
    made = lambda df, s, p, o, iri: df.select(F.expr(s).alias("s"), F.lit(p).alias("p"), F.expr(o).alias("o"), F.lit(iri).alias("iri"))
    events = [made(t.events, "'ev/' || event_type", "type", "'Event'", True).distinct(), made(t.events, "'n/' || (user_id % 25)", "relatedTo", "'ev/' || event_type", True).distinct()]
    fields = [made(t.orders, "'lin/' || o_orderkey", "type", "'Lineage'", True), made(t.orders.where("o_orderkey % 3 = 0"), "'lin/' || o_orderkey", "sourceField", "o_orderstatus", False), made(t.orders.where("o_orderkey % 4 = 0"), "'lin/' || o_orderkey", "targetField", "o_orderpriority", False)]
    return reduce(DataFrame.unionByName, [kg(t).select("s", "p", "o", "iri"), *events, *fields])


@query(f"""WITH k AS MATERIALIZED (SELECT * FROM {_RULED}) SELECT s, 'self_parent' AS shape, p AS path, o AS value, 'Violation' AS severity FROM k WHERE p = 'broader' AND s = o
  UNION ALL SELECT s, 'lineage_fields', 'sourceField', NULL, 'Violation' FROM k WHERE p = 'type' AND o = 'Lineage' AND s NOT IN (SELECT s FROM k WHERE p IN ('sourceField', 'targetField'))
  UNION ALL SELECT DISTINCT s, 'missing_target', p, o, 'Warning' FROM k WHERE p IN ('groundedBy', 'transformsFrom') AND o NOT IN (SELECT s FROM k)
  UNION ALL SELECT DISTINCT s, 'not_a_table', p, o, 'Warning' FROM k WHERE p = 'computedFrom' AND o NOT IN (SELECT s FROM k WHERE p = 'type' AND o = 'Table')
  UNION ALL SELECT DISTINCT s, 'concept_to_event', p, o, 'Violation' FROM k WHERE p <> 'type' AND o IN (SELECT s FROM k WHERE p = 'type' AND o = 'Event') AND s IN (SELECT s FROM k WHERE p = 'type' AND o = 'Concept')""")
def shape_graph_rules(t):
    return V.graph_rules(_ruled(t))


def _violations(t):
    triples = materialise(kg(t), "triples")  # every shape reads them
    return reduce(DataFrame.unionByName, [V.min_count(triples, t.spark.createDataFrame(_REQUIRED, "class string, path string, least int, severity string")), V.values(triples, t.spark.createDataFrame(_KINDS, _SHAPE)), V.class_of_target(triples, "computedFrom", "Table"), V.graph_rules(materialise(_ruled(t), "ruled"))])


_ALL = " UNION ALL ".join(f"SELECT severity, shape FROM ({ORACLES[n]})" for n in ("shape_min_count", "shape_in", "shape_min_length", "shape_datatype", "shape_node_kind", "shape_range", "shape_class", "shape_graph_rules"))


@query(f"SELECT severity, shape, count(*) AS n, severity <> 'Violation' AS conforms FROM ({_ALL}) GROUP BY 1, 2")
def shapes_validate(t):
    return V.summary(_violations(t))


_REFS = ["broader", "derivedFrom", "computedFrom", "joinableWith", "transformsFrom", "groundedBy"]
_REFS_SQL = ", ".join(f"'{p}'" for p in _REFS)


@query(f"SELECT DISTINCT s, p, o FROM {KG} WHERE p IN ({_REFS_SQL}) AND o NOT IN (SELECT s FROM {KG})")
def xref_missing_target(t):
    return V.missing_targets(kg(t), _REFS)


_UNTYPED = f"(SELECT * FROM {KG} WHERE NOT (p = 'type' AND s LIKE 's/%3'))"


@query(f"SELECT DISTINCT s, p, o FROM {_UNTYPED} WHERE p IN ({_REFS_SQL}) AND o IN (SELECT s FROM {_UNTYPED}) AND o NOT IN (SELECT s FROM {_UNTYPED} WHERE p = 'type')")
def xref_missing_type(t):
    return V.missing_types(kg(t).where("not (p = 'type' and s like 's/%3')"), _REFS)


@query(f"SELECT count(*) AS metrics, count(*) FILTER (s NOT IN (SELECT s FROM {KG} WHERE p = 'derivedFrom' AND o IN (SELECT s FROM {KG}))) AS orphans FROM (SELECT DISTINCT s FROM {KG} WHERE p = 'type' AND o = 'Metric')")
def xref_orphan_rule(t):
    triples = kg(t)
    rules = triples.where("p = 'type' and o = 'Metric'").select("s").distinct()
    good = triples.where("p = 'derivedFrom'").join(triples.select(F.col("s").alias("o")).distinct(), "o", "left_semi").select("s").distinct().withColumn("good", F.lit(True))
    return rules.join(good, "s", "left").agg(F.count("*").alias("metrics"), F.count_if(F.col("good").isNull()).alias("orphans"))


_FLAGS = """(SELECT l_suppkey AS grp, l_tax > 0.02 AS defined, l_discount < 0.08 AS valid, l_linenumber > 2 AS multi, l_returnflag = 'R' AS conflicting, l_shipdate >= TIMESTAMP '1997-01-01' AS reviewed, l_linestatus = 'F' AS approved FROM lineitem)"""
_DIMS = f"""(SELECT grp, {_r('CAST(count(*) FILTER (defined) AS DOUBLE) / count(*)', 4)} AS completeness, {_r('CAST(count(*) FILTER (valid) AS DOUBLE) / count(*)', 4)} AS accuracy, coalesce({_r('CAST(count(*) FILTER (multi AND NOT conflicting) AS DOUBLE) / nullif(count(*) FILTER (multi), 0)', 4)}, 1.0) AS consistency,
  {_r('CAST(count(*) FILTER (reviewed) AS DOUBLE) / count(*)', 4)} AS timeliness, {_r('CAST(count(*) FILTER (approved) AS DOUBLE) / count(*)', 4)} AS authority FROM {_FLAGS} GROUP BY 1)"""


@query(f"SELECT * FROM {_DIMS}")
def quality_dims(t):
    flags = t.lineitem.select(F.col("l_suppkey").alias("grp"), (F.col("l_tax") > 0.02).alias("defined"), (F.col("l_discount") < 0.08).alias("valid"), (F.col("l_linenumber") > 2).alias("multi_source"), (F.col("l_returnflag") == "R").alias("conflicting"), (F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz")).alias("reviewed"), (F.col("l_linestatus") == "F").alias("approved"))
    return V.quality(flags, ["grp"])


_OVERALL = _r("0.0 + completeness * 0.25::DOUBLE + accuracy * 0.3::DOUBLE + consistency * 0.2::DOUBLE + timeliness * 0.1::DOUBLE + authority * 0.15::DOUBLE", 4)


@query(f"SELECT *, CASE WHEN overall >= 0.9 THEN 'A' WHEN overall >= 0.75 THEN 'B' WHEN overall >= 0.6 THEN 'C' WHEN overall >= 0.4 THEN 'D' ELSE 'F' END AS grade FROM (SELECT *, {_OVERALL} AS overall FROM {_DIMS})")
def quality_grade(t):
    return V.graded(quality_dims(t))


@query(f"SELECT 'q/' || grp AS s, unnest(['completeness', 'accuracy', 'score']) AS p, unnest([completeness, accuracy, {_OVERALL}]) AS value FROM {_DIMS}")
def quality_report(t):
    g = quality_grade(t)
    rows = F.array(*(F.struct(F.lit(p).alias("p"), F.col(c).alias("value")) for p, c in (("completeness", "completeness"), ("accuracy", "accuracy"), ("score", "overall"))))
    return g.select(F.expr("'q/' || grp").alias("s"), F.explode(rows).alias("x")).select("s", "x.*")


@query(f"SELECT o_orderpriority, {_r('''100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*)''', 1)} AS pass_rate FROM orders GROUP BY 1")
def pass_rate(t):
    from strataloom.functions.numbers import ratio

    return t.orders.groupBy("o_orderpriority").agg(ratio(F.count_if(F.col("o_orderstatus") == "F"), F.count("*"), 1, 100.0).alias("pass_rate"))


def _match_sql(key, exact, close, target):
    sim = _r("list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))", 6)
    return f"""SELECT id, {'target, ' if target else ''}other, sim, CASE WHEN sim >= {exact} THEN 'exactMatch' ELSE 'closeMatch' END AS relation, {_r('100 * sim', 1)} AS confidence FROM (SELECT a.vec_id AS id, CAST(b.vec_id % {key} AS VARCHAR) AS target, b.vec_id AS other, {sim} AS sim FROM embeddings a JOIN embeddings b ON a.vec_id % {key} <> b.vec_id % {key}
      QUALIFY row_number() OVER (PARTITION BY a.vec_id{', b.vec_id % ' + str(key) if target else ''} ORDER BY sim DESC, b.vec_id) = 1) WHERE sim >= {close}"""


def _match(t, key, exact, close, by_target):
    v = t.embeddings.select(F.col("vec_id").alias("id"), (F.col("vec_id") % key).alias("grp"), F.col("embedding").alias("vector"))
    return M.match(v, v, exact, close, by_target)


@query(_match_sql(2, 0.5, 0.35, False))
def match_across_bases(t):
    return _match(t, 2, 0.5, 0.35, False)


@query(_match_sql(5, 0.88, 0.3, True))
def match_across_domains(t):
    """The best match of each term in each other domain."""
    return _match(t, 5, 0.88, 0.3, True)


def _learned(t):
    return E.transe_fit(kg(t), epochs=3)


def _asked(t):
    return t.part.select(F.expr("'p/' || p_partkey").alias("s"), F.lit("computedFrom").alias("p"))


def _asked_heads(t):
    return t.supplier.select(F.expr("'s/' || s_suppkey").alias("o"), F.lit("computedFrom").alias("p"))


@query()
def kge_fit(t):
    return _learned(t)


@query()
def kge_predict(t):
    return E.transe_predict(_learned(t), _asked(t), 5)


@query()
def kge_predict_heads(t):
    return E.transe_predict(_learned(t), _asked_heads(t), 5)


@query()
def kge_discover(t):
    return E.transe_discover(_learned(t), kg(t), _asked(t), 3, 0.1)
