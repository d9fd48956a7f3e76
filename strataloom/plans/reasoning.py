"""Rules and closures over the derived triples and edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.operators import reasoning as Z
from strataloom.plans.fixtures import KG, TREE, kg, tree
from strataloom.registry import query

K = f"k AS MATERIALIZED (SELECT DISTINCT s, p, o FROM {KG})"
NEW = "EXCEPT SELECT s, p, o FROM k"


@query(f"WITH RECURSIVE r AS (SELECT a, b FROM {TREE} UNION SELECT r.a, e.b FROM r JOIN {TREE} e ON r.b = e.a) SELECT a, b FROM r WHERE a <> b")
def rule_transitive(t):
    return Z.transitive(tree(t))


@query(f"WITH RECURSIVE {K}, r AS (SELECT s, p, o FROM k WHERE p IN ('derivedFrom', 'transformsFrom') UNION SELECT r.s, r.p, k.o FROM r JOIN k ON r.o = k.s AND r.p = k.p) SELECT s, p, o FROM r WHERE s <> o {NEW}")
def rule_transitive_triples(t):
    return Z.rule_transitive(kg(t))


@query(f"WITH {K} SELECT o AS s, p, s AS o FROM k WHERE p IN ('joinableWith', 'exactMatch') {NEW}")
def rule_symmetric(t):
    return Z.rule_symmetric(kg(t))


@query(f"WITH {K} SELECT o AS s, CASE p WHEN 'broader' THEN 'narrower' WHEN 'groundedBy' THEN 'asserts' ELSE 'usedBy' END AS p, s AS o FROM k WHERE p IN ('broader', 'groundedBy', 'computedFrom') {NEW}")
def rule_inverse(t):
    return Z.rule_inverse(kg(t))


def _schema(t, rows):
    return t.spark.createDataFrame(rows, "a string, b string")


@query(f"WITH {K} SELECT DISTINCT s, 'type' AS p, x AS o FROM (SELECT s, unnest(CASE o WHEN 'Metric' THEN ['Measure', 'Thing'] WHEN 'Term' THEN ['Concept', 'Thing'] WHEN 'Concept' THEN ['Thing'] ELSE []::VARCHAR[] END) AS x FROM k WHERE p = 'type') {NEW}")
def rule_subclass(t):
    return Z.rule_subclass(kg(t), _schema(t, [("Metric", "Measure"), ("Measure", "Thing"), ("Term", "Concept"), ("Concept", "Thing")]))


@query(f"WITH {K} SELECT s, x AS p, o FROM (SELECT s, o, unnest(CASE p WHEN 'derivedFrom' THEN ['dependsOn', 'relatedTo'] WHEN 'joinableWith' THEN ['relatedTo'] ELSE []::VARCHAR[] END) AS x FROM k) {NEW}")
def rule_subproperty(t):
    return Z.rule_subproperty(kg(t), _schema(t, [("derivedFrom", "dependsOn"), ("dependsOn", "relatedTo"), ("joinableWith", "relatedTo")]))


@query(f"WITH {K} SELECT s, 'type' AS p, 'Dataset' AS o FROM k WHERE p = 'type' AND o = 'Table' UNION SELECT * FROM (VALUES ('Table', 'subClassOf', 'Dataset'), ('Dataset', 'subClassOf', 'Table'))")
def rule_equivalent(t):
    return Z.rule_equivalent(kg(t), _schema(t, [("Table", "Dataset")]))


_BGP = "WITH " + K + " SELECT DISTINCT a.s, 'linkedTo' AS p, c.o FROM k a JOIN k b ON a.o = b.s JOIN k c ON b.o = c.s WHERE a.p = 'computedFrom' AND b.p = 'joinableWith' AND c.p = 'transformsFrom' AND a.s <> c.o"


@query(_BGP)
def rule_bgp(t):
    return Z.rule_bgp(kg(t), [("?a", "computedFrom", "?b"), ("?b", "joinableWith", "?c"), ("?c", "transformsFrom", "?d")], ("?a", "linkedTo", "?d"))


def _business(name, p1, p2, p3, subject, obj):
    @query(f"WITH {K} SELECT DISTINCT {subject} AS s, '{p3}' AS p, {obj} AS o FROM k a JOIN k b ON {'a.s = b.s' if name == 'grounding_inherit' else 'a.o = b.s'} WHERE a.p = '{p1}' AND b.p = '{p2}' {NEW}", f"rule_{name}")
    def rule(t):
        return Z.rule_bgp(kg(t), *Z.RULES[name])


_business("metric_depends", "derivedFrom", "computedFrom", "dependsOn", "a.s", "b.o")
_business("metric_inherits", "derivedFrom", "formula", "inheritsFormula", "a.s", "b.o")
_business("metric_dim_column", "computedFrom", "joinableWith", "canGroupBy", "a.s", "b.o")
_business("grounding_inherit", "broader", "groundedBy", "groundedBy", "a.o", "b.o")


#: A relation is its own inverse over joins, tables know what is computed from them, and metrics group by what joins.
_REASONED = Z.rules_of(symmetric=("joinableWith",), inverse={"computedFrom": "usedBy"}, business=("metric_dim_column",))


@query(f"""WITH {K}, r1 AS MATERIALIZED (SELECT o AS s, p, s AS o FROM k WHERE p = 'joinableWith' UNION SELECT o, 'usedBy', s FROM k WHERE p = 'computedFrom' {NEW}),
  r2 AS (SELECT DISTINCT a.s, 'canGroupBy' AS p, b.o FROM (SELECT * FROM k UNION ALL SELECT * FROM r1) a JOIN (SELECT * FROM k UNION ALL SELECT * FROM r1) b ON a.o = b.s WHERE a.p = 'computedFrom' AND b.p = 'joinableWith'),
  r0 AS MATERIALIZED (SELECT DISTINCT a.s, 'canGroupBy' AS p, b.o FROM k a JOIN k b ON a.o = b.s WHERE a.p = 'computedFrom' AND b.p = 'joinableWith')
  SELECT *, 1 AS round FROM r1 UNION ALL SELECT *, 1 FROM r0 UNION ALL SELECT *, 2 FROM (SELECT * FROM r2 EXCEPT SELECT * FROM r0)""")
def reason_fixpoint(t):
    return Z.semi_naive(kg(t), _REASONED)[0]


@query(f"""WITH RECURSIVE {K}, t AS MATERIALIZED (SELECT s, p, o FROM k WHERE p IN ('derivedFrom', 'transformsFrom')),
  c AS (SELECT s, p, o FROM t UNION SELECT c.s, c.p, t.o FROM c JOIN t ON c.o = t.s AND c.p = t.p),
  d AS MATERIALIZED (SELECT DISTINCT * FROM c WHERE s <> o EXCEPT SELECT * FROM k),
  f AS (SELECT DISTINCT a.s, 'dependsOn' AS p, b.o FROM (SELECT * FROM k UNION SELECT * FROM d) a JOIN k b ON a.o = b.s WHERE a.p = 'derivedFrom' AND b.p = 'computedFrom')
  SELECT * FROM (SELECT 'transitive' AS rule, count(*) AS n FROM d UNION ALL SELECT 'inverse', count(*) FROM (SELECT DISTINCT o, s FROM k WHERE p = 'computedFrom') UNION ALL SELECT 'metric_depends', count(*) FROM f) WHERE n > 0""")
def reason_fixpoint_counts(t):
    rules = Z.rules_of(transitive_over=("derivedFrom", "transformsFrom"), inverse={"computedFrom": "usedBy"}, business=("metric_depends",))
    return Z.semi_naive(kg(t), rules)[1].groupBy("rule").agg(F.sum("n").alias("n"))


_J = f"(SELECT s AS a, o AS b FROM {KG} WHERE p = 'joinableWith' UNION SELECT o, s FROM {KG} WHERE p = 'joinableWith')"


@query(f"WITH e AS MATERIALIZED (SELECT * FROM {_J}), h2 AS (SELECT x.a, y.b FROM e x JOIN e y ON x.b = y.a), h3 AS (SELECT x.a, y.b FROM h2 x JOIN e y ON x.b = y.a) SELECT a, b FROM (SELECT * FROM e UNION SELECT * FROM h2 UNION SELECT * FROM h3) WHERE a <> b")
def join_closure_hops(t):
    return Z.reach(kg(t).where("p = 'joinableWith'").select(F.col("s").alias("a"), F.col("o").alias("b")), 3)


_CYCLE = f"(SELECT child, min(parent) AS parent FROM (SELECT a AS child, b AS parent FROM {TREE} UNION ALL SELECT 1, 5 UNION ALL SELECT 7, 7) WHERE child <> parent GROUP BY 1)"


def _cycled(t):
    edges = tree(t).select(F.col("a").alias("child"), F.col("b").alias("parent"))
    return edges.unionByName(t.spark.createDataFrame([(1, 5), (7, 7)], "child bigint, parent bigint"))


@query(f"WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {_CYCLE}), r AS (SELECT child AS start, parent AS node, 1 AS d FROM e UNION ALL SELECT start, parent, d + 1 FROM r JOIN e ON child = node WHERE d < 20 AND node <> start), c AS (SELECT DISTINCT start FROM r WHERE node = start) SELECT child, parent FROM e WHERE child <> (SELECT min(start) FROM c)")
def hier_cycles(t):
    return Z.without_cycles(_cycled(t))


@query(f"WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {TREE}), h AS (SELECT 1::BIGINT AS node, 0 AS depth UNION ALL SELECT a, depth + 1 FROM h JOIN e ON b = node) SELECT node, depth, depth > 6 AS deep FROM h")
def hier_depth(t):
    return Z.depths(tree(t).select(F.col("a").alias("child"), F.col("b").alias("parent")))
