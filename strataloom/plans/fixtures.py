"""Triples and edges that stand for a semantic layer, derived from the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (table, subject, predicate, object, object is a node, graph, condition); expressions that both engines read.
_KG = [
    ("region", "'r/' || r_regionkey", "type", "'Concept'", "true", "'g0'", "true"),
    ("region", "'r/' || r_regionkey", "label", "r_name", "false", "'g0'", "true"),
    ("nation", "'n/' || n_nationkey", "type", "'Concept'", "true", "'g0'", "true"),
    ("nation", "'n/' || n_nationkey", "label", "n_name", "false", "'g0'", "true"),
    ("nation", "'n/' || n_nationkey", "broader", "'r/' || n_regionkey", "true", "'g0'", "true"),
    ("customer", "'c/' || c_custkey", "type", "'Term'", "true", "'g' || (c_custkey % 3)", "true"),
    ("customer", "'c/' || c_custkey", "label", "c_name", "false", "'g' || (c_custkey % 3)", "true"),
    ("customer", "'c/' || c_custkey", "altLabel", "lower(c_name)", "false", "'g' || (c_custkey % 3)", "c_custkey % 2 = 0"),
    ("customer", "'c/' || c_custkey", "altLabel", "c_mktsegment", "false", "'g' || (c_custkey % 3)", "c_custkey % 4 = 0"),
    ("customer", "'c/' || c_custkey", "broader", "'n/' || c_nationkey", "true", "'g' || (c_custkey % 3)", "true"),
    ("customer", "'c/' || c_custkey", "status", "'approved'", "false", "'g' || (c_custkey % 3)", "c_custkey % 5 < 2"),
    ("customer", "'c/' || c_custkey", "status", "'draft'", "false", "'g' || (c_custkey % 3)", "c_custkey % 5 = 2"),
    ("customer", "'c/' || c_custkey", "groundedBy", "'chunk/' || (c_custkey % 100)", "true", "'g' || (c_custkey % 3)", "true"),
    ("part", "'p/' || p_partkey", "type", "'Metric'", "true", "'g1'", "true"),
    ("part", "'p/' || p_partkey", "label", "p_name", "false", "'g1'", "true"),
    ("part", "'p/' || p_partkey", "formula", "'sum(' || lower(p_brand) || ')'", "false", "'g1'", "p_partkey % 4 = 0"),
    ("part", "'p/' || p_partkey", "derivedFrom", "'p/' || (p_partkey - p_partkey % 10)", "true", "'g1'", "p_partkey % 10 <> 0 AND p_partkey > 10"),
    ("part", "'p/' || p_partkey", "computedFrom", "'s/' || (p_partkey % 50 + 1)", "true", "'g1'", "true"),
    ("supplier", "'s/' || s_suppkey", "type", "'Table'", "true", "'g2'", "true"),
    ("supplier", "'s/' || s_suppkey", "label", "s_name", "false", "'g2'", "true"),
    ("supplier", "'s/' || s_suppkey", "joinableWith", "'s/' || (s_suppkey + 7)", "true", "'g2'", "s_suppkey < 90"),
    ("supplier", "'s/' || s_suppkey", "transformsFrom", "'s/' || (s_suppkey + 12)", "true", "'g2'", "s_suppkey % 3 = 0 AND s_suppkey < 80"),
]
KG = "(" + " UNION ALL ".join(f"SELECT {s} AS s, '{p}' AS p, {o} AS o, {iri} AS iri, {g} AS g FROM {table} WHERE {where}" for table, s, p, o, iri, g, where in _KG) + ")"


def kg(t) -> DataFrame:
    """Each table is read once: its triples are exploded from an array."""
    by: dict[str, list] = {}
    for table, s, p, o, iri, g, where in _KG:
        by.setdefault(table, []).append(F.expr(f"CASE WHEN {where} THEN struct({s} AS s, '{p}' AS p, CAST({o} AS STRING) AS o, {iri} AS iri, {g} AS g) END"))
    parts = [getattr(t, table).select(F.explode(F.array_compact(F.array(*xs))).alias("x")).select("x.*") for table, xs in by.items()]
    return reduce(DataFrame.unionByName, parts)


TREE = "(SELECT p_partkey AS a, p_partkey // 2 AS b FROM part WHERE p_partkey > 1)"


def tree(t) -> DataFrame:
    return t.part.where("p_partkey > 1").select(F.col("p_partkey").alias("a"), F.expr("p_partkey div 2").alias("b"))
