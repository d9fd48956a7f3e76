"""Shapes as rows, integrity checks and quality measures.

A constraint is a row of a small table; all constraints of a kind are checked in one join. Violations are
rows (s, shape, path, value, severity).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions.numbers import ratio, rounded

VIOLATION = ["s", "shape", "path", "value", "severity"]
WEIGHTS = {"completeness": 0.25, "accuracy": 0.30, "consistency": 0.20, "timeliness": 0.10, "authority": 0.15}
GRADES = (("A", 0.90), ("B", 0.75), ("C", 0.60), ("D", 0.40))


def targets(kg: DataFrame, constraints: DataFrame) -> DataFrame:
    """Subjects of each constraint's class; constraints (class, path, ...)."""
    return kg.where("p = 'type'").select("s", F.col("o").alias("class")).distinct().join(F.broadcast(constraints), "class")


def min_count(kg: DataFrame, constraints: DataFrame) -> DataFrame:
    """Missing required properties; constraints (class, path, least, severity)."""
    have = kg.groupBy("s", F.col("p").alias("path")).agg(F.count("*").alias("n"))
    bad = targets(kg, constraints).join(have, ["s", "path"], "left").where(F.coalesce("n", F.lit(0)) < F.col("least"))
    return bad.select("s", F.lit("min_count").alias("shape"), "path", F.coalesce("n", F.lit(0)).cast("string").alias("value"), "severity")


def values(kg: DataFrame, constraints: DataFrame) -> DataFrame:
    """Values that break a constraint (class, path, kind, allowed, low, high, severity) of kind in, range, min_length, datatype or node."""
    v = targets(kg, constraints).join(kg.select("s", F.col("p").alias("path"), F.col("o").alias("value"), "iri"), ["s", "path"])
    number = F.col("value").try_cast("double")
    bad = (
        F.when(F.col("kind") == "in", ~F.array_contains("allowed", F.col("value")))
        .when(F.col("kind") == "range", number.isNull() | (number < F.col("low")) | (number > F.col("high")))
        .when(F.col("kind") == "min_length", F.length("value") < F.col("low"))
        .when(F.col("kind") == "datatype", number.isNull())
        .when(F.col("kind") == "node", ~F.col("iri"))
    )
    return v.where(bad).select("s", F.col("kind").alias("shape"), "path", "value", "severity")


def class_of_target(kg: DataFrame, path: str, kind: str, severity: str = "Violation") -> DataFrame:
    """Links of a path whose target is not of a class."""
    good = kg.where((F.col("p") == "type") & (F.col("o") == kind)).select(F.col("s").alias("value")).distinct()
    links = kg.where(F.col("p") == path).select("s", F.col("o").alias("value")).distinct()
    return links.join(good, "value", "left_anti").select("s", F.lit("class").alias("shape"), F.lit(path).alias("path"), "value", F.lit(severity).alias("severity"))


def graph_rules(kg: DataFrame) -> DataFrame:
    """Rules between nodes: none is its own parent (self_parent); a lineage has a source or a target field (lineage_fields); what
    groundedBy and transformsFrom point to exists (missing_target); what computedFrom points to is a table (not_a_table); no
    concept points to an event (concept_to_event)."""
    shaped = lambda df, shape, severity: df.select("s", F.lit(shape).alias("shape"), F.col("p").alias("path"), F.col("o").alias("value"), F.lit(severity).alias("severity"))
    of = lambda kind, name: kg.where((F.col("p") == "type") & (F.col("o") == kind)).select(F.col("s").alias(name)).distinct()
    links = kg.where("p <> 'type'").select("s", "p", "o").distinct()
    own = kg.where("p = 'broader' and s = o")
    fields = kg.where("p in ('sourceField', 'targetField')").select("s").distinct()
    bare = of("Lineage", "s").join(fields, "s", "left_anti").select("s", F.lit("sourceField").alias("p"), F.lit(None).cast("string").alias("o"))
    lost = links.where("p in ('groundedBy', 'transformsFrom')").join(kg.select(F.col("s").alias("o")).distinct(), "o", "left_anti")
    odd = links.where("p = 'computedFrom'").join(of("Table", "o"), "o", "left_anti")
    moving = links.join(of("Event", "o"), "o", "left_semi").join(of("Concept", "s"), "s", "left_semi")
    rules = ((own, "self_parent", "Violation"), (bare, "lineage_fields", "Violation"), (lost, "missing_target", "Warning"), (odd, "not_a_table", "Warning"), (moving, "concept_to_event", "Violation"))
    return reduce(DataFrame.unionByName, [shaped(*rule) for rule in rules])


def summary(violations: DataFrame) -> DataFrame:
    """Counts by severity and shape; conforms is false where there is a Violation."""
    return violations.groupBy("severity", "shape").agg(F.count("*").alias("n")).withColumn("conforms", F.col("severity") != "Violation")


def missing_targets(kg: DataFrame, predicates: list[str]) -> DataFrame:
    """Distinct references to subjects that do not exist."""
    refs = kg.where(F.col("p").isin(*predicates)).select("s", "p", "o").distinct()
    return refs.join(kg.select(F.col("s").alias("o")).distinct(), "o", "left_anti").select("s", "p", "o")


def missing_types(kg: DataFrame, predicates: list[str]) -> DataFrame:
    """References to subjects that exist but have no type."""
    refs = kg.where(F.col("p").isin(*predicates)).select("s", "p", "o").distinct().join(kg.select(F.col("s").alias("o")).distinct(), "o", "left_semi")
    return refs.join(kg.where("p = 'type'").select(F.col("s").alias("o")).distinct(), "o", "left_anti").select("s", "p", "o")


def quality(entities: DataFrame, by: list[str]) -> DataFrame:
    """Five dimensions from 0 to 1 for each group; entities have flags defined, valid, multi_source, conflicting, reviewed, approved."""
    share = lambda a, b: ratio(a, b, 4)
    n = F.count("*")
    return entities.groupBy(*by).agg(
        share(F.count_if("defined"), n).alias("completeness"), share(F.count_if("valid"), n).alias("accuracy"),
        F.coalesce(share(F.count_if(F.col("multi_source") & ~F.col("conflicting")), F.count_if("multi_source")), F.lit(1.0)).alias("consistency"),
        share(F.count_if("reviewed"), n).alias("timeliness"), share(F.count_if("approved"), n).alias("authority"))


def graded(dims: DataFrame) -> DataFrame:
    overall = rounded(sum((F.col(d) * w for d, w in WEIGHTS.items()), F.lit(0.0)), 4)
    grade = None
    for g, least in GRADES:
        grade = F.when(F.col("overall") >= least, g) if grade is None else grade.when(F.col("overall") >= least, g)
    return dims.withColumn("overall", overall).withColumn("grade", grade.otherwise("F"))
