"""Queries over a table of triples: s, p, o (strings), iri (whether o is a node), g (graph)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions.storage import materialise

#: Predicates that relate concepts.
RELATIONS = ("broader", "narrower", "related", "derivedFrom", "dependsOn", "joinableWith", "computedFrom", "transformsFrom", "mapsTo")


def entities(kg: DataFrame, kind: str, properties: list[str]) -> DataFrame:
    """One row for each (g, s) of a class with its smallest value of each property, null if absent; one shuffle."""
    value = lambda p: F.min(F.when(F.col("p") == p, F.col("o"))).alias(p)
    used = kg.where(F.col("p").isin("type", *properties))
    is_kind = F.max((F.col("p") == "type") & (F.col("o") == kind)).alias("__is")
    return used.groupBy("g", "s").agg(is_kind, *map(value, properties)).where("__is").drop("__is")


def labels(kg: DataFrame) -> DataFrame:
    return kg.where("p = 'label'").groupBy("s").agg(F.min("o").alias("label"))


def gathered(kg: DataFrame, predicate: str, separator: str = "|||") -> DataFrame:
    """All values of a predicate in order, joined."""
    return kg.where(F.col("p") == predicate).groupBy("s").agg(F.array_join(F.array_sort(F.collect_set("o")), separator).alias("values"))


def search(kg: DataFrame, kind: str, words: str, properties: list[str], only_status: tuple[str, ...] | None = None) -> DataFrame:
    """Entities whose label or other given property contains the words; optionally only of a status, or without one."""
    found = entities(kg, kind, [*properties, "status"])
    hit = F.lit(False)
    for p in properties:
        hit = hit | F.contains(F.lower(F.coalesce(p, F.lit(""))), F.lit(words.lower()))
    if only_status:
        hit = hit & (F.col("status").isNull() | F.col("status").isin(*only_status))
    return found.where(hit)


def counts(kg: DataFrame) -> DataFrame:
    return kg.groupBy("g").agg(F.count("*").alias("triples"), F.count_distinct("s").alias("subjects"), F.count_if(F.col("p") == "type").alias("typed"))


def neighbours(kg: DataFrame, nodes: DataFrame, most: int = 200) -> DataFrame:
    """(node, direction, p, other, label) of the edges that touch the nodes, at most `most` of each."""
    edges = kg.where("iri and p <> 'type'")
    out = edges.join(nodes.select(F.col("node").alias("s")), "s").select(F.col("s").alias("node"), F.lit("out").alias("direction"), "p", F.col("o").alias("other"))
    back = edges.join(nodes.select(F.col("node").alias("o")), "o").select(F.col("o").alias("node"), F.lit("in").alias("direction"), "p", F.col("s").alias("other"))
    both = out.unionByName(back).join(labels(kg).withColumnRenamed("s", "other"), "other", "left")
    w = Window.partitionBy("node").orderBy("direction", "p", "other")
    return both.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")


def both_ways(kg: DataFrame, predicates: tuple[str, ...]) -> DataFrame:
    """Distinct pairs (a, b) joined by a predicate in either direction."""
    e = kg.where(F.col("p").isin(*predicates))
    return e.select(F.col("s").alias("a"), F.col("o").alias("b")).unionByName(e.select(F.col("o").alias("a"), F.col("s").alias("b"))).where("a <> b").distinct()


def relations_of(kg: DataFrame, nodes: DataFrame, predicates: tuple[str, ...] = RELATIONS) -> DataFrame:
    """Edges with an end among the nodes, with labels, or the last part of the name where there is none."""
    e = kg.where(F.col("p").isin(*predicates)).select("s", "p", "o")
    n = nodes.select("node")
    touched = e.join(n, F.col("s") == F.col("node"), "left_semi").unionByName(e.join(n, F.col("o") == F.col("node"), "left_semi")).distinct()
    name = labels(kg)
    local = lambda c: F.element_at(F.split(c, "/"), -1)
    told = touched.join(name.select("s", F.col("label").alias("sl")), "s", "left").join(name.select(F.col("s").alias("o"), F.col("label").alias("ol")), "o", "left")
    return told.select("s", "p", "o", F.coalesce("sl", local("s")).alias("s_label"), F.coalesce("ol", local("o")).alias("o_label"))


def layer_counts(kg: DataFrame) -> DataFrame:
    """Distinct subjects of each kind and counts of relations and attributes, in one aggregate."""
    subjects = lambda kind: F.count_distinct(F.when((F.col("p") == "type") & (F.col("o") == kind), F.col("s")))
    relation = F.col("p").isin(*RELATIONS) & F.col("iri")
    attribute = ~F.col("iri") & ~F.col("p").isin("type", "status")
    return kg.groupBy("g").agg(subjects("Term").alias("vocabulary"), subjects("Metric").alias("metric"), subjects("Concept").alias("concept"), subjects("Table").alias("physical"), F.count_if(relation).alias("relation"), F.count_if(attribute).alias("attribute"))


def page(items: DataFrame, words: str | None, order: list[Column], offset: int, limit: int) -> DataFrame:
    """Rows that contain the words in any column, in order, with the total and whether more follow."""
    if words:
        items = items.where(F.contains(F.lower(F.concat_ws(" ", *(F.col(c).cast("string") for c in items.columns))), F.lit(words.lower())))
    total = items.agg(F.count("*").alias("total"))
    rows = items.orderBy(*order).offset(offset).limit(limit)
    return rows.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)


def parents(kg: DataFrame) -> DataFrame:
    """(child, parent) by broader and reversed narrower, the smallest parent of each child."""
    up = kg.where("p = 'broader'").select(F.col("s").alias("child"), F.col("o").alias("parent")).unionByName(kg.where("p = 'narrower'").select(F.col("o").alias("child"), F.col("s").alias("parent")))
    return up.where("child <> parent").groupBy("child").agg(F.min("parent").alias("parent"))


def hierarchy(kg: DataFrame) -> DataFrame:
    """(node, root, path, depth) of all nodes; nodes on cycles or below them have no root and do not appear.

    Each node knows the names between it and an ancestor; a round joins it with what that ancestor knows, which
    doubles the way, so rounds grow with the logarithm of the depth.
    """
    up = materialise(parents(kg), "parents")
    children = up.select(F.col("child").alias("at"))
    roots = up.select(F.col("parent").alias("at")).distinct().join(children, "at", "left_anti")
    start = up.select(F.col("child").alias("node"), F.col("parent").alias("at"), F.array("child").alias("names"))
    done = materialise(start.join(roots, "at", "left_semi").select("node", "at", "names"), "done")
    left = materialise(start.join(roots, "at", "left_anti").select("node", "at", "names"), "open")
    steps, nodes = 1, up.count()
    # whoever has not met a root after as many steps as there are nodes is on a cycle, or below one
    while steps <= nodes and not left.isEmpty():
        known = done.withColumn("ends", F.lit(True)).unionByName(left.withColumn("ends", F.lit(False)))
        ahead = known.select(F.col("node").alias("at"), F.col("at").alias("next"), F.col("names").alias("before"), "ends")
        moved = materialise(left.join(ahead, "at").select("node", F.col("next").alias("at"), F.concat("before", "names").alias("names"), "ends"), "moved")
        done = materialise(done.unionByName(moved.where("ends").drop("ends")), "done")
        left = moved.where("not ends").drop("ends")
        steps *= 2
    top = roots.select(F.col("at").alias("node"), F.col("at").alias("root"), F.col("at").alias("path"), F.lit(0).alias("depth"))
    return top.unionByName(done.select("node", F.col("at").alias("root"), F.concat_ws(" > ", F.array("at"), "names").alias("path"), F.size("names").alias("depth")))


def provenance(kg: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Subject, chunk, document and a preview, by the chunk number in the grounding's name."""
    g = kg.where("p = 'groundedBy'").select("s", F.regexp_extract("o", r"chunk/(\d+)$", 1).try_cast("bigint").alias("chunk_id"))
    return g.join(chunks, "chunk_id").join(docs, "doc_id", "left").select("s", "chunk_id", "doc_id", "source", F.substring("content", 1, 240).alias("preview"))


def federated(kg: DataFrame, bases: DataFrame) -> DataFrame:
    """Entities of all bases of each domain, each node under its first base."""
    typed = kg.where("p = 'type'").join(bases, "g").groupBy("domain", "s", F.col("o").alias("kind")).agg(F.min("g").alias("g"))
    return typed


def overview(nodes: DataFrame) -> DataFrame:
    """Counts by domain and kind with totals."""
    return nodes.rollup("domain", "kind").agg(F.count("*").alias("n"))
