"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each end of an edge (a, b of bigint), root being the smallest node of its component.

    Every round writes its edges to the shared folder, so lineage stays short and a lost executor costs one
    round. Rounds grow with the logarithm of the longest chain. Self loops and repeated edges are harmless;
    edges with a null end are ignored.
    """
    now = materialise(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that Spark can split the other side of the join where a node has very many edges
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = materialise(both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        small = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "small")
        moved = large.join(small, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialise(moved.unionByName(small.withColumnRenamed("m", "v")).distinct(), "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    """Count and checksum, by which two rounds are compared."""
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)")).alias("s")).first()
    return row["n"], row["x"], row["s"]
