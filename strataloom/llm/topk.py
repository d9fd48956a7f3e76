"""Exact top-k inner products by norm-bucketed retrieval (operator 5).

Vectors are grouped by length into buckets whose lengths differ by a quarter of a power of two, and buckets
are cut into blocks of about BLOCK vectors. Each query first takes its k-th best product with SEEDS vectors of
the longest buckets (a bounded set, by the order of a hash) as a lower bound. It is then sent only to buckets whose longest vector could
reach that bound. In a block the bound, divided by the query's length and the block's longest, is a local
cosine threshold. If it is low, vectors are pruned by length; if it is high, by the intervals in which the
query's largest coordinates confine a unit vector of such a cosine. What is left is verified by its exact
product. Queries, too, are cut into blocks, so a task sees one block of each, whatever their number.

Defined results: vectors that are null, empty, or hold a null or non-finite component take no part, nor do
rows with a null id. Rows that share an id are candidates each on its own, but none for a query of that id;
queries that share an id give the k best of all of them together. Only vectors of equal
dimension are compared. Products beyond 64 bits are cut to the nearest long. Fewer candidates than k give
all. Ties go to the smaller id. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import lowest_hashes, materialise

BLOCK = 2048
QUERY_BLOCK = 1024
SEEDS = 2048
#: Local cosine thresholds from here on prune by coordinate, lower ones by length.
COORDINATE_FROM = 0.3
FOCUS = 3
_LONG = (-(2**63), 2**63 - 1)


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact integer products of rows (n, d) with a query (d), as int64."""
    if len(rows) and float(np.abs(rows).max()) * float(np.abs(query).max()) * rows.shape[1] >= 2.0**53:
        exact = rows.astype(object) @ query.astype(object)
        return np.array([min(max(x, _LONG[0]), _LONG[1]) for x in exact], dtype=np.int64)
    return (rows.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)


class Block:
    """Vectors of one bucket, longest first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        order = np.lexsort((ids, -lengths))
        self.ids, self.vectors, self.lengths = ids[order], vectors[order], lengths[order]
        self.unit = np.ascontiguousarray((self.vectors / np.maximum(self.lengths, 1e-300)[:, None]).T)

    def candidates(self, query: np.ndarray, length: float, bound: float) -> np.ndarray | slice:
        """Positions that may reach the bound; none that does is left out."""
        if bound <= 0 or length == 0 or self.lengths[0] == 0:
            return slice(None)
        reach = bound / length * (1 - 1e-9)
        n = int(np.searchsorted(-self.lengths, -reach, side="right"))
        cosine = reach / self.lengths[0]
        if n == 0 or cosine < COORDINATE_FROM:
            return slice(0, n)
        cosine = min(1.0, cosine)
        unit = query / length
        good = np.ones(n, dtype=bool)
        for f in np.argsort(-np.abs(unit))[:FOCUS]:
            middle, wide = unit[f] * cosine, np.sqrt(max(0.0, (1 - unit[f] ** 2) * (1 - cosine**2))) + 1e-9
            low = -1.0 if unit[f] <= -cosine else middle - wide
            high = 1.0 if unit[f] >= cosine else middle + wide
            good &= (self.unit[f, :n] >= low) & (self.unit[f, :n] <= high)
        return np.flatnonzero(good)

    def best(self, query_id: int, query: np.ndarray, bound: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best that are not below the bound."""
        where = self.candidates(query.astype(np.float64), float(np.sqrt((query.astype(np.float64) ** 2).sum())), bound)
        ids, scores = self.ids[where], products(self.vectors[where], query)
        good = (ids != query_id) & (scores >= bound)
        ids, scores = ids[good], scores[good]
        if len(ids) > 4 * k:
            edge = np.partition(scores, -k)[-k]
            ids, scores = ids[scores >= edge], scores[scores >= edge]
        order = np.lexsort((ids, -scores.astype(object) if len(scores) and scores.min() == _LONG[0] else -scores))[:k]
        return ids[order], scores[order]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.int64)


def _bounded(seeds: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """Adds each query's lower bound; seeds: by dimension, ids and vectors."""

    def run(frames):
        blocks = {d: Block(*x) for d, x in seeds.items()}
        for frame in frames:
            bounds = []
            for d, i, v in zip(frame["dim"], frame["id"], frame["vector"], strict=True):
                found = blocks[d].best(i, np.array(v, dtype=np.int64), -np.inf, k)[1] if d in blocks else []
                bounds.append(float(found[-1]) if len(found) == k else -np.inf)
            yield frame.assign(bound=bounds)

    return run


def _matched(k: int):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            block = Block(rows["id"].to_numpy(), _matrix(rows["vector"]))
            for i, v, bound in zip(queries["id"], _matrix(queries["vector"]), queries["bound"], strict=True):
                ids, scores = block.best(i, v, bound, k)
                out += [(i, a, s) for a, s in zip(ids.tolist(), scores.tolist(), strict=True)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def top_k(vectors: DataFrame, is_query, k: int = 5, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest products of each query with all rows but its own.

    vectors: bigint id and array<bigint> vector; is_query: a condition on a column named id.
    """
    spark = vectors.sparkSession
    plain = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).where(F.col("id").isNotNull() & (F.size("vector") > 0))
    squared = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    single = plain.withColumns({"length": F.sqrt(squared), "key": F.monotonically_increasing_id()})
    bucket = F.when(F.col("length") > 0, F.floor(4 * F.log2("length")).cast("int")).otherwise(-1)
    # written, so that a row has the same key wherever it is read
    single = materialise(single.select("key", "id", "vector", "length", F.size("vector").alias("dim"), bucket.alias("bucket")), "vectors")

    # a few numbers for each bucket, whose count the range of lengths bounds
    query = is_query(F.col("id"))
    facts = single.groupBy("dim", "bucket").agg(F.count("*").alias("n"), F.max("length").alias("longest"), F.count_if(query).alias("queries")).collect()
    asked: dict[int, int] = {}
    for r in facts:
        asked[r["dim"]] = asked.get(r["dim"], 0) + r["queries"]
    plan = [(r["dim"], r["bucket"], r["longest"], -(-r["n"] // BLOCK), -(-asked[r["dim"]] // QUERY_BLOCK)) for r in facts if asked[r["dim"]]]
    plan = F.broadcast(spark.createDataFrame(plan, "dim int, bucket int, longest double, blocks bigint, query_blocks bigint"))
    seeds: dict[int, list] = {}
    # the longest buckets that hold enough vectors, and of these a bounded number
    held, low = 0, 0
    for low, n in sorted(((r["bucket"], r["n"]) for r in facts), reverse=True):
        held += n
        if held >= SEEDS:
            break
    for r in lowest_hashes(single.where(F.col("bucket") >= low).select("key", "id", "dim", "vector"), "key", SEEDS).collect():
        seeds.setdefault(r["dim"], []).append((r["id"], r["vector"]))
    seeds = {d: (np.array([i for i, _ in x]), np.array([v for _, v in x], dtype=np.int64)) for d, x in seeds.items()}

    spread = F.xxhash64("key")  # rows of one id are dealt like any others
    queries = single.where(query).select("key", "id", "vector", "length", "dim")
    queries = queries.repartition(F.col("key")).mapInPandas(_bounded(seeds, k), "key bigint, id bigint, vector array<bigint>, length double, dim int, bound double")
    queries = queries.join(plan, "dim").where(F.col("length") * F.col("longest") >= F.col("bound") * (1 - F.signum("bound") * 1e-9))
    keys = ["dim", "bucket", "block", "query_block"]
    queries = queries.select("id", "vector", "bound", "dim", "bucket", F.pmod(spread, "query_blocks").alias("query_block"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))
    rows = single.select("key", "id", "vector", "dim", "bucket").join(plan, ["dim", "bucket"])
    rows = rows.select("id", "vector", "dim", "bucket", F.pmod(spread, "blocks").alias("block"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("query_blocks") - 1)).alias("query_block"))
    found = queries.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(_matched(k), "query_id bigint, vec_id bigint, score bigint")
    return _ranked(found, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(embeddings: DataFrame, factor: int = 256) -> DataFrame:
    """(id, vector) of the usable rows: each component becomes floor(factor * x)."""
    sound = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * factor))
    return embeddings.where(F.col("embedding").isNotNull() & sound).select(F.col("vec_id").cast("bigint").alias("id"), whole.alias("vector"))


def op5_exact_topk(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    return top_k(quantised(embeddings), lambda i: i % every == 0, k)
