"""Best matches across groups above a similarity: an exact join by pivots.

Angles between directions obey the triangle inequality. Known rows are dealt to the pivot that is nearest to them. A new
row within the angle a of a known one, whose pivot is p, is at most a further from p than the ball of p is wide, and at
most 2a further from p than from its own nearest pivot; it meets the balls of which both hold. In a ball only rows are
compared whose angles to the pivot differ by a at most. Nothing is lost at any threshold; how much is spared depends on how far
apart the vectors lie, and where they are random directions nothing is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.functions.numbers import rounded
from strataloom.functions.pairs import PACK, PART, meet
from strataloom.functions.storage import materialise
from strataloom.operators.index import _directions, _sample, flat, train_cells
from strataloom.operators.retrieval import QUERY_BLOCK, best, norm

#: Pivots at most, and the rows from which they are learned.
MOST_PIVOTS, TRAINING = 1024, 200_000
#: Similarities have six digits.
_LAST = 1e-6
#: New rows that share a range of a ball, and those that a task holds.
_RUN, BLOCK = 32, 8192
#: Groups whose best matches a task holds before it tells them.
_GROUPS = 256


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


def _strips(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in strips, so that what is made of a strip and all pivots stays small."""
    for i in range(0, batch.num_rows, QUERY_BLOCK):
        yield batch.slice(i, QUERY_BLOCK)


def _dealt(pivots: np.ndarray, kind: str, rows: DataFrame) -> DataFrame:
    """(id, grp, vector, ball, angle) of known rows: their nearest pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in _strips(b)):
            a = _angles(_directions(flat(batch.column(2))), pivots)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(a.argmin(axis=1)), pa.array(a.min(axis=1))], names=["id", "grp", "vector", "ball", "angle"])

    return rows.mapInArrow(run, f"id {kind}, grp string, vector array<double>, ball bigint, angle double")


def _compared(pivots: np.ndarray, wide: np.ndarray, reach: float, least: float):
    """For a block of new rows and each group but their own the best of all known rows that may lie within the reach; known rows of a ball come together."""
    columns = ["query", "target", "id", "sim", "compared"]

    def run(block: pa.RecordBatch, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = flat(block.column("vector"))
        mine, la = block.column("grp").to_numpy(zero_copy_only=False), np.sqrt((a * a).sum(axis=1))
        own = np.concatenate([_angles(a[i : i + QUERY_BLOCK] / la[i : i + QUERY_BLOCK, None], pivots).astype(np.float32) for i in range(0, len(a), QUERY_BLOCK)])
        nearest, pairs = own.min(axis=1), np.zeros(len(a), np.int64)
        kinds = [block.schema.field("id").type, pa.string(), block.schema.field("id").type, pa.float64(), pa.int64()]

        def told_so_far() -> Iterator[pa.RecordBatch]:
            q, g = np.nonzero(sims > -np.inf)
            for i in range(0, len(q), PACK):
                x, y = q[i : i + PACK], g[i : i + PACK]
                yield pa.RecordBatch.from_arrays([block.column("id").take(pa.array(x)), pa.array([groups[j] for j in y], kinds[1]), pa.array(names[x, y].tolist(), kinds[2]), pa.array(sims[x, y]), pa.array(np.zeros(len(x), np.int64))], names=columns)

        nothing = lambda n: (np.full((len(a), n), -np.inf), np.full((len(a), n), None, object))
        groups: list[str] = []
        sims, names = nothing(0)
        for batch in (x for y in batches for x in _strips(y)):
            b, at = flat(batch.column("vector")), batch.column("angle").to_numpy()
            grp, ids, ball = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("grp", "id", "ball"))
            lb = np.sqrt((b * b).sum(axis=1))
            new = [g for g in np.unique(grp) if g not in groups]
            if len(groups) + len(new) > _GROUPS and groups:
                yield from told_so_far()
                groups, new = [], list(np.unique(grp))
                sims, names = nothing(0)
            groups += new
            sims, names = (np.hstack(x) for x in zip((sims, names), nothing(len(new)), strict=True))
            # known rows of a ball and a group, in order of their ids, in which equal ones count by the first
            order = np.lexsort((np.unique(ids, return_inverse=True)[1], np.unique(grp, return_inverse=True)[1], ball))
            edges = np.flatnonzero(np.r_[True, ball[order][1:] != ball[order][:-1]])
            for s, e in zip(edges, [*edges[1:], len(order)], strict=True):
                p, known = ball[order[s]], order[s:e]
                theirs = at[known]
                # angles of pivots are held in single precision
                some = np.flatnonzero((own[:, p] <= wide[p] + reach + 1e-5) & (own[:, p] - nearest <= 2 * reach + 1e-5) & (own[:, p] >= theirs.min() - reach - 1e-5) & (own[:, p] <= theirs.max() + reach + 1e-5))
                some = some[np.argsort(own[some, p], kind="stable")]
                for i in range(0, len(some), _RUN):
                    part = some[i : i + _RUN]
                    ring = known[(theirs >= own[part[0], p] - reach - 1e-5) & (theirs <= own[part[-1], p] + reach + 1e-5)]
                    pairs[part] += len(ring)
                    if not len(ring):
                        continue
                    told = np.floor(a[part] @ b[ring].T / (la[part][:, None] * lb[ring][None, :]) * 1e6 + 0.5) / 1e6
                    starts = np.flatnonzero(np.r_[True, grp[ring][1:] != grp[ring][:-1]])
                    for x, y in zip(starts, [*starts[1:], len(ring)], strict=True):
                        g, top = groups.index(grp[ring[x]]), told[:, x:y].argmax(axis=1)
                        top_sim, top_id = told[np.arange(len(part)), x + top], ids[ring[x + top]]
                        far = (top_sim < least) | (top_sim < sims[part, g]) | (mine[part] == groups[g])
                        for j in np.flatnonzero(~far):
                            if top_sim[j] > sims[part[j], g] or top_id[j] < names[part[j], g]:
                                sims[part[j], g], names[part[j], g] = top_sim[j], top_id[j]
        yield from told_so_far()
        some, none = np.flatnonzero(pairs), pa.nulls
        yield pa.RecordBatch.from_arrays([block.column("id").take(pa.array(some)), *(none(len(some), t) for t in kinds[1:4]), pa.array(pairs[some])], names=columns)

    return run


def candidates(new: DataFrame, known: DataFrame, least: float, pivots: int | None = None) -> DataFrame:
    """(query, target, id, sim, compared): of all known rows that a task sees the best match of a new row in each other group, from `least` on; rows without target count comparisons.

    new and known have id, grp and vector. Vectors without length, and those of another dimension than most, take no part.
    Known rows are written by ball and stream past blocks of new rows, so neither is copied for the other's sake.
    """
    kinds = {df.schema["id"].dataType.simpleString() for df in (new, known)}
    if len(kinds) > 1:
        raise ValueError("ids must be of one type")
    kind = kinds.pop()
    slim = lambda df: df.select("id", F.col("grp").cast("string").alias("grp"), F.col("vector").cast("array<double>").alias("vector")).where(norm("vector") > 0)
    x, y = slim(new), slim(known).where("grp IS NOT NULL")
    shape = f"query {kind}, target string, id {kind}, sim double, compared bigint"
    common = y.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if not common:
        return new.sparkSession.createDataFrame([], shape)
    x, y = (df.where(F.size("vector") == common["d"]) for df in (x, y))
    reach = float(np.arccos(np.clip(least - _LAST, -1, 1))) + 1e-9
    centres = train_cells(_sample(y.select("id", "vector"), TRAINING), min(MOST_PIVOTS, pivots or max(1, int(common["count"] ** 0.5))), 3)
    dealt = materialise(_dealt(centres, kind, y), "dealt")
    wide = np.full(len(centres), -np.inf)
    for r in dealt.groupBy("ball").agg(F.max("angle").alias("width")).collect():  # one for each pivot at most
        wide[r["ball"]] = r["width"]
    cores = new.sparkSession.sparkContext.defaultParallelism
    ordered = dealt.repartition(max(2 * cores, -(-common["count"] // PART)), "ball").sortWithinPartitions("ball", "grp", "id")
    return meet(x, ordered, min(BLOCK, max(QUERY_BLOCK, -(-x.count() // (2 * cores)))), _compared(centres, wide, reach, least), shape, spread=True)


def match(new: DataFrame, known: DataFrame, exact: float, close: float, by_target: bool = False, pivots: int | None = None) -> DataFrame:
    """(id, other, sim, relation, confidence): the best match of each new row in other groups, or with target in each of them; exactMatch or closeMatch."""
    found = candidates(new, known, close, pivots).where(F.col("target").isNotNull())
    top = best(found, ["query", *(["target"] if by_target else [])], [F.desc("sim"), F.asc("id")], 1)
    relation = F.when(F.col("sim") >= exact, "exactMatch").otherwise("closeMatch").alias("relation")
    return top.select(F.col("query").alias("id"), *(["target"] if by_target else []), F.col("id").alias("other"), "sim", relation, rounded(100 * F.col("sim"), 1).alias("confidence"))


def compared(new: DataFrame, known: DataFrame, least: float, pivots: int | None = None) -> int:
    """How many pairs are compared for a threshold."""
    return candidates(new, known, least, pivots).agg(F.sum("compared")).first()[0] or 0
