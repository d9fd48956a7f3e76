"""Every row of one table with every row of another, where neither may be copied for the other's sake.

One side is dealt to blocks that tasks hold in memory; the other is written once, in packs, and streams past each block. A
task keeps what it needs of a pair, so neither pairs nor copies of rows are written, whatever the numbers of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.functions.storage import materialise

#: Rows of a pack, and of a partition that is packed, on the mean.
PACK, PART = 2048, 100_000


def _row(parts: list[pa.StructArray]) -> pa.RecordBatch:
    rows = pa.concat_arrays(parts)
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)], names=["rows"])


def _structs(batch: pa.RecordBatch) -> pa.StructArray:
    return pa.StructArray.from_arrays(batch.columns, names=batch.schema.names)


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, PACK):
            yield _row([_structs(batch.slice(i, PACK))])


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [_structs(b) for b in batches if b.num_rows]
    if parts:
        yield _row(parts)


def meet(held: DataFrame, streamed: DataFrame, size: int, run: Callable[[pa.RecordBatch, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, spread: bool = False) -> DataFrame:
    """What run makes of each block of about `size` rows of held and the batches of streamed, which it sees all, in one task or a few.

    The tasks of a block are no more than keep all cores busy, so what they give for a block, if bounded, stays in
    proportion to held. With `spread` the rows of streamed are packed where they are, and computed only once.
    """
    cores = held.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-held.count() // size))
    packed = lambda df: T.StructType([T.StructField("rows", T.ArrayType(df.schema))])
    dealt = streamed if spread else streamed.repartition(max(2 * cores, -(-streamed.count() // PART)))
    packs = materialise(dealt.mapInArrow(_packs, packed(streamed)), "packs")
    # of a partition only the first row brings the block to Python
    left = packs.coalesce(max(1, -(-2 * cores // blocks))).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    right = held.repartition(blocks).mapInArrow(_block, packed(held)).withColumnRenamed("rows", "block")
    met = left.hint("shuffle_replicate_nl").crossJoin(right).select("at", "block", F.posexplode("rows").alias("place", "row"))
    told = met.select(F.when((F.col("at") == 0) & (F.col("place") == 0), F.col("block")).alias("block"), "row")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is not None:
            block = pa.RecordBatch.from_struct_array(first.column(0).slice(0, 1).flatten())
            yield from run(block, (pa.RecordBatch.from_struct_array(b.column(1)) for b in chain([first], batches) if b.num_rows))

    return told.mapInArrow(go, schema)
