"""Conflict-constrained best-fit packing (operator 8).

Documents become pieces of at most `capacity` units; a piece goes to the fullest bin it fits in that holds
neither its source nor its cluster of duplicates. Bins are ordered by what they have left and carry bitmaps
of sources and clusters. From the tightest bin that is large enough the search goes on to its successors
until one is compatible; if there is none a bin is opened. Larger pieces go first.

A document longer than the capacity fills bins of its own (shard -1, bins numbered in no order) with all
but its last piece. Rows are numbered as they are written,
and dealt to shards of about SHARD rows by a hash of the number, so that neither a source nor a cluster nor many
equal rows make a shard large, and each shard is packed in one task. No row is dropped and none is cut without its other pieces.

Defined results: a null length counts as 0 and a piece of length 0 is packed like any other; a null source
or cluster conflicts with nothing; repeated rows are separate pieces; rows of an empty table give none.
Ties in length go by id, then by source and cluster; ties among bins to the bin opened first.
"""

from __future__ import annotations

from bisect import insort
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import materialise
from strataloom.llm.token_counts import count_tokens

CAPACITY = 8192
SHARD = 2048


class Bins:
    """Open bins by what they have left: a binary tree over 0..capacity, of which only the nodes that hold a bin exist.

    Each node knows the sources and clusters that all bins below it hold: where one is the piece's own, none of these
    bins is compatible, and the search for the successor passes them in one step, however many they are.
    """

    def __init__(self, capacity: int):
        self.top = 1 << capacity.bit_length()
        self.held: dict[int, tuple[int, int]] = {}
        self.bins: dict[int, list[tuple[int, int, int]]] = {}

    def add(self, free: int, number: int, source: int, cluster: int) -> None:
        insort(self.bins.setdefault(free, []), (number, source, cluster))
        node = self.top + free
        while node:
            s, c = self.held.get(node, (source, cluster))
            self.held[node] = s & source, c & cluster
            node >>= 1

    def take(self, free: int, at: int) -> tuple[int, int, int]:
        found = self.bins[free].pop(at)
        node, left = self.top + free, self.bins[free]
        if left:
            self.held[node] = reduce(and_, (x[1] for x in left)), reduce(and_, (x[2] for x in left))
        else:
            del self.held[node], self.bins[free]
        while node := node >> 1:
            below = [self.held[x] for x in (2 * node, 2 * node + 1) if x in self.held]
            if not below:
                del self.held[node]
            else:
                self.held[node] = below[0] if len(below) == 1 else (below[0][0] & below[1][0], below[0][1] & below[1][1])
        return found

    def tightest(self, length: int, source: int, cluster: int) -> tuple[int, int] | None:
        """(left, place among the bins with as much left) of the fullest compatible bin with `length` left."""
        ahead = [(1, 0, self.top)]
        while ahead:
            node, low, size = ahead.pop()
            held = self.held.get(node)
            if held is None or low + size <= length or held[0] & source or held[1] & cluster:
                continue
            if size == 1:
                for i, (_, s, c) in enumerate(self.bins[low]):
                    if not (s & source or c & cluster):
                        return low, i
                continue
            half = size // 2
            ahead += [(2 * node + 1, low + half, half), (2 * node, low, half)]
        return None


def pack_shard(pieces: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) for pieces (length, source bit, cluster bit), larger first; a bit of 0 conflicts with nothing."""
    bins, opened, out = Bins(capacity), 0, []
    for length, source, cluster in pieces:
        found = bins.tightest(length, source, cluster)
        if found:
            free = found[0]
            number, s, c = bins.take(*found)
        else:
            free, number, s, c = capacity, opened, 0, 0
            opened += 1
        out.append((number, capacity - free))
        bins.add(free - length, number, s | source, c | cluster)
    return out


def _bits(values: pd.Series) -> list[int]:
    """A bit for each distinct value, 0 for null."""
    codes, _ = pd.factorize(values)
    return [1 << int(c) if c >= 0 else 0 for c in codes]


def _packer(capacity: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["piece_length", "id", "piece", "source", "cluster"], ascending=[False, True, True, True, True], kind="stable")
        placed = pack_shard(list(zip(frame["piece_length"].tolist(), _bits(frame["source"]), _bits(frame["cluster"]), strict=True)), capacity)
        return frame.assign(bin=[b for b, _ in placed], bin_offset=[o for _, o in placed])[["shard", "bin", "id", "piece", "piece_start", "piece_length", "bin_offset"]]

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", length_col: str = "length", source_col: str = "source", cluster_col: str = "cluster", shard: int = SHARD) -> DataFrame:
    """(id, piece, piece_start, piece_length, shard, bin, bin_offset): where each piece of each document lies."""
    slim = materialise(
        docs.select(
            F.col(id_col).cast("bigint").alias("id"),
            F.greatest(F.coalesce(F.col(length_col).cast("bigint"), F.lit(0)), F.lit(0)).alias("length"),
            F.col(source_col).cast("string").alias("source"),
            F.col(cluster_col).cast("bigint").alias("cluster"),
            F.monotonically_increasing_id().alias("number"),
        ),
        "lengths",
    )
    last = F.greatest(F.ceil(F.col("length") / capacity).cast("bigint") - 1, F.lit(0))
    pieces = slim.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
    start = F.col("piece") * capacity
    pieces = pieces.select("number", "id", "piece", "source", "cluster", start.alias("piece_start"), F.least(F.lit(capacity), F.col("length") - start).alias("piece_length"))
    full = pieces.where(F.col("piece_length") == capacity)
    rest = pieces.where(F.col("piece_length") < capacity)
    shards = max(1, -(-slim.count() // shard))
    dealt = rest.withColumn("shard", F.pmod(F.xxhash64("number", "piece"), F.lit(shards)).cast("bigint"))
    packed = dealt.groupBy("shard").applyInPandas(_packer(capacity), "shard bigint, bin bigint, id bigint, piece bigint, piece_start bigint, piece_length bigint, bin_offset bigint")
    alone = full.select(F.lit(-1).cast("bigint").alias("shard"), F.monotonically_increasing_id().alias("bin"), "id", "piece", "piece_start", "piece_length", F.lit(0).cast("bigint").alias("bin_offset"))
    both = packed.unionByName(alone)
    return both.select(F.col("id").alias(id_col), "piece", "piece_start", "piece_length", "shard", "bin", "bin_offset")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Pack whole documents by their tokens in a vocabulary (operator 9), or by their UTF-8 bytes; equal texts are a cluster."""
    slim = docs.select("doc_id", "text", "source")
    sized = count_tokens(slim, vocabulary, out_col="length") if vocabulary else slim.withColumn("length", F.octet_length("text"))
    return pack(sized.select("doc_id", "length", "source", F.xxhash64("text").alias("cluster")), capacity)


def op8_best_fit_packing(docs: DataFrame) -> DataFrame:
    return pack_documents(docs)
