"""SimHash near-duplicates found with BK-trees (operator 1).

Each whole text gets a 64-bit fingerprint from its word shingles. Fingerprints that differ in at most
`radius` bits are linked, and linked documents form components.

Search: equal fingerprints are first merged. By the pigeonhole principle two fingerprints within three bits
agree in one of four 16-bit blocks and, in what remains, in one of four 12-bit blocks; so each fingerprint
is dealt to 16 shards, named by blocks and their bits. A shard holds a BK-tree: a node's children are keyed
by their Hamming distance to it, and a search follows only the edges within the radius of its own distance.
A shard with many members is cut into trees of about TREE_SIZE members, and every member of the shard asks
each of its trees, so that no task holds more than one tree and no pair is lost. Shard trees are built
where the shard's rows are dealt, not broadcast: together they hold every fingerprint, which may not pass
through the driver. A shard returns one edge for each member to a representative, never all its pairs.

Defined results: null, empty and blank texts have fingerprint zero and are linked like any other. Repeated
rows and ids each give a row. A null doc_id never becomes a component_id unless its component has no other
(then component_id is null). Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.llm.common import append_columns, fresh, materialise
from strataloom.llm.graph import components

RADIUS = 3
#: Members of one BK-tree, about.
TREE_SIZE = 4096
#: Rows up to which a shard is searched node by node; beyond, many searches run together.
FEW = 24


def fingerprint(text: str | None, shingle: int) -> int:
    """The fingerprint of a text, as a signed integer."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
        starts = [0, *[e + 1 for e in ends[:-1]]]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :])]
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<i8")[0])


def add_fingerprints(df: DataFrame, text_col: str = "text", out_col: str = "fp", shingle: int = 3) -> DataFrame:
    def make():
        return lambda texts: [[fingerprint(t, shingle) for t in texts]]

    return append_columns(df, text_col, T.StructType([T.StructField(out_col, T.LongType())]), make)


class BKTree:
    """Metric tree over 64-bit integers; nodes are numbered as they come."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        if self.values:
            at = 0
            while (child := self.children[at].get(d := (self.values[at] ^ value).bit_count())) is not None:
                at = child
            self.children[at][d] = len(self.values)
        self.values.append(value)
        self.children.append({})

    def near(self, value: int, radius: int) -> list[int]:
        """Nodes within the radius."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            todo += [c for edge, c in self.children[at].items() if d - radius <= edge <= d + radius]
        return found

    def freeze(self) -> None:
        """Children as arrays, for near_many."""
        self.array = np.array(self.values, dtype=np.uint64)
        counts = np.array([len(c) for c in self.children])
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.edge = np.array([e for c in self.children for e in c], dtype=np.int16)
        self.child = np.array([n for c in self.children for n in c.values()], dtype=np.int64)

    def near_many(self, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(which of values, node) of all that lie within the radius; all searches go down level by level."""
        which, node = np.arange(len(values)), np.zeros(len(values), dtype=np.int64)
        out_which, out_node = [], []
        while len(which):
            d = np.bitwise_count(values[which] ^ self.array[node]).astype(np.int16)
            hit = d <= radius
            out_which.append(which[hit])
            out_node.append(node[hit])
            count = self.first[node + 1] - self.first[node]
            slot = np.repeat(self.first[node] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            go = np.abs(self.edge[slot] - np.repeat(d, count)) <= radius
            which, node = np.repeat(which, count)[go], self.child[slot[go]]
        return np.concatenate(out_which), np.concatenate(out_node)


class Groups:
    """Union-find whose roots are the smallest numbers."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            x, y = x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while (up := self.root[self.root] != self.root).any():
                self.root[up] = self.root[self.root[up]]


def _edges_of_few(values: list[int], members: int, radius: int, out: list) -> None:
    """Edges of a small shard; the first `members` of values make up its tree."""
    tree, head = BKTree(), list(range(len(values)))
    for i, v in enumerate(values):
        roots = set()
        for j in tree.near(v, radius):
            while head[j] != j:
                j = head[j]
            roots.add(j)
        if i < members:
            tree.add(v)
        elif not roots:
            continue
        if roots:
            low = min(roots)
            head[i] = low
            for j in roots:
                head[j] = low
            out += [(v, values[low])] + [(values[j], values[low]) for j in roots if j != low]


class _Shard:
    """One tree of a shard, as its rows stream by: members first, then the others that ask."""

    def __init__(self):
        self.members: list[np.ndarray] = []
        self.tree = None

    def add_members(self, values: np.ndarray) -> None:
        self.members.append(values)

    def build(self, radius: int) -> None:
        values = np.concatenate(self.members) if self.members else np.empty(0, np.uint64)
        self.tree, self.groups = BKTree(), Groups(len(values))
        for v in values.tolist():
            self.tree.add(v)
        self.tree.freeze()
        for i in range(0, len(values), 256):
            which, node = self.tree.near_many(values[i : i + 256], radius)
            self.groups.link(which + i, node)

    def ask(self, values: np.ndarray, radius: int) -> list[tuple[int, int]]:
        out = []
        if len(self.tree.values):
            for i in range(0, len(values), 256):
                block = values[i : i + 256]
                which, node = self.tree.near_many(block, radius)
                first = np.full(len(block), len(self.tree.values))
                np.minimum.at(first, which, node)
                self.groups.link(first[which], node)
                hit = np.flatnonzero(first < len(self.tree.values))
                out += zip(block[hit].tolist(), self.tree.array[first[hit]].tolist(), strict=True)
        return out

    def end(self) -> list[tuple[int, int]]:
        root = self.groups.root
        moved = np.flatnonzero(root != np.arange(len(root)))
        return list(zip(self.tree.array[moved].tolist(), self.tree.array[root[moved]].tolist(), strict=True))


def _search(radius: int):
    def run(batches):
        shard, name = None, None

        def close():
            if shard is None:
                return []
            if shard.tree is None:
                shard.build(radius)
            return shard.end()

        for batch in batches:
            key, part, asks, values = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            values = values.view(np.uint64)
            n, out = len(values), []
            cut = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
            starts, ends = [0, *cut.tolist()], [*cut.tolist(), n]
            for a, b in zip(starts, ends, strict=True):
                if a == b:
                    continue
                members = int((b - a) - asks[a:b].sum())
                if (key[a], part[a]) != name:
                    out += close()
                    shard, name = None, (key[a], part[a])
                    if b < n and b - a <= FEW:
                        _edges_of_few(values[a:b].tolist(), members, radius, out)
                        continue
                    shard = _Shard()
                if members:
                    shard.add_members(values[a : a + members])
                if a + members < b:
                    if shard.tree is None:
                        shard.build(radius)
                    out += shard.ask(values[a + members : b], radius)
            if out:
                yield _batch(out)
        if out := close():
            yield _batch(out)

    return run


def _batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(edges, dtype=np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def shard_keys(fp: Column) -> Column:
    """The 16 shards of a fingerprint: number of the blocks, 16 bits of one and 12 of the rest."""
    keys = []
    for i in range(4):
        block = F.shiftrightunsigned(fp, 16 * i).bitwiseAND(0xFFFF)
        low = fp.bitwiseAND((1 << 16 * i) - 1)
        high = F.shiftrightunsigned(fp, 16 * (i + 1)) if i < 3 else F.lit(0).cast("long")
        rest = F.shiftleft(high, 16 * i).bitwiseOR(low)
        for j in range(4):
            part = F.shiftrightunsigned(rest, 12 * j).bitwiseAND(0xFFF)
            keys.append(F.shiftleft(block, 12).bitwiseOR(part).bitwiseOR(F.lit((4 * i + j) << 28)))
    return F.array(*keys)


def near_edges(fps: DataFrame, radius: int = RADIUS, tree_size: int = TREE_SIZE) -> DataFrame:
    """Edges (a, b) between distinct values of fp (bigint) that link those within the radius (at most 3) into components."""
    if not 0 <= radius <= 3:
        raise ValueError("four blocks prove a radius of at most 3")
    spread = fps.select("fp", F.explode(shard_keys(F.col("fp"))).alias("key"))
    # written, so that Spark can split the other side of the join where a shard is very large
    busy = materialise(spread.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1), "busy")
    trees = F.ceil(F.col("n") / tree_size).cast("int")
    rows = spread.join(busy, "key").select("key", "fp", trees.alias("trees"))
    own = F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int")
    rows = rows.select("key", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("part"), own.alias("own"), "fp")
    rows = rows.select("key", "part", (F.col("part") != F.col("own")).cast("int").alias("asks"), "fp")
    dealt = rows.repartition("key", "part").sortWithinPartitions("key", "part", "asks", "fp")
    return dealt.mapInArrow(_search(radius), "a bigint, b bigint")


def _rooted(marked: DataFrame, lowest: Column, radius: int) -> DataFrame:
    """(fp, first, root) for each distinct fp of marked, first being the smallest `lowest` of its rows."""
    distinct = marked.groupBy("fp").agg(F.min(lowest).alias("first"))
    roots = components(near_edges(distinct.select("fp"), radius))
    # written, so that the joins below meet plain shuffles, of which Spark splits a component that is very large
    return materialise(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = 3) -> DataFrame:
    """(id, fp bigint, component_id) for each row."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = materialise(add_fingerprints(slim, shingle=shingle).select("id", "fp"), "fingerprints")
    rooted = _rooted(marked, F.col("id"), radius)
    ids = materialise(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "components")
    return marked.join(rooted.join(ids, "root").select("fp", "component_id"), "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, unnamed: bool = False) -> DataFrame:
    """documents without near-duplicates: of each component one row stays, that with the smallest doc_id.

    Only linked rows go: each row gets a key of its own, which decides between rows of one component that
    share an id, and rows that share an id without being linked all stay. Rows without doc_id come after all
    others of their component; `unnamed` says whether one stays where a component has no other.
    """
    key = fresh("key", docs.columns)
    # written, so that a row has the same key wherever it is read
    keyed = materialise(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    slim = keyed.select(F.col(key).alias("key"), F.col("doc_id").alias("id"), "text")
    marked = materialise(add_fingerprints(slim).select("key", "id", "fp"), "fingerprints")
    rooted = _rooted(marked, F.struct(F.col("id").isNull().alias("unnamed"), "id", "key"), RADIUS)
    first = rooted.groupBy("root").agg(F.min("first").alias("first"))
    keep = (first if unnamed else first.where("not first.unnamed")).select(F.col("first.key").alias(key))
    return keyed.join(keep, key, "left_semi").select(*docs.columns)


def op1_simhash(docs: DataFrame) -> DataFrame:
    linked = link_documents(docs)
    return linked.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
