"""Helpers that the corpus operators share: batch mapping and cutting lineage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.functions.binding import let  # noqa: F401  shared with the operators here
from strataloom.functions.storage import materialise  # noqa: F401

#: Texts that one call of a batch function gets at most, in characters; a longer text comes alone.
BATCH_CHARS = 1_000_000


def lowest_hashes(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The rows whose key has the lowest hashes, at most `rows`; df should hold few and small columns.

    Their number is counted first, and rows that can't be among the lowest are dropped where they are read,
    so that what the partitions send on is in proportion to `rows`, however many there are.
    """
    span = 1 << 40
    at = F.pmod(F.xxhash64(key), F.lit(span))
    n = df.count()
    near = df.where(at < int(span * 1.5 * rows / n)) if n > 2 * rows else df
    return near.orderBy(at, *(F.col(f"`{c}`") for c in df.columns)).limit(rows)


def in_fold(doc_id: Column, parts: int, which: int) -> Column:
    """Whether the id belongs to a fold: crc32 of its decimal text; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == which, F.lit(False))


def one_for_each(df: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """One row of df for each row of wanted (keys, at most a stated number of rows): the smallest by its other columns.

    It is reduced where the rows are, so a key that is repeated a million times sends one row on.
    """
    rest = [c for c in df.columns if c not in keys]
    found = df.join(F.broadcast(wanted), [c for c in keys if c in df.columns])
    return found.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("least")).select(*keys, "least.*")


def scan(rows: Column, start: Column, kind: str, step: Callable[[Column, Column], Column]) -> Column:
    """What step(state, row), a struct of the next `state` and an array `made` of the type `kind`, makes of all rows in order.

    An array that grows is copied each time, so it grows by chunks of about the root of the number of rows.
    """
    none, nested = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def grown(acc: Column, x: Column) -> Column:
        return let(step(acc["state"], x), lambda y: F.struct(y["state"].alias("state"), F.when(F.size(y["made"]) > 0, F.concat(acc["found"], y["made"])).otherwise(acc["found"]).alias("found")))

    def chunk(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(acc["state"].alias("state"), none.alias("found")), grown)
        return let(inner, lambda y: F.struct(y["state"].alias("state"), F.concat(acc["found"], F.array(y["found"])).alias("found")))

    def whole(r: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(r))).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.size(r) - 1, size), lambda i: F.slice(r, i + 1, size))
        return F.flatten(F.aggregate(parts, F.struct(start.alias("state"), nested.alias("found")), chunk)["found"])

    return let(rows, lambda r: F.when(F.size(r) > 0, whole(r)).otherwise(none))


def fresh(name: str, taken: list[str]) -> str:
    """A column name like `name` that is not taken."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def groups_of_texts(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold BATCH_CHARS characters, or one text."""
    return _ranges([len(t or "") for t in texts])


def _ranges(sizes: list[int]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, n in enumerate(sizes):
        if i > start and size + n > BATCH_CHARS:
            yield start, i
            start, size = i, 0
        size += n
    if len(sizes) > start:
        yield start, len(sizes)


def append_columns(df: DataFrame, text_col: str, fields: T.StructType, make: Callable[[], Callable[[list], list]]) -> DataFrame:
    """Add columns that are computed from whole texts, batch by batch.

    make() runs once in each task and returns a function from a list of texts (None for null) to one list
    or array for each of fields. Columns of df that bear the name of a new one are replaced. Spark bounds the
    bytes of a batch (spark.sql.execution.arrow.maxBytesPerBatch); it is read here in slices of BATCH_CHARS.
    """
    kept = [c for c in df.columns if c not in fields.names]
    schema = T.StructType([df.schema[c] for c in kept] + list(fields))
    source = df.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text_col}`").alias(fresh("text", kept)))
    types = [_arrow_type(f.dataType) for f in fields]
    names = kept + fields.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(len(kept))), 0).to_numpy()
            for a, b in _ranges(sizes.tolist()):
                part = batch.slice(a, b - a)
                made = apply(part.column(len(kept)).to_pylist())
                new = [x if isinstance(x, pa.Array) else pa.array(x, type=t) for x, t in zip(made, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *new], names=names)

    return source.mapInArrow(run, schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow_type(kind.elementType))
    return {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}[kind.simpleString()]


class Memo(dict):
    """Bounded cache of two generations: when the younger is full it becomes the older one.

    Keys longer than `longest` are not kept, which bounds its bytes.
    """

    def __init__(self, compute: Callable, size: int = 300_000, longest: int = 64):
        super().__init__()
        self.compute, self.size, self.longest, self.older = compute, size, longest, {}

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.compute(key)
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value
