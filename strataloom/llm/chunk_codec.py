"""Byte-level BPE by overlapping chunks (operator 11).

The vocabulary is a file of ranks: a token's bytes in base 64 and its rank, which is its id. A text is cut into
pre-tokens, the matches of a pattern, and each is encoded on its own: the adjacent pair whose joint bytes rank
lowest is merged, the leftmost first, until no joint bytes have a rank.

Long texts are cut into chunks that overlap, and the chunks are dealt over the cluster. Each is pre-tokenised from
its own start, which may lie inside a pre-token. Where a boundary of one chunk is also a boundary of the next,
both agree from there on, as a match depends on nothing before it; so a stream over a text's chunks in order finds
the place in each overlap where the next chunk takes over. If an overlap holds none, the text goes on from the last
true boundary through the next chunk; after that it is tried again when what is carried has doubled. The stretches
of whole pre-tokens between these places are dealt anew and encoded, each with LOOKAHEAD characters of what follows.
Only long texts are shuffled.

The pattern must not look behind a match, and must decide within LOOKAHEAD characters after it; it may leave
characters unmatched, which get no id. Decoding joins the bytes of the ids.

Defined results: null and empty texts have no ids and decode to no bytes. There are no special tokens; their strings
are ordinary text. An id that the vocabulary lacks raises. Rows are independent: repeated rows and ids give repeated
results; other columns pass unchanged, but for those named like an output.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.llm.common import Memo, append_columns, fresh, materialise
from strataloom.llm.token_counts import SPACES

#: Characters of a chunk, and how far it reaches into the next one.
CHUNK = 1 << 16
OVERLAP = 512
#: Characters after a match that may decide where it ends.
LOOKAHEAD = 16
#: Pre-tokens that are kept in memory, in each of two generations.
REMEMBERED = 100_000
#: Bytes of a pre-token from which a heap finds the next merge.
HEAP_FROM = 128
_NONE = 1 << 31


def spaces_of_library(pattern: str) -> str:
    r"""The pattern with \s and \S spelled out as the library reads them."""
    return pattern.replace(r"[^\s", "[^" + SPACES).replace(r"\S", f"[^{SPACES}]").replace(r"\s", f"[{SPACES}]")


class RankCodec:
    """Encoder and decoder of one file of ranks."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, file)))}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pattern = regex.compile(spaces_of_library(pattern))
        self.known = Memo(lambda piece: np.array(self.merged(piece.encode()), "<u4").tobytes(), REMEMBERED)

    def merged(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        if len(piece) >= HEAP_FROM:
            return self.merged_by_heap(piece)
        ranks = self.ranks
        ends = list(range(len(piece) + 1))
        joint = [ranks.get(piece[i : i + 2], _NONE) for i in range(len(piece) - 1)]
        while joint and (least := min(joint)) != _NONE:
            i = joint.index(least)
            del ends[i + 1], joint[i]
            if i:
                joint[i - 1] = ranks.get(piece[ends[i - 1] : ends[i + 1]], _NONE)
            if i < len(joint):
                joint[i] = ranks.get(piece[ends[i] : ends[i + 2]], _NONE)
        return [ranks[piece[a:b]] for a, b in zip(ends, ends[1:])]

    def merged_by_heap(self, piece: bytes) -> list[int]:
        """The same in n log n: symbols are a linked list by their start, pairs lie in a heap by (rank, start)."""
        n, ranks = len(piece), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        gone = bytearray(n + 1)
        while heap:
            _, start, end = heapq.heappop(heap)
            middle = after[start]
            if gone[start] or middle == n or after[middle] != end:
                continue
            gone[middle] = 1
            after[start] = end
            before[end] = start
            if end < n and (r := ranks.get(piece[start : after[end]])) is not None:
                heapq.heappush(heap, (r, start, after[end]))
            if (left := before[start]) >= 0 and (r := ranks.get(piece[left:end])) is not None:
                heapq.heappush(heap, (r, left, end))
        out, at = [], 0
        while at < n:
            out.append(ranks[piece[at : after[at]]])
            at = after[at]
        return out

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, "<u4")
        return np.frombuffer(b"".join(map(self.known.__getitem__, self.pattern.findall(text))), "<u4")

    def encode_stretch(self, text: str, size: int) -> np.ndarray:
        """The ids of the pre-tokens that start within the first `size` characters."""
        pieces = []
        for m in self.pattern.finditer(text):
            if m.start() >= size:
                break
            pieces.append(m[0])
        return np.frombuffer(b"".join(map(self.known.__getitem__, pieces)), "<u4")

    def starts(self, text: str, last: bool) -> list[int]:
        """Where pre-tokens of a text start, and where the last ends, as far as what follows the text can't change it."""
        trusted = len(text) if last else len(text) - LOOKAHEAD
        out = [0]
        for m in self.pattern.finditer(text):
            if m.start() > trusted:
                break
            if m.start() > out[-1]:
                out.append(m.start())
            if m.end() > trusted:
                break
            if m.end() > out[-1]:
                out.append(m.end())
        if last and out[-1] < len(text):
            out.append(len(text))
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(2)
def codec(path: str, pattern: str) -> RankCodec:
    return RankCodec(path, pattern)


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype("<i4")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found).astype("<i4") if found else np.empty(0, "<i4")))


def cut(texts: DataFrame, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(row, part, text, last) of (row, text): chunks that reach `overlap` characters into the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for part, start in enumerate(range(0, max(1, len(text) - overlap), chunk)):
                    last = start + chunk + overlap >= len(text)
                    yield pa.RecordBatch.from_pylist([{"row": row, "part": part, "text": text[start : start + chunk + overlap], "last": last}])

    return texts.select("row", "text").mapInArrow(run, "row bigint, part bigint, text string, last boolean")


def pre_tokenise(chunks: DataFrame, vocabulary: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Chunks with the boundaries that lie in the overlaps: `head` with the chunk before, `tail` with the one after, from the chunk's start."""
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([*chunks.schema.fields, T.StructField("head", ints), T.StructField("tail", ints)])
    names, text_at, last_at = chunks.columns, chunks.columns.index("text"), chunks.columns.index("last")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(vocabulary, pattern)
        for batch in batches:
            heads, tails = [], []
            for text, last in zip(batch.column(text_at).to_pylist(), batch.column(last_at).to_pylist(), strict=True):
                found = coder.starts(text, last)
                heads.append([x for x in found if x <= overlap])
                tails.append([x for x in found if x >= chunk])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))], names=[*names, "head", "tail"])

    return chunks.mapInArrow(run, schema)


def _stitched(vocabulary: str, pattern: str, chunk: int):
    """A function for mapInArrow from chunks sorted by (row, part) to stretches (row, part, text, size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(vocabulary, pattern)
        # the text from `carry` on is not given out yet; it starts at a true boundary `start` in the coordinates of the whole text
        row, carry, start, tail, waiting = None, "", 0, [], 0
        for batch in batches:
            out = []
            for r, part, text, last, head, ends in zip(*(batch.column(c).to_pylist() for c in ("row", "part", "text", "last", "head", "tail")), strict=True):
                base = part * chunk
                if part == 0:
                    row, carry, start, tail, waiting = r, text, 0, [x for x in ends if x < len(text)], 0
                    if last:
                        out.append((r, part, text, len(text)))
                    continue
                # boundaries of the chunks before, and of this one, both in the coordinates of the whole text
                common = sorted({x for x in tail if x >= base} & {base + x for x in head})
                whole = carry + text[start + len(carry) - base :]
                if common:
                    # what was given out before may reach beyond the place where both agree
                    size = max(0, common[0] - start)
                    if size:
                        out.append((r, part - 1, whole[: size + LOOKAHEAD], size))
                    carry, start, waiting = whole[size:], start + size, 0
                    tail = [base + x for x in ends]
                elif last or len(whole) < waiting:
                    carry, tail = whole, []
                else:
                    # go on from the last true boundary through this chunk
                    found = coder.starts(whole, False)
                    tail = [start + x for x in found if start + x >= base + chunk]
                    if (size := found[-1]) > 0:
                        out.append((r, part - 1, whole[: size + LOOKAHEAD], size))
                    carry, start, waiting = whole[size:], start + size, 0 if size else 2 * len(whole)
                if last:
                    out.append((r, part, carry, len(carry)))
            if out:
                yield pa.RecordBatch.from_pydict({k: [x[i] for x in out] for i, k in enumerate(("row", "part", "text", "size"))})

    return run


def encode_long(texts: DataFrame, vocabulary: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(row, ids) of (row, text): chunks are pre-tokenised, stitched and encoded, each step dealt over the cluster."""
    chunks = pre_tokenise(cut(texts, chunk, overlap).repartition("row", "part"), vocabulary, pattern, chunk, overlap)
    ordered = chunks.repartition("row").sortWithinPartitions("row", "part")
    stretches = ordered.mapInArrow(_stitched(vocabulary, pattern, chunk), "row bigint, part bigint, text string, size bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(vocabulary, pattern)
        for batch in batches:
            found = [coder.encode_stretch(t, n) for t, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(found)], names=["row", "part", "ids"])

    encoded = stretches.repartition("row", "part").mapInArrow(run, "row bigint, part bigint, ids array<int>")
    inner = F.transform(F.array_sort(F.collect_list(F.struct("part", "ids"))), lambda x: x["ids"])
    return encoded.groupBy("row").agg(F.flatten(inner).alias("ids"))


def encode(df: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", out_col: str = "ids", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """df with the ids of each whole text as array<int>."""
    if overlap <= LOOKAHEAD or chunk <= overlap:
        raise ValueError("a chunk must be longer than its overlap, and that than what a match looks ahead")
    df = df.drop(out_col)
    fields = T.StructType([T.StructField(out_col, T.ArrayType(T.IntegerType()))])
    long = F.coalesce(F.length(f"`{text_col}`") > chunk + overlap, F.lit(False))

    def make():
        coder = codec(vocabulary, pattern)
        return lambda texts: [_lists([coder.encode(t) for t in texts])]

    short = append_columns(df.where(~long), text_col, fields, make)
    row = fresh("row", df.columns)
    # written, so that numbers stay with their rows whatever is computed again
    kept = materialise(df.where(long).withColumn(row, F.monotonically_increasing_id()), "long_texts")
    made = encode_long(kept.select(F.col(row).alias("row"), F.col(f"`{text_col}`").alias("text")), vocabulary, pattern, chunk, overlap)
    joined = kept.join(made.select(F.col("row").alias(row), F.col("ids").alias(out_col)), row)
    return short.unionByName(joined.select(*short.columns))


def decode(df: DataFrame, vocabulary: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df with the bytes that each list of ids stands for; null lists give none."""
    kept = [c for c in df.columns if c != out_col]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(out_col, T.BinaryType())])
    at = kept.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(vocabulary, pattern)
        for batch in batches:
            texts = [coder.decode(ids or []) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=schema.names)

    return df.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(run, schema)


def _digests(vocabulary: str, pattern: str):
    """A function for mapInArrow from (doc_id, ids) to the columns of the query."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(vocabulary, pattern)
        for batch in batches:
            column = batch.column(1)
            offsets, values = column.offsets.to_numpy(), column.values.to_numpy().astype("<u4")
            parts = [values[a:b] for a, b in zip(offsets, offsets[1:])]
            sha = lambda data: hashlib.sha256(data).hexdigest()
            made = [[len(x) for x in parts], [sha(x.tobytes()) for x in parts], [sha(coder.decode(x.tolist())) for x in parts]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, made)], names=names)

    return run


def op11_chunk_codec(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    ids = encode(docs.select("doc_id", "text"), vocabulary, pattern).select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids")
    return ids.mapInArrow(_digests(vocabulary, pattern), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
