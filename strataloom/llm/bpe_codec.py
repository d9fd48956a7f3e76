"""Byte-pair encoding by backtracking, and decoding by an offset table (operator 4).

A piece of text is encoded from left to right: take the longest token that starts here (all longest matches
come from one Aho-Corasick scan for tokens of two bytes or more; a byte alone always is one), and keep it if it is compatible with the token before it, that is if the
two are what merging their joint bytes would leave. If not, try the next shorter token; if there is none,
take back the token before. Every position is refuted at most once, so the time is linear in the piece.
Compatibility of pairs is kept in a table that fills as pairs occur. Words that are one piece are remembered,
so that a word with marks around it finds the word inside; a decoder only makes the table of offsets.

Decoding gathers the bytes of the ids from one byte string by a table of offsets.

Defined results: null and empty texts give an empty list of ids and decode to the empty text; strings of
special tokens inside a text become their ids and come back unchanged; byte sequences that are no UTF-8
decode to U+FFFD as the library does. An id that the vocabulary lacks raises. Rows are independent.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.llm.common import Memo, append_columns
from strataloom.llm.token_counts import SPACES, byte_letters

#: Fixed value: how the byte-level vocabulary cuts texts into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Half the words that are kept in memory, in each of two generations; pairs are twice as many.
REMEMBERED = 75_000


def _spec(path: str) -> tuple[dict, dict[str, int]]:
    """A vocabulary file, and the byte that each letter stands for."""
    with open(path, encoding="utf-8") as file:
        return json.load(file), {c: b for b, c in enumerate(byte_letters())}


class Encoder:
    """Encoder for one vocabulary file; ranks, not ids, are used inside. The ranks of the bytes are the bytes."""

    def __init__(self, path: str):
        spec, back = _spec(path)
        vocab = spec["model"]["vocab"]
        as_bytes = lambda s: bytes(back[c] for c in s)
        rank_of, self.parts, ids = {}, [], []
        for token, letter in ((bytes([b]), c) for b, c in enumerate(byte_letters())):
            rank_of[token] = len(ids)
            self.parts.append(None)
            ids.append(vocab[letter])
        self.joined: dict[tuple[int, int], int] = {}
        for merge in spec["model"]["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b = rank_of[as_bytes(left)], rank_of[as_bytes(right)]
            self.joined[a, b] = rank_of[as_bytes(left + right)] = len(ids)
            self.parts.append((a, b))
            ids.append(vocab[left + right])
        self.id_bytes = [i.to_bytes(4, "little") for i in ids]
        self.length = [0] * len(ids)
        self.shorter = [-1] * len(ids)
        self.automaton = ahocorasick.Automaton()
        for token, rank in rank_of.items():
            self.length[rank] = len(token)
            self.shorter[rank] = next((rank_of[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in rank_of), -1)
            if len(token) > 1:
                self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.compatible: dict[int, bool] = {}
        self.special = {x["content"]: np.array([x["id"]], dtype="<i4").tobytes() for x in spec["added_tokens"]}
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        inside = PIECES.replace(r"[^\s", "[^" + SPACES).replace(r"\S", f"[^{SPACES}]").replace(r"\s", f"[{SPACES}]")
        self.pieces = regex.compile(inside)
        self.crowded = regex.compile(f" [{SPACES}]|[{SPACES}] ")
        self.words = Memo(self.encode_word, 2 * REMEMBERED)
        self.marks = Memo(self.encode_piece, REMEMBERED // 4)

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens leaves just these two.

        Undo merges, latest first, on both sides of the seam: had the symbols at the seam a merge that ranks
        before the one undone last, it would have come first.
        """
        a, b, bound, good = left, right, len(self.parts), True
        joined, parts = self.joined, self.parts
        while True:
            if joined.get((a, b), bound) < bound:
                good = False
                break
            # at equal ranks the left pair merges first; if a > b, what merged a came later than what merged b
            halves = parts[a] if a > b else parts[b]
            if halves is None:
                break
            if a > b:
                bound, a = a, halves[1]
            else:
                bound, b = b + 1, halves[0]
        if len(self.compatible) > 4 * REMEMBERED:
            self.compatible.clear()
        self.compatible[left << 32 | right] = good
        return good

    def ranks(self, piece: bytes) -> list[int]:
        """The tokens of a piece, as ranks."""
        n, longest = len(piece), list(piece)
        length, shorter, known = self.length, self.shorter, self.compatible.get
        for end, rank in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - length[rank]] = rank  # ends ascend, so the last is the longest
        if length[longest[0]] == n:
            return [longest[0]]
        out: list[int] = []
        refuted = bytearray(n + 1)
        at, rank = 0, longest[0]
        while at < n:
            end = at + length[rank]
            good = not refuted[end]
            if good and out and (good := known(out[-1] << 32 | rank)) is None:
                good = self.fits(out[-1], rank)
            if good:
                out.append(rank)
                at = end
                if at < n:
                    rank = longest[at]
                continue
            rank = shorter[rank]
            if rank < 0:
                refuted[at] = 1
                rank = out.pop()  # it now ends at a refuted place, so a shorter one follows
                at -= length[rank]
        return out

    def encode_piece(self, piece: str) -> bytes:
        return b"".join([self.id_bytes[r] for r in self.ranks(piece.encode())])

    def join_pieces(self, pieces: list[str]) -> bytes:
        return b"".join([self.words[p[1:]] if p[0] == " " else self.marks[p] for p in pieces])

    def encode_pieces(self, text: str) -> bytes:
        return self.join_pieces(self.pieces.findall(text))

    def encode_word(self, word: str) -> bytes:
        """A word with the space before it; with marks around it, it is put together from its pieces."""
        pieces = self.pieces.findall(" " + word)
        return self.encode_piece(pieces[0]) if len(pieces) == 1 else self.join_pieces(pieces)

    def encode_plain(self, text: str) -> bytes:
        """Words between single spaces are encoded on their own, since no piece crosses such a space."""
        if not text:
            return b""
        if self.crowded.search(text) or text[0] == " " or text[-1] == " ":
            return self.encode_pieces(text)
        first, *rest = text.split(" ")
        return self.encode_pieces(first) + b"".join(map(self.words.__getitem__, rest))

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, dtype="<i4")
        if self.special_at is None or "<|" not in text:
            return np.frombuffer(self.encode_plain(text), dtype="<i4")
        parts = self.special_at.split(text)
        return np.frombuffer(b"".join(self.special.get(p) or self.encode_plain(p) for p in parts), dtype="<i4")


class Decoder:
    """Decoder for one vocabulary file: all tokens in one byte string, by offsets."""

    def __init__(self, path: str):
        spec, back = _spec(path)
        texts = {i: bytes(back[c] for c in token) for token, i in spec["model"]["vocab"].items()} | {x["id"]: x["content"].encode() for x in spec["added_tokens"]}
        size = max(texts) + 1
        self.known = np.zeros(size, dtype=bool)
        self.known[list(texts)] = True
        self.offsets = np.concatenate([[0], np.cumsum([len(texts.get(i, b"")) for i in range(size)])])
        self.blob = np.frombuffer(b"".join(texts.get(i, b"") for i in range(size)), dtype=np.uint8)

    def decode(self, ids: np.ndarray) -> str:
        if not len(ids):
            return ""
        if ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all():
            raise ValueError("an id is not in the vocabulary")
        starts = self.offsets[ids]
        lengths = self.offsets[ids + 1] - starts
        ends = np.cumsum(lengths)
        where = np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])
        return self.blob[where].tobytes().decode("utf-8", errors="replace")


class Codec:
    """Both directions of one vocabulary file; the tables of each are made when it is first used."""

    def __init__(self, path: str):
        self.path = path

    @cached_property
    def encode(self) -> Callable[[str | None], np.ndarray]:
        return Encoder(self.path).encode

    @cached_property
    def decode(self) -> Callable[[np.ndarray], str]:
        return Decoder(self.path).decode


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(df: DataFrame, vocabulary: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """df with the ids of each whole text as array<int>."""

    def make():
        coder = codec(vocabulary)

        def apply(texts):
            ids = [coder.encode(t) for t in texts]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("<i4")
            return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.empty(0, "<i4")))]

        return apply

    return append_columns(df, text_col, T.StructType([T.StructField(out_col, T.ArrayType(T.IntegerType()))]), make)


def decode(df: DataFrame, vocabulary: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df with the text of each list of ids; null lists decode to the empty text."""
    kept = [c for c in df.columns if c != out_col]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(out_col, T.StringType())])
    at = kept.index(ids_col)

    def run(batches):
        coder = codec(vocabulary)
        for batch in batches:
            column = batch.column(at)
            offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            valid = column.is_valid().to_pylist()
            texts = [coder.decode(values[a:b]) if v else "" for a, b, v in zip(offsets[:-1], offsets[1:], valid, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return df.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(run, schema)


def op4_bpe_codec(docs: DataFrame, vocabulary: str) -> DataFrame:
    ids = encode(docs.select("doc_id", "text"), vocabulary).select("doc_id", "ids")
    both = decode(ids, vocabulary)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
