"""Phrase collocation mining by Rabin-Karp fingerprints (operator 12).

Texts are cut into pieces at punctuation and these into words. In blocks of one language, prefix polynomials over bytes
give each word a fingerprint, and prefix polynomials over words give one to every run of words. That equal fingerprints in a
block are equal words is verified there. A block sends one row for each distinct run: the fingerprint, SECOND bits of one of
another kind, which is no polynomial, the count, and the part of the table in which it stands. A shuffle adds the counts by
both and keeps the least part; what shares the first fingerprint but not the second is told apart. At last the texts are read
once more, and frequent runs are cut out of them in the part that was kept for each. So phrases of different blocks are
taken for one only if both fingerprints, 64 and SECOND bits, agree.

What is sent decides over the disk that is taken. A part is the same in all rows of a task and so is nearly free once the
shuffle is compressed, while the row and place of an occurrence would take half as much again as the fingerprints; texts are not shuffled at all.

Runs are counted by length, the shortest first: a run is only sent if both its parts that are one word shorter may be
frequent. Tasks know these from a bitmap of 2**FILTER_BITS bits, which is all that is broadcast (4 MB for each length,
whatever the input). It holds a bit for each frequent fingerprint, so it may let others pass, but never holds back a frequent run;
with very many frequent runs it fills up and saves less. Which runs are cut out, and in which part, tasks know from two such bitmaps of
all lengths, by fingerprints and by fingerprints with parts; what passes both by chance finds no count and goes.

A frequent phrase is scored at each cut by 1000 a n / (l r), in decimals of 38 digits and rounded down; the lowest
counts. Phrases that lie inside a longer frequent one that is as frequent are dropped: it is enough to look at
those that are one word longer. The best of each language are ranked in two steps, so no language is sorted in one task.

Defined results: a null language is `und`, null and empty texts have no words. Repeated rows count each. An empty
table, or one without frequent phrases, gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import materialise

LEAST = 100
LONGEST = 5
BEST = 2000
#: Bytes of text of one language that are counted together.
BLOCK = 4 << 20
#: Rows that are sent, and texts that are unpacked, at once.
SENT, UNPACKED = 1 << 16, 64
#: Bytes over which one polynomial runs.
_SPAN = 1 << 18
FILTER_BITS = 25
#: Bits of the second fingerprint that are sent, and a factor that tells parts apart in a bitmap; it stays below 2**31.
SECOND, _PART = 48, 0x5BD1E995
#: Parts in which a language's phrases are ranked first.
PARTS = 64
_MARKS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(0x0A if b in _MARKS else 0x20 if b == 0x09 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


@lru_cache(4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2**64."""
    make = lambda x: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)]), dtype=np.uint64)
    return make(base), make(pow(base, -1, 1 << 64))


def _size(n: int) -> int:
    """A power of two of at least n, so that few tables of powers are made."""
    return 1 << max(10, int(n - 1).bit_length())


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = x ^ np.uint64(salt)
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xBF58476D1CE4E5B9)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(32))


def marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bit of each key is set."""
    at = keys & np.uint64(8 * len(bits) - 1)
    return ((bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


class Block:
    """Segments (row, first byte, bytes) of one language: the words in them, and fingerprints of runs of words."""

    def __init__(self, lang: str, segments: list[tuple[int, int, bytes]]):
        self.lang, self.salt = lang, int.from_bytes(hashlib.sha256(lang.encode()).digest()[:8], "little")
        self.key = int(np.uint64(self.salt).view(np.int64))
        raw = b"\n".join(x[2] for x in segments) + b"\n"
        self.raw = np.frombuffer(raw + b"\0" * 8, np.uint8)
        bytes_ = self.raw[: len(raw)]
        ends_piece = bytes_ == 0x0A
        blank = ends_piece | (bytes_ == 0x20)
        before = np.empty_like(blank)
        before[0], before[1:] = True, blank[:-1]
        self.first = np.flatnonzero(~blank & before)
        self.last = np.flatnonzero(blank & ~before)
        # words of one piece have the same number of line ends before them
        self.piece = np.searchsorted(np.flatnonzero(ends_piece), self.first).astype(np.int32)
        starts = np.cumsum([0, *(len(x[2]) + 1 for x in segments)])[:-1]
        owner = np.searchsorted(starts, self.first, side="right") - 1
        self.owner = owner.astype(np.int32)
        self.row = np.array([x[0] for x in segments], np.int64)
        self.word, self.other = self._fingerprints(bytes_), None
        up, _ = _powers(_WORD_BASE, _size(len(self.word) + 1))
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.word * up[: len(self.word)], dtype=np.uint64)])

    def _fingerprints(self, bytes_: np.ndarray) -> np.ndarray:
        """Fingerprints of words from prefix polynomials over spans of the bytes that end with a word."""
        out, i, at = np.empty(len(self.first), np.uint64), 0, 0
        while i < len(self.first):
            at = int(self.first[i])
            j = max(i + 1, int(np.searchsorted(self.last, at + _SPAN, side="right")))
            end = int(self.last[j - 1])
            up, down = _powers(_BYTE_BASE, _size(max(end - at, _SPAN)))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((bytes_[at:end].astype(np.uint64) + np.uint64(1)) * up[: end - at], dtype=np.uint64)])
            a, b = self.first[i:j] - at, self.last[i:j] - at
            out[i:j] = (total[b] - total[a]) * down[a]
            i = j
        return _mixed(out, 0x2545F4914F6CDD1D)

    def _same(self, one: np.ndarray, other: np.ndarray) -> bool:
        """Whether words are the same bytes, pair by pair; eight bytes are compared at once, and SENT pairs."""
        eight, cover = self._eights()
        for i in range(0, len(one), SENT):
            x, y = one[i : i + SENT], other[i : i + SENT]
            a, b = self.first[x], self.first[y]
            left = self.last[x] - a
            if (left != self.last[y] - b).any():
                return False
            while len(a):
                if (((eight[a] ^ eight[b]) & cover[np.minimum(left, 8)]) != 0).any():
                    return False
                more = left > 8
                a, b, left = a[more] + 8, b[more] + 8, left[more] - 8
        return True

    def second(self, n: int, at: np.ndarray) -> np.ndarray:
        """Fingerprints of another kind of the runs of n words at some places: words are mixed in eight bytes at a time, and runs word by word."""
        if self.other is None:
            eight, cover = self._eights()
            self.other = np.empty(len(self.first), np.uint64)
            for i in range(0, len(self.first), SENT):
                where, out = self.first[i : i + SENT], self.other[i : i + SENT]
                left = self.last[i : i + SENT] - where
                words = np.arange(len(where))
                out[:] = _mixed(left.astype(np.uint64), 0xA0761D6478BD642F)
                while len(words):
                    out[words] = _mixed(out[words] ^ (eight[where] & cover[np.minimum(left, 8)]), 0xE7037ED1A0B428DB)
                    more = left > 8
                    words, where, left = words[more], where[more] + 8, left[more] - 8
        out = self.other[at] ^ np.uint64(self.salt)
        for k in range(1, n):
            out = _mixed(out * np.uint64(_BYTE_BASE) + self.other[at + k], 0x8EBC6AF09C88C6E3)
        return out

    def _eights(self) -> tuple[np.ndarray, np.ndarray]:
        """The eight bytes from each place on as a number, and what to keep of them where fewer count."""
        eight = np.lib.stride_tricks.as_strided(self.raw[:8].view("<u8"), (len(self.raw) - 7,), (1,))
        return eight, np.array([(1 << 8 * k) - 1 for k in range(8)] + [0xFFFFFFFFFFFFFFFF], np.uint64)

    def keys(self, n: int) -> np.ndarray:
        """Fingerprints of the runs of n words that start at each word, also of those that leave its piece."""
        m = max(0, len(self.word) - n + 1)
        _, down = _powers(_WORD_BASE, _size(len(self.word) + 1))
        return _mixed((self.prefix[n : n + m] - self.prefix[:m]) * down[:m], self.salt + n & 0xFFFFFFFFFFFFFFFF)

    def runs(self, n: int, frequent: np.ndarray | None) -> tuple[np.ndarray, ...]:
        """(key, count, place, part) of the distinct runs of n words that may be frequent, by the first word of an occurrence."""
        keys = self.keys(n)
        inside = self.piece[: len(keys)] == self.piece[n - 1 :]
        if frequent is not None:
            known = marked(frequent, self.keys(n - 1))
            inside &= known[:-1] & known[1:]
        at = np.flatnonzero(inside)
        found, index, group, count = np.unique(keys[at], return_index=True, return_inverse=True, return_counts=True)
        first = at[index]
        like = first[group]
        del group
        if not all(self._same(at + k, like + k) for k in range(n)):
            # fingerprints collide, so runs are told apart by their words
            known: dict[tuple[bytes, ...], int] = {}
            words = [tuple(self.raw[self.first[i + k] : self.last[i + k]].tobytes() for k in range(n)) for i in at.tolist()]
            _, index, count = np.unique([known.setdefault(w, len(known)) for w in words], return_index=True, return_counts=True)
            first = at[index]
            found = keys[first]
        return found.view(np.int64), count, first, self.parts(first)

    def parts(self, at: np.ndarray) -> np.ndarray:
        """The parts of the table in which some words stand: the partitions that gave their rows a number."""
        return self.row[self.owner[at]] >> 33

    def chosen(self, n: int, frequent: np.ndarray, named: np.ndarray) -> tuple[np.ndarray, ...]:
        """(key, second, at) of the distinct runs of n words that bitmaps name in their part: the first byte in the block with the length."""
        keys = self.keys(n)
        at = np.flatnonzero((self.piece[: len(keys)] == self.piece[n - 1 :]) & marked(frequent, keys))
        at = at[marked(named, keys[at] ^ (self.parts(at) * _PART).view(np.uint64))]
        key, second = keys[at].view(np.int64), self.seconds(n, at)
        order = np.lexsort((second, key))
        key, second, at = key[order], second[order], at[order]
        new = np.append(True, (key[1:] != key[:-1]) | (second[1:] != second[:-1]))[: len(at)]
        key, second, at = key[new], second[new], at[new]
        return key, second, self.first[at] << 32 | (self.last[at + n - 1] - self.first[at])

    def seconds(self, n: int, at: np.ndarray) -> np.ndarray:
        """The bits of second fingerprints that are sent."""
        return (self.second(n, at) >> np.uint64(64 - SECOND)).view(np.int64)


def segments(row: int, data: bytes, block: int) -> Iterator[tuple[int, int, bytes]]:
    """A text in segments of about `block` bytes that end where a piece ends."""
    at = 0
    while len(data) - at > block:
        end = data.rfind(b"\n", at, at + block)
        if end < 0:
            end = data.find(b"\n", at + block)
        if end < 0:
            break
        yield row, at, data[at:end]
        at = end + 1
    yield row, at, data[at:]


def blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[Block]:
    """Blocks of one language each from batches of (row, lang, text), a few texts unpacked at a time."""
    waiting: dict[str, list] = {}
    sizes: dict[str, int] = {}

    def full(lang: str) -> Block:
        sizes.pop(lang)
        return Block(lang, waiting.pop(lang))

    for batch in (whole.slice(i, UNPACKED) for whole in batches for i in range(0, whole.num_rows, UNPACKED)):
        for row, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for part in segments(row, text.encode().translate(_TABLE), block):
                waiting.setdefault(lang, []).append(part)
                sizes[lang] = sizes.get(lang, 0) + len(part[2]) + 1
                if sizes[lang] >= block:
                    yield full(lang)
            if sum(sizes.values()) >= 2 * block:
                for name in list(waiting):
                    yield full(name)
    for name in list(waiting):
        yield full(name)


def _sent(names: list[str], arrays: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(arrays[0]), SENT):
        yield pa.RecordBatch.from_arrays([pa.array(x[i : i + SENT]) for x in arrays], names=names)


def grams(texts: DataFrame, n: int, frequent: np.ndarray | None = None, block: int = BLOCK) -> DataFrame:
    """(key, second, count, part) of (row, lang, text): for each block its distinct runs of n words by both fingerprints.

    With the words of a block goes their number, under its language and in no part (-1).
    """
    names = ["key", "second", "count", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in blocks(batches, block):
            if n == 1:
                yield from _sent(names, [np.array([x], np.int64) for x in (found.key, 0, len(found.word), -1)])
            keys, count, place, part = found.runs(n, frequent)
            second = found.seconds(n, place)
            yield from _sent(names, [keys, second, count, part])

    return texts.select("row", "lang", "text").mapInArrow(run, "key bigint, second bigint, count bigint, part bigint")


def bitmap(keys: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit for the lowest `bits` bits of each key; made on the cluster in parts of 4 kB, whose number is bounded."""
    at = F.col("key").bitwiseAND(F.lit((1 << bits) - 1)) + 1
    parts = keys.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("held")).collect()
    out = np.zeros(1 << max(0, bits - 3), np.uint8)
    for r in parts:
        held = np.frombuffer(bytes(r.held), np.uint8)
        start = (r.part - 1) * 4096
        out[start : start + 4096] = held[: max(0, len(out) - start)]
    return out


def phrase_counts(texts: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int = FILTER_BITS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, f) of all runs of 1 to `longest` words that occur `least` times or more, and (lang, n) with all words.

    `texts` has row (unique, by monotonically_increasing_id), lang and text, without nulls, and is read once for each length and once
    more: written, it should be.
    """
    frequent, counts = None, None
    known, named = (np.zeros(1 << max(0, bits - 3), np.uint8) for _ in range(2))
    for n in range(1, longest + 1):
        counted = grams(texts, n, frequent, block).groupBy("key", "second").agg(F.sum("count").alias("count"), F.min("part").alias("part"))
        often = materialise(counted.where((F.col("count") >= least) | (F.col("part") < 0)), f"often{n}")
        found = often.select(F.when(F.col("part") < 0, 0).otherwise(n).alias("words"), "key", "second", F.col("count").alias("f"))
        counts = found if counts is None else counts.unionByName(found)
        keys = often.where("part >= 0")
        frequent = bitmap(keys, bits)
        known |= frequent
        named |= bitmap(keys.select(F.col("key").bitwiseXOR(F.col("part") * F.lit(_PART)).alias("key")), bits)
        if not frequent.any():
            break
    same = ["words", "key", "second"]
    found = names(texts, n, known, named, block).drop("count").distinct()
    exact = materialise(counts.join(found, same).select("lang", "words", "phrase", "f"), "phrases")
    return exact.where("words > 0"), exact.where("words = 0").select("lang", F.col("f").alias("n"))


def names(texts: DataFrame, longest: int, frequent: np.ndarray, named: np.ndarray, block: int = BLOCK) -> DataFrame:
    """(lang, words, phrase, count, key, second) of the runs of (row, lang, text) that bitmaps name in their part, and of languages (no words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in blocks(batches, block):
            yield from _followed(_pointed(found, longest, frequent, named))

    return texts.select("row", "lang", "text").mapInArrow(run, "lang string, words int, phrase string, count bigint, key bigint, second bigint")


def _pointed(found: Block, longest: int, frequent: np.ndarray, named: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of (lang, text, pointers): the text of a block with SENT pointers at most, one to each run that bitmaps name; the first to none."""
    lang, text = pa.array([found.lang]), pa.array([found.raw[:-8].tobytes().decode()])
    nothing = tuple(np.array([x], np.int64) for x in (found.key, 0, 0))
    for n in range(longest + 1):
        key, second, at = found.chosen(n, frequent, named) if n else nothing
        for i in range(0, len(key), SENT):
            columns = [pa.array(x[i : i + SENT]) for x in (np.full(len(key), n, np.int32), at, np.ones(len(key), np.int64), key, second)]
            pointers = pa.StructArray.from_arrays(columns, names=["words", "at", "count", "key", "second"])
            yield pa.RecordBatch.from_arrays([lang, text, pa.ListArray.from_arrays([0, len(pointers)], pointers)], names=["lang", "text", "pointers"])


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The phrases that pointers name, in rows of (lang, text, pointers); what else pointers bear tells equal phrases apart."""
    for batch in batches:
        counts: dict[tuple, int] = {}
        more = [f.name for f in batch.column(2).type.value_type if f.name not in ("words", "at", "count")]
        for i in range(batch.num_rows):
            data = batch.column(1)[i].as_py().encode().translate(_TABLE)
            lang, pointers = batch.column(0)[i].as_py(), batch.column(2)[i].values
            for words, at, count, *rest in zip(*(pointers.field(c).to_pylist() for c in ("words", "at", "count", *more)), strict=True):
                start = at >> 32
                key = lang, words, b" ".join(filter(None, data[start : start + (at & 0xFFFFFFFF)].split(b" "))), *rest
                counts[key] = counts.get(key, 0) + count
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.int32()), pa.array([k[2].decode() for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())]
            + [pa.array([k[3 + j] for k in counts], pa.int64()) for j in range(len(more))],
            names=["lang", "words", "phrase", "count", *more],
        )


def _part(words: Column, start: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def collocations(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of phrases of two words or more, at their lowest cut, without those that a longer one explains."""
    each = phrases.where("words > 1").select("lang", "phrase", F.col("f").alias("a"), "words", F.split("phrase", " ").alias("w"))
    cuts = each.select("lang", "phrase", "a", "words", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.col("w"), 1, F.col("k")).alias("left"), _part(F.col("w"), F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    known = phrases.select("lang", "phrase", "f")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"]).join(totals, "lang")
    exact = lambda c: F.col(c).cast("decimal(18,0)")
    scored = cuts.withColumn("over", F.lit(1000).cast("decimal(4,0)") * (exact("a") * exact("n"))).withColumn("under", exact("l") * exact("r"))
    scored = scored.withColumn("score", F.expr("over div under"))
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    # the longest run inside a phrase is without its first or its last word
    shorter = each.where("words > 2").select("lang", "a", F.explode(F.array(_part(F.col("w"), 1, F.col("words") - 1), _part(F.col("w"), 2, F.col("words") - 1))).alias("phrase"))
    longer = shorter.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = lowest.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
    return kept.select("lang", "phrase", "a", F.col("x.l").alias("l"), F.col("x.r").alias("r"), "n", F.col("x.score").alias("score"))


def top(found: DataFrame, best: int = BEST, parts: int = PARTS) -> DataFrame:
    """The first `best` of each language, ranked from 1: first in parts of a language, then among the best of these."""
    order = "ORDER BY score DESC, a DESC, phrase"
    some = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    some = some.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang, part {order})")).where(F.col("rank") <= best)
    ranked = some.withColumn("rank", F.expr(f"CAST(row_number() OVER (PARTITION BY lang {order}) AS BIGINT)"))
    return ranked.where(F.col("rank") <= best).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, best: int = BEST, bits: int = FILTER_BITS, block: int = BLOCK) -> DataFrame:
    """The best collocations of each language of (lang, text)."""
    full = docs.where(F.col("text") != "").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    texts = materialise(full.select(F.monotonically_increasing_id().alias("row"), "lang", "text"), "texts", "zstd")
    phrases, totals = phrase_counts(texts, least, longest, bits, block)
    return top(collocations(phrases, totals), best)


def op12_phrases(docs: DataFrame) -> DataFrame:
    return mine(docs)
