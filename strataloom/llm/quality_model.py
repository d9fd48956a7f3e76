"""Quality classifier on supervised subword embeddings (operator 2).

Words, pairs of words, and n-grams of characters within words, whose borders count as a character, are hashed to buckets. Each
bucket has a learned vector; a document is the average of the vectors of its features, and a softmax layer
turns it into class probabilities. Vectors and layer are learned together by stochastic gradient descent.
As the layer is linear, scoring folds both into one number per bucket.

The model is fitted on a bounded sample of labelled rows (SAMPLE_ROWS, by the order of a hash of the id), whose
whole texts are turned into features on the cluster and streamed to the driver epoch by epoch, a partition at a time;
every text is scored whole. Labels, language, source and id are no features.

Defined results: a null or empty text has no feature and gets the score of the layer's bias alone. Of rows that
share an id the smallest text is learned from. Without any label all scores are 0.5; with one class they are that class's. Repeated rows give repeated results.
A null id is in the training fold's complement of nothing: held_out is false for it, and it is not learned from.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.llm.common import append_columns, groups_of_texts, in_fold, lowest_hashes, materialise, one_for_each

SAMPLE_ROWS = 3000
BUCKET_BITS = 17
NGRAMS = (3, 4, 5)
DIMENSIONS = 8
EPOCHS = 4
RATE = 0.2
#: Bytes that separate words.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ODD = 0x9E3779B97F4A7C15


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number and of its inverse, modulo 2**64."""
    base = 0xD6E8FEB86659FD93
    inverse = pow(base, -1, 1 << 64)
    make = lambda x: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)]), dtype=np.uint64)
    return make(base), make(inverse)


class Batch:
    """Hashed features of several texts at once."""

    def __init__(self, texts: list[str | None]):
        encoded = [(t or "").encode() + b"\n" for t in texts]
        self.raw = np.frombuffer(b"".join(encoded), dtype=np.uint8)
        self.starts = np.concatenate([[0], np.cumsum([len(x) for x in encoded])[:-1]])
        # each text begins with a border, and its last word ends with that of the next text
        self.letters = np.frombuffer(("\n" + "\n".join(t or "" for t in texts) + "\n").encode("utf-32-le"), dtype="<u4").copy()
        self.letters[(self.letters == 0x20) | ((self.letters >= 0x09) & (self.letters <= 0x0D))] = 0
        self.letter_starts = np.concatenate([[0], np.cumsum([len(t or "") + 1 for t in texts])[:-1]])

    def ngrams(self):
        """(buckets by position, positions that hold none) for each length: those with a border inside are none."""
        x = self.letters * np.uint32(0x9E3779B1)
        border = self.letters == 0
        hashed, inside = x.copy(), np.zeros(len(x), dtype=bool)
        for n in range(2, max(NGRAMS) + 1):
            hashed = hashed[:-1] * np.uint32(0x01000193) + x[n - 1 :]
            inside = inside[:-1] | (border[n - 2 : n - 2 + len(hashed)] if n > 2 else False)
            if n not in NGRAMS or not len(hashed):
                continue
            mixed = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
            yield mixed >> np.uint32(32 - BUCKET_BITS), inside

    def words(self):
        """(buckets, text of each) for words and for pairs of neighbours."""
        blank = _SPACE[self.raw]
        first = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
        last = np.flatnonzero(blank & np.concatenate([[False], ~blank[:-1]]))
        if not len(first):
            return
        up, down = _powers(1 << int(len(self.raw)).bit_length())
        total = np.cumsum((self.raw.astype(np.uint64) + np.uint64(1)) * up[: len(self.raw)], dtype=np.uint64)
        before = np.where(first > 0, total[first - 1], np.uint64(0))
        hashed = (total[last - 1] - before) * down[first]
        owner = np.searchsorted(self.starts, first, side="right") - 1
        shift = np.uint64(64 - BUCKET_BITS)
        yield (hashed * np.uint64(_ODD)) >> shift, owner
        same = owner[1:] == owner[:-1]
        pair = (hashed[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + hashed[1:])[same]
        yield (pair * np.uint64(_ODD)) >> shift, owner[:-1][same]


def _mean_weight(texts: list[str | None], weight: np.ndarray) -> np.ndarray:
    """For each text the mean of the weights of its features, 0 where it has none."""
    batch = Batch(texts)
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    for bucket, broken in batch.ngrams():
        value = weight[bucket]
        value[broken] = 0
        at = batch.letter_starts
        inside = at < len(value)
        total[inside] += np.add.reduceat(value, at[inside], dtype=np.float64)
        count[inside] += np.add.reduceat(~broken, at[inside], dtype=np.int64)
    for bucket, owner in batch.words():
        total += np.bincount(owner, weight[bucket], len(texts))
        count += np.bincount(owner, minlength=len(texts))
    return total / np.maximum(count, 1)


def _features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    batch = Batch([text])
    parts = [b[~broken] for b, broken in batch.ngrams()] + [b for b, _ in batch.words()]
    found = np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64)
    buckets, counts = np.unique(found, return_counts=True)
    return buckets, (counts / max(1, len(found))).astype(np.float32)


class Model:
    """Folded weights; score() is the probability of label 1."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight, bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = [np.empty(0)]
        for a, b in groups_of_texts(texts):
            out.append(1 / (1 + np.exp(-np.clip(_mean_weight(texts[a:b], self.weight) + self.bias, -30, 30))))
        return np.concatenate(out)


def train(epoch: Callable[[int], Iterable[tuple[np.ndarray, np.ndarray, int]]], rows: int, labels: set[int], seed: int = 7) -> Model:
    """Fit vectors and softmax layer on the `rows` of each epoch, in its order: (distinct buckets, their shares, label 0 or 1)."""
    size = 1 << BUCKET_BITS
    if len(labels) < 2:
        return Model(np.zeros(size, np.float32), {0: -4.0, 1: 4.0}.get(next(iter(labels), None), 0.0))
    draw = np.random.default_rng(seed)
    vectors = draw.uniform(-0.5, 0.5, (size, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    layer = draw.normal(0, 1 / np.sqrt(DIMENSIONS), (2, DIMENSIONS)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    steps, done = EPOCHS * rows, 0
    for e in range(EPOCHS):
        for buckets, share, y in epoch(e):
            rate = RATE * (1 - done / steps)
            done += 1
            hidden = share @ vectors[buckets]
            logits = layer @ hidden + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1
            back = layer.T @ p
            layer -= rate * np.outer(p, hidden)
            bias -= rate * p
            if len(buckets):  # the step moves the average by rate * back
                vectors[buckets] -= (rate / (share @ share)) * share[:, None] * back[None, :]
    return Model((vectors @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", rows: int = SAMPLE_ROWS) -> Model:
    """Learn from labelled documents outside the held-out fold, at most `rows` of them."""
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"), 4, 2))
    wanted = lowest_hashes(usable.select("doc_id", F.col(label_col).cast("int").alias("y")), "doc_id", rows).distinct()
    texts = one_for_each(docs.select("doc_id", "text"), ["doc_id", "y"], wanted)

    def features():
        def apply(found):
            made = [_features(t) for t in found]
            return [[b.astype("<i4").tobytes() for b, _ in made], [s.astype("<f4").tobytes() for _, s in made]]

        return apply

    binary = [T.StructField(c, T.BinaryType()) for c in ("buckets", "shares")]
    made = materialise(append_columns(texts, "text", T.StructType(binary), features).drop("text"), "features")
    told = made.groupBy("y").count().collect()

    def epoch(e: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        for r in made.orderBy(F.xxhash64("doc_id", "y", F.lit(e)), "doc_id", "y").toLocalIterator():
            yield np.frombuffer(r.buckets, "<i4"), np.frombuffer(r.shares, "<f4"), r.y

    return train(epoch, sum(r["count"] for r in told), {r.y for r in told})


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    def make():
        return lambda texts: [model.scores(texts)]

    return append_columns(docs, text_col, T.StructType([T.StructField(out_col, T.DoubleType())]), make)


def op2_quality_model(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", in_fold(F.col("doc_id"), 4, 2).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
