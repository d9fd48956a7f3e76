"""Language identification by a bidirectional gated recurrent network over bytes (operator 6).

A text's UTF-8 bytes are laid out in windows of WINDOW bytes that cover it whole; the last one is filled up
with zero bytes. In each window one network reads forwards and one backwards; at every byte a softmax over
both states gives the probability of each language. A document's probabilities are the mean over its
bytes. Both networks are trained together in numpy by backpropagation through time and Adam.

The model is fitted on a bounded sample of rows with a language (SAMPLE_ROWS, by the order of a hash of the
id). From each of these, DRAWS windows are drawn at random over the whole text, where the text is; training takes
from them, every language as often.
Every text is read whole in prediction.

Defined results: `und` with score 0 for texts that are null or hold no letter, and for all texts if there was
nothing to learn from. Repeated rows give repeated results; ties go to the language that sorts first.
A null id is never held out, and never learned from; of rows that share an id one is learned from. Other columns pass unchanged.
"""

from __future__ import annotations

import zlib

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.llm.common import append_columns, fresh, groups_of_texts, in_fold, lowest_hashes, one_for_each

SAMPLE_ROWS = 3000
#: Windows that are drawn from a text for training.
DRAWS = 128
WINDOW = 128
HIDDEN = 8
STEPS = 350
TRAIN_WINDOW = 48
TRAIN_BATCH = 96
#: Windows that are read together.
READ_BATCH = 2048
_LETTER = regex.compile(r"\p{L}")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Two gated recurrent networks and a softmax layer; states are columns, so that gates are blocks of rows."""

    def __init__(self, languages: list[str], seed: int = 11):
        draw = np.random.default_rng(seed)
        h, k = HIDDEN, max(1, len(languages))
        self.languages = languages
        small = lambda *shape: draw.normal(0, 0.3, shape).astype(np.float32)
        self.weights = {"out_bias": np.zeros((k, 1), np.float32)}
        for d in ("f", "b"):
            self.weights |= {f"in_{d}": small(3 * h, 256), f"rec_{d}": small(3 * h, h), f"out_{d}": small(k, h)}

    # reading

    def _walk(self, bytes_: np.ndarray, d: str, logits: np.ndarray) -> None:
        """Add one direction's part to logits (time, language, window)."""
        h = HIDDEN
        inp, rec, out = (np.ascontiguousarray(self.weights[f"{n}_{d}"]) for n in ("in", "rec", "out"))
        scale = np.ones((3 * h, 1), np.float32)
        scale[: 2 * h] = 0.5  # a sigmoid is a tanh of half its argument
        inp, rec = inp * scale, rec * scale
        n, width = bytes_.shape
        state, gates, recurrent = (np.zeros((r, width), np.float32) for r in (h, 3 * h, 3 * h))
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            np.take(inp, bytes_[t], axis=1, out=gates, mode="clip")
            np.matmul(rec, state, out=recurrent)
            gates[: 2 * h] += recurrent[: 2 * h]
            np.tanh(gates[: 2 * h], out=gates[: 2 * h])
            gates[: 2 * h] += 1
            gates[: 2 * h] *= 0.5
            recurrent[2 * h :] *= gates[h : 2 * h]
            new = gates[2 * h :]
            new += recurrent[2 * h :]
            np.tanh(new, out=new)
            state -= new
            state *= gates[:h]
            state += new
            logits[t] += out @ state

    def read(self, bytes_: np.ndarray) -> np.ndarray:
        """Probabilities (time, language, window) of windows (time, window)."""
        logits = np.empty((len(bytes_), max(1, len(self.languages)), bytes_.shape[1]), np.float32)
        logits[:] = self.weights["out_bias"]
        self._walk(bytes_, "f", logits)
        self._walk(bytes_, "b", logits)
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        """Mean over bytes, (text, language); zero for texts without bytes."""
        out = np.zeros((len(texts), max(1, len(self.languages))))
        for a, b in groups_of_texts(texts):
            encoded = [(t or "").encode() for t in texts[a:b]]
            sizes = np.array([len(x) for x in encoded])
            windows = -(-sizes // WINDOW)
            filled = b"".join(x.ljust(int(w) * WINDOW, b"\0") for x, w in zip(encoded, windows, strict=True))
            table = np.frombuffer(filled, dtype=np.uint8).reshape(-1, WINDOW)
            owner = np.repeat(np.arange(a, b), windows)
            first = np.concatenate([[0], np.cumsum(windows)])[:-1]
            inside = np.repeat(sizes, windows) - WINDOW * (np.arange(len(table)) - np.repeat(first, windows))
            for i in range(0, len(table), READ_BATCH):
                block = np.ascontiguousarray(table[i : i + READ_BATCH].T)
                p = self.read(block)
                p *= (np.arange(WINDOW)[:, None] < inside[i : i + READ_BATCH])[:, None, :]
                np.add.at(out, owner[i : i + READ_BATCH], p.sum(axis=0).T)
            out[a:b] /= np.maximum(sizes, 1)[:, None]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        known = [i for i, t in enumerate(texts) if t and self.languages and _LETTER.search(t)]
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        p = self.probabilities([texts[i] for i in known])
        for i, row in zip(known, p, strict=True):
            best = int(row.argmax())
            names[i], scores[i] = self.languages[best], float(min(1.0, row[best]))
        return names, scores

    # learning

    def _forward(self, bytes_: np.ndarray, d: str) -> list[tuple]:
        h, w = HIDDEN, self.weights
        state, kept = np.zeros((h, bytes_.shape[1]), np.float32), {}
        for t in range(len(bytes_)) if d == "f" else range(len(bytes_) - 1, -1, -1):
            x = w[f"in_{d}"][:, bytes_[t]]
            r = w[f"rec_{d}"] @ state
            gate = _sigmoid(x[: 2 * h] + r[: 2 * h])
            new = np.tanh(x[2 * h :] + gate[h:] * r[2 * h :])
            before = state
            state = new + gate[:h] * (before - new)
            kept[t] = (before, gate, r[2 * h :], new, state)
        return [kept[t] for t in range(len(bytes_))]

    def gradients(self, bytes_: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over all positions, and its gradients by backpropagation through time."""
        n, width = bytes_.shape
        w, h = self.weights, HIDDEN
        kept = {d: self._forward(bytes_, d) for d in ("f", "b")}
        states = {d: np.stack([x[4] for x in kept[d]]) for d in kept}
        logits = w["out_f"] @ states["f"] + w["out_b"] @ states["b"] + w["out_bias"]
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        loss = float(-np.log(p[:, label, np.arange(width)] + 1e-9).mean())
        p[:, label, np.arange(width)] -= 1
        p /= n * width
        grad = {"out_bias": p.sum(axis=(0, 2))[:, None]}
        for d in ("f", "b"):
            grad[f"out_{d}"] = np.einsum("tkw,thw->kh", p, states[d])
            g_in, g_rec = np.zeros_like(w[f"in_{d}"]), np.zeros_like(w[f"rec_{d}"])
            carry = np.zeros((h, width), np.float32)
            for t in range(n - 1, -1, -1) if d == "f" else range(n):
                before, gate, r_new, new, _ = kept[d][t]
                z, r = gate[:h], gate[h:]
                down = w[f"out_{d}"].T @ p[t] + carry
                d_new = down * (1 - z) * (1 - new * new)
                d_gate = np.concatenate([down * (before - new), d_new * r_new]) * gate * (1 - gate)
                g = np.concatenate([d_gate, d_new])
                through = np.concatenate([d_gate, d_new * r])
                g_rec += through @ before.T
                np.add.at(g_in.T, bytes_[t], g.T)
                carry = down * z + w[f"rec_{d}"].T @ through
            grad |= {f"in_{d}": g_in, f"rec_{d}": g_rec}
        return loss, grad


def drawn_windows(text: str, seed: int) -> list[bytes]:
    """DRAWS windows of TRAIN_WINDOW bytes (shorter at the end), at places drawn over the whole text."""
    data = text.encode()
    starts = np.random.default_rng(seed).integers(max(1, len(data) - TRAIN_WINDOW // 2), size=DRAWS)
    return [data[a : a + TRAIN_WINDOW] for a in starts.tolist()]


def train(rows: list[tuple[list[bytes], str]], seed: int = 11, steps: int = STEPS) -> Network:
    """Fit on (windows, language) of texts."""
    by: dict[str, list[list[bytes]]] = {}
    for windows, language in rows:
        if windows:
            by.setdefault(language, []).append(windows)
    net = Network(sorted(by), seed)
    if len(by) < 2:
        return net
    draw = np.random.default_rng(seed)
    mean = {k: np.zeros_like(v) for k, v in net.weights.items()}
    square = {k: np.zeros_like(v) for k, v in net.weights.items()}
    for step in range(1, steps + 1):
        label = draw.integers(len(by), size=TRAIN_BATCH)
        block = np.zeros((TRAIN_WINDOW, TRAIN_BATCH), np.uint8)
        for i, k in enumerate(label):
            texts = by[net.languages[k]]
            windows = texts[draw.integers(len(texts))]
            piece = windows[draw.integers(len(windows))]
            block[: len(piece), i] = np.frombuffer(piece, np.uint8)
        _, grad = net.gradients(block, label)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grad.items():
            g = g / max(1.0, norm)
            mean[k] += 0.1 * (g - mean[k])
            square[k] += 0.01 * (g * g - square[k])
            net.weights[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Network:
    """Learn from documents with a language outside the held-out fold, at most `rows` of them."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"), 5, 0))
    wanted = lowest_hashes(usable.select("doc_id"), "doc_id", rows).distinct()
    texts = one_for_each(usable.select("doc_id", "lang", "text"), ["doc_id"], wanted)

    def windows():
        return lambda found: [[drawn_windows(t, zlib.crc32(t.encode())) if t and _LETTER.search(t) else [] for t in found]]

    made = append_columns(texts, "text", T.StructType([T.StructField("windows", T.ArrayType(T.BinaryType()))]), windows)
    got = sorted(made.select("doc_id", "lang", "windows").collect(), key=lambda r: r.doc_id)
    return train([([bytes(w) for w in r.windows], r.lang) for r in got])


def predict(docs: DataFrame, net: Network, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    fields = T.StructType([T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())])
    return append_columns(docs, text_col, fields, lambda: net.predict)


def keep_known(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """documents whose language was found with a score of at least `least`; the others go."""
    names = docs.columns
    lang, score = fresh("lang_pred", names), fresh("score", names)
    told = predict(docs, fit(docs), lang_col=lang, score_col=score)
    return told.where((F.col(lang) != "und") & (F.col(score) >= least)).select(*names)


def op6_language_id(docs: DataFrame) -> DataFrame:
    told = predict(docs.select("doc_id", "text"), fit(docs))
    return told.select("doc_id", in_fold(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score")
