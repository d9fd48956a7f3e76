"""Token counts by heap-and-linked-list byte-pair merging (operator 9).

The vocabulary is a `tokenizers` JSON file with a BPE model, word ends and a normalizer that composes (NFC),
collapses white space and lower-cases. The symbols of a word form a linked list; a heap holds its adjacent
pairs by rank. The lowest pair is popped and merged until none is left, so the count is the number of
initial symbols less the number of merges. No identifier is produced.

Defined results: null and empty texts have 0 tokens; white space alone has 0 tokens; strings of special
tokens inside a text count one each, as the library takes them by default. Rows are independent: repeated
rows and ids give repeated results; other columns pass unchanged, but for one named like the output.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import lru_cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.llm.common import Memo, append_columns

#: What the vocabulary's library takes as white space.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: What str.split() takes as white space beyond that.
SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")


def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, spare = [""] * 256, 0x100
    for b in range(256):
        if b in printable:
            letters[b] = chr(b)
        else:
            letters[b] = chr(spare)
            spare += 1
    return letters


class MergeCounter:
    """Counts tokens of texts for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.letters = byte_letters()
        symbols: dict[str, int] = {}
        number = lambda s: symbols.setdefault(s, len(symbols))
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs[number(left), number(right)] = rank, number(left + right)
        self.symbols = symbols
        special = [x["content"] for x in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern.replace(r"\s", SPACES))
        self.space = regex.compile(f"[{SPACES}]+")
        self.words = Memo(self.count_word)

    def merged(self, symbols: list[str]) -> int:
        """Symbols that are left when all merges are done."""
        n = len(symbols)
        if n < 2:
            return n
        ids = [self.symbols.get(s, -1) for s in symbols]
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        pairs, heap = self.pairs, []
        for i in range(n - 1):
            if found := pairs.get((ids[i], ids[i + 1])):
                heap.append((found[0], i, found[1]))
        heapq.heapify(heap)
        left = n
        while heap:
            rank, i, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or pairs.get((ids[i], ids[j]), (-1,))[0] != rank:
                continue  # one side has been merged meanwhile
            ids[i], ids[j] = new, -2
            k = after[i] = after[j]
            left -= 1
            if k >= 0:
                before[k] = i
                if found := pairs.get((new, ids[k])):
                    heapq.heappush(heap, (found[0], i, found[1]))
            if (h := before[i]) >= 0 and (found := pairs.get((ids[h], new))):
                heapq.heappush(heap, (found[0], h, found[1]))
        return left

    def count_word(self, word: str) -> int:
        """Tokens of a string without white space."""
        letters, total = self.letters, 0
        lowered = "".join([c.lower() for c in word]) if "Σ" in word else word.lower()
        for piece in self.pieces.findall(lowered):
            symbols = [letters[b] for b in piece.encode()]
            symbols[-1] += self.end
            total += self.merged(symbols)
        return total

    def count_plain(self, text: str) -> int:
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        words = self.space.split(text) if any(c in text for c in SEPARATORS) else text.split()
        return sum(map(self.words.__getitem__, words))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or "<|" not in text:
            return self.count_plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.count_plain, parts))


@lru_cache(2)
def counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def count_tokens(df: DataFrame, vocabulary: str, text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """df with the tokens of each whole text as a bigint column; one pass, no shuffle."""

    def make():
        count = counter(vocabulary).count
        return lambda texts: [[count(t) for t in texts]]

    return append_columns(df, text_col, T.StructType([T.StructField(out_col, T.LongType())]), make)


def op9_token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    sized = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = count_tokens(sized, vocabulary)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
