import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from strataloom.llm import chunk_codec as C
from strataloom.llm.queries import QUERIES

FILE, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(FILE, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = [
    None, "", " ", "\n\n  x", "it's we'll 'llama", "a  b\t\tc \n", "<|endoftext|> x", "é" * 700, "ab" * 900, " " * 900 + "x", "\n" * 700 + "y",
    "日本語のテキスト" * 90, "1234567890" * 80, "x\x1cy\x85z　w​", "'" * 600 + "ll", "don't" * 200, "🙂👍🏽" * 60, "a" * 40_000, "\x00\x07",
]


def mixed(seed, n):
    draw = random.Random(seed)
    words = ["the", " of", "Straße", "'ll", "'", "\n", "   ", "\t", "12", "…", "x" * 30, "é", ",", "ab" * 40, " " * 50, "🙂", "'ve ", "."]
    return "".join(draw.choice(words) for _ in range(n))


def wanted(library, text):
    return library.encode_ordinary(text or "")


def test_pieces_equal_the_library(library):
    coder = C.RankCodec(FILE, PATTERN)
    for text in [*ODD, *(mixed(s, 200) for s in range(20))]:
        assert coder.encode(text).tolist() == wanted(library, text)
    for piece in (b"a" * 300, "日本語".encode() * 60, b"abcabc" * 50, bytes(range(256)), b"ing" * 99):
        assert coder.merged_by_heap(piece) == coder.merged(piece[:]) and coder.decode(coder.merged(piece)) == piece
        short = piece[: C.HEAP_FROM - 1]
        assert coder.merged_by_heap(short) == coder.merged(short)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_any_text_equals_the_library(library, text):
    coder = C.codec(FILE, PATTERN)
    ids = coder.encode(text)
    assert ids.tolist() == wanted(library, text) and coder.decode(ids.tolist()) == text.encode()


@pytest.mark.parametrize(("chunk", "overlap"), [(40, 20), (64, 33), (300, 64), (5000, 512)])
def test_chunked_texts_equal_the_library(spark, library, chunk, overlap):
    texts = [*ODD, *(mixed(s, 60 + 40 * s) for s in range(25)), "word " * 3000, "x" * 700 + " " + "y" * 700 + " z", ("w" * 70 + " ") * 60]
    texts = [t if t is None or len(t) < 12_000 or chunk > 64 else t[:4000] for t in texts]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    made = C.decode(C.encode(frame, FILE, PATTERN, chunk=chunk, overlap=overlap), FILE, PATTERN).collect()
    assert len(made) == len(texts)
    for r in made:
        assert r.ids == wanted(library, texts[r.doc_id]), texts[r.doc_id][:50]
        assert bytes(r.decoded) == (texts[r.doc_id] or "").encode()


def test_given_documents_equal_the_library(spark, library):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = QUERIES["op11_chunk_codec"](spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = wanted(library, texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_odd_rows(spark, library):
    long = mixed(3, 40_000)
    rows = [(1, "a b", "x", 1), (1, "a b", "x", 1), (None, None, "y", 2), (2, "", None, None), (3, long, "z", 3), (3, long, "z", 3), (None, long, "q", 4)]
    made = C.encode(spark.createDataFrame(rows, "doc_id bigint, text string, row string, ids int"), FILE, PATTERN)
    assert set(made.columns) == {"doc_id", "text", "row", "ids"}
    got = sorted(((r.doc_id, r.row, len(r.ids)) for r in made.collect()), key=str)
    n = len(wanted(library, long))
    assert got == sorted([(1, "x", 2), (1, "x", 2), (None, "y", 0), (2, None, 0), (3, "z", n), (3, "z", n), (None, "q", n)], key=str)
    assert C.op11_chunk_codec(spark.createDataFrame([], "doc_id bigint, text string"), FILE, PATTERN).count() == 0
    with pytest.raises(KeyError):
        C.codec(FILE, PATTERN).decode([10**6])
    with pytest.raises(ValueError):
        C.encode(spark.createDataFrame(rows, "doc_id bigint, text string, row string, ids int"), FILE, PATTERN, chunk=10, overlap=20)
