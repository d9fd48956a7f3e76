import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from strataloom.llm import phrases as C
from strataloom.llm.queries import ORACLES, QUERIES

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, least, longest=5, best=2000):
    """{(lang, rank): (phrase, a, l, r, n, score)} with all phrases in memory."""
    f, n = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.setdefault(lang, Counter()).update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = {}
    for lang, counts in f.items():
        often = {w: a for w, a in counts.items() if a >= least}
        found = []
        for w, a in often.items():
            if len(w) < 2:
                continue
            if any(len(g) > len(w) and b >= a and any(g[i : i + len(w)] == w for i in range(len(g) - len(w) + 1)) for g, b in often.items()):
                continue
            score, _, l, r = min((1000 * a * n[lang] // (counts[w[:k]] * counts[w[k:]]), k, counts[w[:k]], counts[w[k:]]) for k in range(1, len(w)))
            found.append((-score, -a, " ".join(w).encode(), l, r))
        for i, (score, a, phrase, l, r) in enumerate(sorted(found)[:best]):
            out[lang, i + 1] = (phrase.decode(), -a, l, r, n[lang], -score)
    return out


def got(df):
    rows = df.collect()
    assert len({(r.lang, r.rank) for r in rows}) == len(rows)
    return {(r.lang, r.rank): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in rows}


SCHEMA = "lang string, text string"


def drawn(seed, n):
    draw = random.Random(seed)
    words = ["The", "the", "of", "à", "é", "New", "york", "x" * 40, "Ü", "日本", "a", "b", "\x00c"]
    marks = [" "] * 9 + ["\t", "  ", ". ", ",", "\n", " !?", "\r\n", "\x0b"]
    texts = ["".join(draw.choice(words) + draw.choice(marks) for _ in range(draw.randrange(60))) for _ in range(n)]
    return [(draw.choice(("en", "de", "日", None)), t) for t in texts] + [("en", None), ("en", ""), (None, " .\t"), ("leer", ",,")] + [("en", "New York of the\tNew  york of THE a.")] * 30


@pytest.mark.parametrize(("block", "bits"), [(200, 26), (5000, 3), (C.BLOCK, 12)])
def test_equals_brute_force(spark, block, bits):
    rows = drawn(block, 250)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute(rows, 12)
    assert got(C.mine(frame, least=12, block=block, bits=bits)) == want and len(want) > 40
    assert got(C.mine(frame, least=12, best=7, block=block, bits=bits)) == brute(rows, 12, best=7)


def test_colliding_fingerprints_are_told_apart(spark, monkeypatch):
    """With first fingerprints of two bits every word and phrase collides, in blocks and between them."""
    mixed = C._mixed
    first = {0x2545F4914F6CDD1D}
    monkeypatch.setattr(C, "_mixed", lambda x, salt: x & np.uint64(3) if salt in first else mixed(x, salt))
    blocks_ = [C.Block("en", [(0, 0, t)]) for t in (b"ab cd", b"cd ab ef", b"x" * 30 + b"y", b"x" * 30 + b"z")]
    seconds = [b.second(1, np.arange(len(b.first))).tolist() for b in blocks_]
    assert seconds[0][0] == seconds[1][1] and seconds[0][1] == seconds[1][0] and len({x for s in seconds for x in s}) == 5
    assert blocks_[0].second(2, np.array([0])).tolist() != blocks_[1].second(2, np.array([0])).tolist()
    words = C.Block("en", [(0, 0, b"aa bb cc dd ee ff aa gg hh bb")])
    assert sorted(words.runs(1, None)[1].tolist()) == [1] * 6 + [2] * 2
    assert sorted(C.Block("en", [(0, 0, b"aa bb aa bb cc aa bb")]).runs(2, None)[1].tolist()) == [1, 1, 1, 3]
    assert len(set(C.Block("en", [(0, 0, b"aa bb cc dd ee ff aa gg hh bb")]).keys(1).tolist())) <= 4


def test_pointers_of_one_fingerprint_are_recounted_by_text(spark):
    texts = spark.createDataFrame([(0, "en", "x y x y x y"), (1, "en", "p q p q p q")], "row bigint, lang string, text string")
    made = spark.createDataFrame([("en", "x y x y x y", [(2, 0 << 32 | 3, 3), (2, 2 << 32 | 3, 2)]), ("en", "p q p q p q", [(2, 3, 3)])], "lang string, text string, pointers array<struct<words int, at bigint, count bigint>>")
    found = {(r.phrase, r["count"]) for r in made.mapInArrow(C._followed, "lang string, words int, phrase string, count bigint").collect()}
    assert found == {("x y", 3), ("y x", 2), ("p q", 3)}
    assert C.grams(texts, 6).count() == 2 and C.grams(texts, 7).count() == 0


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_given_documents_equal_sql_and_brute_force(spark, folder):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = brute(rows, 100)
    assert got(QUERIES["op12_phrases"](spark, folder)) == want
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    made = con.sql(ORACLES["op12_phrases"])
    assert {(x[0], x[1]): x[2:] for x in made.select("lang, rank, phrase, a, l, r, n, score").fetchall()} == want


def test_long_words_and_texts(spark):
    """A word of a million letters, its twin that ends differently, and a text far beyond a block."""
    long = "a" * 1_000_000
    rows = [("en", f"{long}b {long}c. " * 2)] * 2 + [("en", "New York, " * 20_000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert got(C.mine(frame, least=4, block=10_000)) == brute(rows, 4)


def test_numbers_beyond_64_bits(spark):
    big = 10**13
    known = spark.createDataFrame([("en", 1, "a", big), ("en", 1, "b", 3), ("en", 2, "a b", big - 1)], "lang string, words int, phrase string, f bigint")
    total = spark.createDataFrame([("en", 16 * big)], "lang string, n bigint")
    (r,) = C.collocations(known, total).collect()
    assert (r.a, r.l, r.r, r.n, r.score) == (big - 1, big, 3, 16 * big, 1000 * (big - 1) * 16 * big // (big * 3))


def test_empty_table_and_extra_columns(spark):
    assert C.op12_phrases(spark.createDataFrame([], SCHEMA)).count() == 0
    assert C.op12_phrases(spark.createDataFrame([("en", "few words")], SCHEMA)).count() == 0
    frame = spark.createDataFrame([("en", "a b.", 1, "x", "y")] * 120, SCHEMA + ", row int, key string, phrase string")
    assert got(C.op12_phrases(frame)) == {("en", 1): ("a b", 120, 120, 120, 240, 2000)}


def test_what_is_sent_is_small(spark):
    """Fingerprints, counts and parts are shuffled, and no texts: about as many bytes as the table has, not twice as many."""
    path = "/root/testdata/sf0.01/documents.parquet"
    spark.sparkContext.setJobGroup("sent", "what op12 sends")
    C.op12_phrases(spark.read.parquet(path)).collect()
    spark.sparkContext.setJobGroup("", "")
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    stages = {i for job in tracker.getJobIdsForGroup("sent") for i in tracker.getJobInfo(job).stageIds if tracker.getStageInfo(i)}
    sent = sum(store.lastStageAttempt(i).shuffleWriteBytes() for i in stages)
    assert 0.3 * os.path.getsize(path) < sent < 1.4 * os.path.getsize(path)


def test_names_are_cut_in_slices(monkeypatch):
    """Every run is cut out once, however few pointers go together, and only in the part that the bitmap names."""
    monkeypatch.setattr(C, "SENT", 3)
    found = C.Block("en", [(0, 0, b"a b a b\nc"), (1 << 33, 0, b"a b x")])
    full = np.full(1 << 10, 255, np.uint8)
    cut = [x for batch in C._followed(C._pointed(found, 2, full, full)) for x in batch.to_pylist()]
    assert sorted((x["words"], x["phrase"]) for x in cut) == [(0, ""), (1, "a"), (1, "b"), (1, "c"), (1, "x"), (2, "a b"), (2, "b a"), (2, "b x")]
    first = np.zeros(1 << 10, np.uint8)
    for n in (1, 2):
        for k in found.runs(n, None)[0].view(np.uint64) & np.uint64(8191):
            first[int(k) >> 3] |= 1 << (int(k) & 7)
    cut = [x["phrase"] for batch in C._followed(C._pointed(found, 2, full, first)) for x in batch.to_pylist()]
    assert sorted(x for x in cut if "x" not in x) == ["", "a", "a b", "b", "b a", "c"] and not {"x", "b x"} & set(cut)
