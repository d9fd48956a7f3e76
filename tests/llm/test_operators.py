"""Each operator against brute force or its library, on the given tables and on odd rows."""

import hashlib
import random
import time
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strataloom.llm import bpe_codec, language_id, packing, pii, quality_model, quality_rules, queries, simhash, token_counts, topk, url_rules

ODD = ["", None, "   \n\t ", "one", "one two", "a  b\n\nc d", "same text here", "same text here", "x" * 30_000, "Σας ΣΑΣ É́ \x1c\x85 <|endoftext|> <|startoftext|>z", "mail a@b.co_x@y.com 1.2.3.4.5 999.1.1.1 4111 1111 1111 1111 +1 (017) 555-7713 end"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, __text string, kept string, score int, lang_pred string, candidates string, key string, row string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i != 3 else None, t, "en" if i % 2 else None, None if i == 4 else "s", len(t or ""), "clash", "clash", 1, "clash", "clash", "clash", "clash") for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[6]], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(11)] + [(None, 1, None)], "doc_id bigint, quality int, toxic int")


def texts_of(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


# 1


def test_bk_tree_finds_what_a_scan_finds():
    draw = random.Random(1)
    base = [draw.getrandbits(64) for _ in range(20)]
    values = [draw.choice(base) ^ sum(1 << draw.randrange(64) for _ in range(draw.randrange(4))) for _ in range(400)]
    values = [v & (2**64 - 1) for v in dict.fromkeys(values)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    tree.freeze()
    which, node = tree.near_many(np.array(values, dtype=np.uint64), 3)
    for i, v in enumerate(values):
        want = {j for j, x in enumerate(values) if (x ^ v).bit_count() <= 3}
        assert set(tree.near(v, 3)) == want == set(node[which == i].tolist())


def components(values, ids):
    root = list(range(len(values)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 3:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    best = {}
    for i, d in enumerate(ids):
        best[top(i)] = min((x for x in (best.get(top(i)), d) if x is not None), default=None)
    return [best[top(i)] for i in range(len(values))]


@pytest.mark.parametrize("size", [4096, 7])
def test_near_edges_link_like_all_pairs(spark, size):
    draw = random.Random(2)
    base = [draw.getrandbits(64) for _ in range(12)]
    values = {draw.choice(base) ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)) for _ in range(300)}
    signed = [(int(np.uint64(v).astype(np.int64)),) for v in values]
    edges = simhash.near_edges(spark.createDataFrame(signed, "fp bigint"), tree_size=size)
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    values = sorted(v for (v,) in signed)
    want = components([v & (2**64 - 1) for v in values], values)
    assert [roots.get(v, v) for v in values] == want


def test_simhash_query(spark, sf):
    from xxhash import xxh64_intdigest

    rows = {r["doc_id"]: r for r in queries.op1_simhash(spark, sf).collect()}
    texts = texts_of(spark, sf)
    assert rows.keys() == texts.keys()
    values = []
    for d, t in texts.items():
        w = ["".join(c.lower() if c.isascii() else c for c in x) for x in brute.words(t)]
        shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        bits = Counter(b for s in shingles for h in [xxh64_intdigest(s.encode(), 42)] for b in range(64) if h >> b & 1)
        values.append(sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles)))
        assert rows[d]["fingerprint"] == f"{values[-1]:016x}"
    assert [rows[d]["component_id"] for d in texts] == components(values, list(texts))


def test_simhash_odd_rows(spark, odd):
    rows = simhash.op1_simhash(odd).collect()
    assert len(rows) == len(ODD) + 1
    assert {r["fingerprint"] for r in rows if r["doc_id"] in (0, 1, 2)} == {"0" * 16}
    assert {r["component_id"] for r in rows if r["doc_id"] in (6, 7)} == {6}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 4, 5, 6, 8, 9, 10]
    assert simhash.op1_simhash(odd.limit(0)).count() == 0


# 2


def test_quality_model(spark, sf):
    sf = "/root/testdata/sf0.01"
    rows = queries.op2_quality_model(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 50
    good = [r["score"] for r in rows if r["quality"] == 1]
    bad = [r["score"] for r in rows if r["quality"] == 0]
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.97
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_quality_model_odd_rows(odd, labels):
    rows = quality_model.op2_quality_model(odd, labels).collect()
    assert len(rows) == len(ODD) + 1 and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (0, 1)}) == 1
    assert {r["score"] for r in quality_model.op2_quality_model(odd, labels.limit(0)).collect()} == {0.5}
    assert quality_model.op2_quality_model(odd.limit(0), labels).count() == 0


def test_mean_weight_is_a_mean_over_features():
    texts = ["ab cd ef", "", "x", "long " * 300, None, "ñandú día"]
    weight = np.random.default_rng(0).normal(size=1 << quality_model.BUCKET_BITS).astype(np.float32)
    together = quality_model._mean_weight(texts, weight)
    for t, got in zip(texts, together, strict=True):
        buckets, share = quality_model._features(t)
        assert got == pytest.approx(float(share @ weight[buckets]) if len(buckets) else 0.0, abs=1e-5)


def test_samples_are_bounded_by_rows_not_ids(spark, labels):
    """A repeated id gives one row."""
    from strataloom.llm.common import one_for_each

    many = spark.range(5000).select(F.lit(3).cast("bigint").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    got = one_for_each(many, ["doc_id", "y"], labels.select("doc_id", F.col("quality").alias("y")).distinct()).collect()
    assert [tuple(r) for r in got] == [(3, 1, "text 0")]


def placed(draw, signal):
    """A text of 60 000 characters of filler with a tenth of signal anywhere."""
    at = draw.randrange(54_000)
    return ("neutral 0123 " * 5000)[:at] + " " + (signal + " ") * (6000 // len(signal)) + ("neutral 0123 " * 5000)[: 54_000 - at]


def test_long_texts_are_learned_from_whole(spark):
    draw = random.Random(2)
    rows = [(i, placed(draw, "careful prose" if i % 2 else "click win cash"), i % 2) for i in range(160)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    got = quality_model.op2_quality_model(frame.select("doc_id", "text"), frame.select("doc_id", "quality")).where("held_out").collect()
    assert len(got) > 20
    good, bad = ([r["score"] for r in got if r["doc_id"] % 2 == k] for k in (1, 0))
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.97
    rows = [(i, placed(draw, "él está aquí señor" if i % 2 else "это русский текст"), "es" if i % 2 else "ru") for i in range(60)]
    net = language_id.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert net.predict(["está señor él está aquí", "русский текст это"])[0] == ["es", "ru"]
    assert {len(w) for w in language_id.drawn_windows("x" * 10_000, 1)} <= set(range(language_id.TRAIN_WINDOW // 2, language_id.TRAIN_WINDOW + 1))


def test_ngrams_lie_within_words():
    """The same n-grams as by slicing each word between its borders, in code points."""
    text = "\tñandú x  día\n"
    found = {n: Counter() for n in quality_model.NGRAMS}
    batch = quality_model.Batch(["other", text])
    for n, (buckets, broken) in zip(quality_model.NGRAMS, batch.ngrams(), strict=True):
        found[n].update(int(b) for i, (b, x) in enumerate(zip(buckets, broken)) if i >= batch.letter_starts[1] and not x)
    for n in quality_model.NGRAMS:
        pieces = [f" {w} "[i : i + n] for w in text.split() for i in range(len(w) + 3 - n)]
        assert sum(found[n].values()) == len(pieces)
        assert sorted(found[n].values()) == sorted(Counter(pieces).values())


# 3


def test_pii_query(spark, sf):
    texts = texts_of(spark, sf)
    for r in queries.op3_pii(spark, sf).collect():
        spans = brute.base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == brute.span_digest(spans)
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(r["spans"].split(",")) | {""}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab@.+-_ 0129()é😀", max_size=60), min_size=20, max_size=60))
def test_pii_base_spans_are_the_patterns(spark, made):
    docs = spark.createDataFrame(list(enumerate(made + ODD)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["base_sha256"] for r in pii.op3_pii(docs).collect()}
    for i, t in enumerate(made + ODD):
        assert got[i] == brute.span_digest(brute.base_spans(t)), t


def test_pii_redaction(spark, odd):
    docs = spark.createDataFrame([(1, "call +1 (017) 555-7713 or a@b.co, 10.0.0.1"), (2, None), (3, ""), (4, "clean 12")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert got == {1: "call [PHONE] or [EMAIL], [IP]", 2: None, 3: "", 4: "clean 12"}
    assert pii.redact(odd).columns == odd.columns
    assert pii.redact(odd).count() == len(ODD) + 1
    assert pii.redact(odd.limit(0)).count() == 0


def test_pii_reads_very_long_runs(spark):
    docs = spark.createDataFrame([(1, "a" * 200_000), (2, "1" * 200_000), (3, "1 2-" * 50_000 + "@" + "+1" * 5000)], "doc_id bigint, text string")
    assert pii.op3_pii(docs).count() == 3


def test_pii_is_fast_in_texts_of_many_matches(spark):
    n = 20_000
    docs = spark.createDataFrame([(1, "12;" * 400_000), (2, "4111 1111 1111 1111, " * n), (3, "a@b.co 999.1.1.1 (017) 555-7713 " * 5000)], "doc_id bigint, text string")
    began = time.time()
    rows = {r["doc_id"]: r for r in pii.op3_pii(docs).collect()}
    assert time.time() - began < 120
    assert (rows[1]["n_card"], rows[2]["n_card"], rows[3]["n_email"]) == (0, n, 5000)
    for i, t in ((2, "4111 1111 1111 1111, " * n), (3, "a@b.co 999.1.1.1 (017) 555-7713 " * 5000)):
        assert rows[i]["base_sha256"] == brute.span_digest(brute.base_spans(t))
    text = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert text[1] == "12;" * 400_000 and text[2] == "[CARD], " * n


def planted_spans():
    """Texts with personal data that no base pattern finds, and texts that only look like it."""
    draw = random.Random(8)
    good, bad = [], []
    for i in range(60):
        name, a, b = draw.choice(["ana", "bob.k", "lee"]), draw.randrange(100, 999), draw.randrange(1000, 9999)
        good.append((f"please write to {name} (at) mail{i} (dot) com today", "email", f"{name} (at) mail{i} (dot) com"))
        good.append((f"my phone is ({a}) 555-{b} after six", "phone", f"({a}) 555-{b}"))
        bad.append(f"see section {a}.{b}.{i}.777 of release notes")
        bad.append(f"serial no {a}{b}{b}{i:02d}1 of the article")
        bad.append(f"order number {a} 555 {b}x, invoice {i}")
    return good, bad


def test_added_spans_are_right(spark):
    good, bad = planted_spans()
    base = [f"mail me at user{i}@host{i}.com or phone +1 555 010 {1000 + i}" for i in range(40)]
    texts = [t for t, *_ in good] + bad + base
    rows = {r["doc_id"]: r["spans"] for r in pii.op3_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    want = {(i, f"{kind}:{t.index(span)}:{t.index(span) + len(span)}") for i, (t, kind, span) in enumerate(good)}
    base_found = {(i, f"{k}:{a}:{b}") for i, t in enumerate(texts) for k, a, b in brute.base_spans(t)}
    added = {(i, s) for i, x in rows.items() for s in x.split(",") if s} - base_found
    assert len(added & want) >= 0.9 * len(want), "recall"
    assert len(added & want) >= 0.9 * len(added), "precision"


def test_spans_that_touch_base_spans_go(spark):
    draw = random.Random(4)
    kinds = [dict(kind=draw.randrange(4), start=(a := draw.randrange(200)), end=a + draw.randrange(1, 12), base=draw.random() < 0.3, v0=0, v1=0, v2=0, v3=0, long=False) for _ in range(150)]
    made = spark.createDataFrame([(i, kinds[i * 10 : i * 10 + 10]) for i in range(15)], f"id int, c array<{pii._CANDIDATE}>")
    for r in made.select("c", pii._untouched(F.col("c")).alias("kept")).collect():
        base = [x for x in r["c"] if x["base"]]
        more = {x for x in r["c"] if not x["base"] and not any(b["start"] < x["end"] and x["start"] < b["end"] for b in base)}
        assert r["kept"] == sorted([*base, *more])


def test_votes_find_the_reliable_labelers():
    rows = [((1, 1, 0, 1), 60), ((-1, 0, -1, -1), 50), ((1, 0, 1, -1), 10), ((-1, 1, 0, -1), 10)]
    _, tables, post = pii.aggregate_votes(rows)
    assert post[1, 1, 0, 1] > 0.9 and post[-1, 0, -1, -1] < 0.1
    assert tables[0][1][0] > tables[0][1][1]


# 4 and 9

AWKWARD = st.text(alphabet=st.one_of(st.sampled_from("aeinorst ETHé's\n\t  <|>0123.,!"), st.characters(exclude_categories=["Cs"])), max_size=80)


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@settings(max_examples=300, deadline=None)
@given(AWKWARD)
def test_encoder_is_the_library(byte_library, text):
    coder = bpe_codec.codec(public_tokenizers.path("byte_bpe_50k.json"))
    ids = coder.encode(text)
    assert ids.tolist() == byte_library.encode(text, add_special_tokens=False).ids
    assert coder.decode(ids) == text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aeinorsté '<|>\n", max_size=60) | st.text(alphabet=[chr(c) for c in range(0x20, 0x250)], max_size=60))
def test_counter_is_the_library(word_library, text):
    assert token_counts.counter(public_tokenizers.path("word_bpe_49k.json")).count(text) == len(word_library.encode(text, add_special_tokens=False).ids)


def test_codec_query(spark, sf, byte_library):
    texts = texts_of(spark, sf)
    for r in queries.op4_bpe_codec(spark, sf).collect():
        ids = byte_library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(byte_library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_codec_odd_rows(odd, byte_library):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = bpe_codec.decode(bpe_codec.encode(odd, path), path).collect()
    assert len(rows) == len(ODD) + 1
    assert all(r["decoded"] == (r["text"] or "") for r in rows)
    assert bpe_codec.op4_bpe_codec(odd.limit(0), path).count() == 0


def test_count_query(spark, sf, odd, word_library):
    texts = texts_of(spark, sf)
    for r in queries.op9_token_counts(spark, sf).collect():
        n = len(word_library.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 2048)
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = token_counts.op9_token_counts(odd, path).collect()
    assert sorted(r["n_tokens"] for r in rows) == sorted(len(word_library.encode(t or "", add_special_tokens=False).ids) for t in [*ODD, ODD[6]])


# 5


def test_top_k_is_exact(spark):
    draw = np.random.default_rng(3)
    vectors = [(i, v.tolist()) for i, v in enumerate(draw.integers(-300, 300, (700, 6)) * draw.integers(0, 4, (700, 1)))]
    vectors += [(1000 + i, vectors[3][1]) for i in range(9)] + [(2000, [1, 2]), (2050, [3, 4]), (None, [1] * 6), (2100, None), (2200, [])]
    got = {}
    for r in topk.top_k(spark.createDataFrame(vectors, "id bigint, vector array<bigint>"), lambda i: i % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    usable = {i: v for i, v in vectors if i is not None and v}
    for q, x in usable.items():
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in usable.items() if i != q and len(y) == len(x))[:5]
            assert sorted(got.get(q, [])) == [(n + 1, i, -s) for n, (s, i) in enumerate(scores)], q


def test_rows_that_share_an_id_are_all_candidates(spark):
    rows = [(50, [1.0, 0.0], 0), (1, [0.5, 0.0], 0), (1, [0.9, 0.0], 0), (1, [0.9, 0.0], 0), (50, [0.0, 1.0], 0), (2, [0.0, 0.7], 0)]
    got = topk.op5_exact_topk(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()
    q = {i: [int(np.floor(256 * np.float32(x))) for x in v] for i, v in enumerate(v for _, v, _ in rows)}
    want = sorted((-sum(a * b for a, b in zip(q[i], q[j])), rows[j][0]) for i in (0, 4) for j in (1, 2, 3, 5))[:5]
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]


def test_quantised_leaves_out_unusable_rows(spark):
    rows = [(1, [0.5, -0.001], 0), (2, None, 0), (3, [1.0, None], 0), (4, [float("nan"), 1.0], 0), (5, [float("inf"), 1.0], 0), (None, [1.0, 1.0], 0)]
    made = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    assert {r["id"]: r["vector"] for r in topk.quantised(made).collect() if r["id"]} == {1: [128, -1]}
    assert topk.op5_exact_topk(made.limit(0)).count() == 0
    assert topk.op5_exact_topk(made).count() == 0


# 6


def test_gradients_are_the_slopes():
    net = language_id.Network(["a", "b", "c"])
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    draw = np.random.default_rng(1)
    block, label = draw.integers(0, 256, (7, 5)).astype(np.uint8), draw.integers(0, 3, 5)
    _, grad = net.gradients(block, label)
    for name in grad:
        flat = net.weights[name].reshape(-1)
        for i in np.argsort(-np.abs(grad[name].reshape(-1)))[:3]:
            kept = flat[i]
            flat[i] = kept + 1e-4
            up, _ = net.gradients(block, label)
            flat[i] = kept - 1e-4
            down, _ = net.gradients(block, label)
            flat[i] = kept
            assert grad[name].reshape(-1)[i] == pytest.approx((up - down) / 2e-4, rel=0.05, abs=1e-5)


def test_language_id(spark, odd):
    sf = "/root/testdata/sf0.01"
    rows = queries.op6_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 100 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97
    told = language_id.op6_language_id(odd).collect()
    assert len(told) == len(ODD) + 1
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in told if r["doc_id"] in (0, 1, 2))
    assert language_id.op6_language_id(odd.limit(0)).count() == 0
    assert language_id.keep_known(odd).columns == odd.columns


# 7


def test_rules_query(spark, sf):
    texts = texts_of(spark, sf)
    for r in queries.op7_quality_rules(spark, sf).collect():
        want = brute.stats(texts[r["doc_id"]])
        assert {k: r[k] for k in want} == want
        assert r["base_failed"] == (want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"])
        assert not (r["base_failed"] and r["kept"])


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t#|", max_size=60), min_size=20, max_size=60))
def test_statistics(spark, made):
    docs = spark.createDataFrame(list(enumerate(made + ODD)), "doc_id bigint, text string")
    for r in quality_rules.with_stats(docs).collect():
        want = brute.stats((made + ODD)[r["doc_id"]])
        assert {k: r[k] for k in want} == want


def test_rules_are_learned_and_applied(spark, odd, labels):
    rows = [dict.fromkeys(quality_rules.FEATURES, 0.1) | {"symbol_rate": 0.9 if i % 4 == 0 else 0.01 * (i % 7), "word_length": float(i % 9), "reject": int(i % 4 == 0), "fold": i % 3} for i in range(300)]
    rules = quality_rules.learn(rows)
    assert [c.feature for c in rules[0]] == ["symbol_rate"]
    assert all(any(quality_rules.covers(x, r) for x in rules) == bool(r["reject"]) for r in rows)
    assert quality_rules.learn([]) == []
    assert quality_rules.op7_quality_rules(odd, labels).count() == len(ODD) + 1
    assert quality_rules.op7_quality_rules(odd.limit(0), labels.limit(0)).count() == 0
    assert quality_rules.keep_good(odd, labels).columns == odd.columns


def test_rules_keep_the_good(spark):
    sf = "/root/testdata/sf0.01"
    told = queries.op7_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").collect()
    assert sum(r["kept"] == bool(r["quality"]) for r in told) / len(told) > 0.97


# 8


def check_packing(docs, rows, capacity):
    pieces, bins = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        bins.setdefault((r["shard"], r["bin"]), []).append(r)
    assert {i: sum(r["piece_length"] for r in x) for i, x in pieces.items()} == {i: n for i, n, *_ in docs}
    about = {i: (s, c) for i, _, s, c in docs}
    for x in bins.values():
        x.sort(key=lambda r: r["bin_offset"])
        assert [r["bin_offset"] for r in x] == [sum(y["piece_length"] for y in x[:k]) for k in range(len(x))]
        assert sum(r["piece_length"] for r in x) <= capacity
        for k in range(2):
            held = [about[r["doc_id"]][k] for r in x if about[r["doc_id"]][k] is not None]
            assert len(held) == len(set(held))


def test_packing_has_no_conflict_and_loses_nothing(spark):
    draw = random.Random(5)
    docs = [(i, draw.choice([0, 5, 40, 99, 100, 101, 250, draw.randrange(90)]), draw.choice(["hot", "a", "b", "c", None, *"defghij"]), draw.choice([None, *range(150)])) for i in range(400)]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id bigint, length int, source string, cluster bigint"), capacity=100, shard=100).collect()
    check_packing(docs, rows, 100)


def best_fit(pieces, capacity):
    """Look at every bin for the tightest that is compatible."""
    bins, out = [], []
    for n, s, c in pieces:
        fits = [(b["left"], i) for i, b in enumerate(bins) if b["left"] >= n and not (b["s"] & s or b["c"] & c)]
        i = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append({"left": capacity, "s": 0, "c": 0})
        out.append((i, capacity - bins[i]["left"]))
        bins[i] = {"left": bins[i]["left"] - n, "s": bins[i]["s"] | s, "c": bins[i]["c"] | c}
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.sampled_from([0, 1, 2, 4, 8]), st.sampled_from([0, 1, 2, 4, 8, 16])), max_size=40))
def test_shards_are_packed_best_fit(pieces):
    pieces.sort(key=lambda x: -x[0])
    assert packing.pack_shard(pieces, 20) == best_fit(pieces, 20)


def test_many_equal_rows_are_dealt_and_packed_fast(spark):
    """100 000 rows of one text and no id: each needs its own bin, and no shard is larger than others."""
    made = spark.range(100_000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(100).alias("length"), F.lit("hot").alias("source"), F.lit(7).alias("cluster"))
    start = time.time()
    rows = packing.pack(made).groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("bin").alias("bins"), F.sum("piece_length").alias("size")).collect()
    assert time.time() - start < 60
    assert sum(r["n"] for r in rows) == sum(r["bins"] for r in rows) == 100_000 and sum(r["size"] for r in rows) == 10_000_000
    assert max(r["n"] for r in rows) < 2 * packing.SHARD
    start = time.time()
    assert [b for b, _ in packing.pack_shard([(5, 1, 0)] * 20_000, 10**9)] == list(range(20_000))
    assert time.time() - start < 10


def test_packing_by_tokens(spark, odd, word_library):
    path = public_tokenizers.path("word_bpe_49k.json")
    want = sum(len(word_library.encode(t or "", add_special_tokens=False).ids) for t in [*ODD, ODD[6]])
    assert sum(r["piece_length"] for r in packing.pack_documents(odd, 100, path).collect()) == want


def test_packing_of_repeated_ids(spark):
    rows = [(1, "a" * 60, "s"), (1, "b" * 60, "s"), (1, "b" * 60, "t"), (None, "c" * 250, None), (1, "a" * 60, None)]
    packed = packing.pack_documents(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), capacity=130).collect()
    assert sum(r["piece_length"] for r in packed) == 490 and len(packed) == 6
    room = Counter()
    for r in packed:
        room[r["shard"], r["bin"]] += r["piece_length"]
    assert max(room.values()) <= 130


def test_packing_odd_rows(odd):
    rows = packing.pack_documents(odd).collect()
    assert len({r["doc_id"] for r in rows}) == len({r["doc_id"] for r in odd.collect()})
    assert sum(r["piece_length"] for r in rows) == sum(len((t or "").encode()) for t in [*ODD, ODD[6]])
    assert packing.pack_documents(odd.limit(0)).count() == 0


# 10


def test_url_query(spark, sf):
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.op10_url_rules(spark, sf).collect()
    assert len(rows) == len(urls)
    for r in rows:
        assert (r["host"], r["path"]) == brute.host_path(urls[r["page_id"]])
        rule, verdict = brute.url_rule(r["host"], r["path"])
        assert r["rule"] == rule and (rule is None or r["verdict"] == verdict)


def page(body, footer=""):
    return f"<p>{body}</p><footer>{footer}</footer>"


def test_mined_verdicts_on_planted_pages(spark):
    """Only promo paths with an aff parameter have bad pages, so the rule has two tokens."""
    pages = [(i, f"http://a{i % 7}.shop.com/promo/{i}?aff={i}", page("best casino and poker bonus")) for i in range(60)]
    pages += [(100 + i, f"http://a{i % 7}.shop.com/promo/{i}?id=1", page("plain words about the weather")) for i in range(60)]
    pages += [(200 + i, f"http://a{i % 7}.shop.com/read/{i}?aff=1", page("plain words about the sea")) for i in range(60)]
    pages += [(1000, "http://new.shop.com/promo/7?aff=9", page("nothing")), (1001, "http://new.shop.com/promo/7", None)]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    told = {r["page_id"]: r["verdict"] for r in url_rules.judge(frame).collect()}
    assert all(v == ("block" if i < 100 or i == 1000 else "allow") for i, v in told.items())
    host, path = url_rules.host_of(F.col("url")), url_rules.path_of(F.col("url"))
    labelled = frame.where("page_id < 1000").select(url_rules.tokens_of(F.col("url"), host, path).alias("tokens"), url_rules.bad_page(F.col("html"), host).alias("bad"))
    assert [r["tokens"] for r in url_rules.mine(labelled).collect()] == [["p:promo", "q:aff"]]


def test_the_host_in_a_text_changes_no_label(spark):
    """Neither the host nor its labels count, wherever they stand; the given pages are labelled alike with and without them."""
    rows = [(page("all about weather", "(c) www.casino-win.com"), "www.casino-win.com"), (page("casino win"), "casino-win.com"), (page("casino win"), "a.com"), (page("Casino-Win.com news"), "casino-win.com"), (page("poker here", "casino.com"), "casino.com")]
    got = [r[0] for r in spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, html string, host string").orderBy("i").select(url_rules.bad_page(F.col("html"), F.col("host"))).collect()]
    assert got == [False, False, True, False, True]
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    host = url_rules.host_of(F.col("url"))
    bare = F.expr("replace(html, host, '')")
    both = pages.withColumn("host", host).select(url_rules.bad_page(F.col("html"), F.col("host")).alias("a"), url_rules.bad_page(bare, F.col("host")).alias("b"))
    assert both.where("a <> b").count() == 0


def test_bad_pages(spark):
    para = "this paragraph is said again and again"
    pages = ["<p>casino</p>", "<script>casino</script> fine", "<style>p{}</style><!-- casino --> fine", "<script>casino", "word " * 9000 + "casino", "Casino " * 3 + "word " * 9000, "<a href='casino'>x</a> and much more text", "", None, "<" * 50_000]
    pages += [f"<p>{para}</p>" * 4, f"<p>{para}</p><p>{para} in other words</p>", "<a href='x'>all of this page is links</a><a>and links</a> x", "<a href='x'>link</a> and a text that is much longer than it", "<a " * 50_000]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(pages)], "i int, h string").orderBy("i").select(url_rules.bad_page(F.col("h"), F.lit("a.com"))).collect()]
    assert got == [True, False, False, False, False, True, False, False, False, False, True, False, True, False, False]


def test_tokens_that_stand_together_are_mined_as_one(spark):
    """A run of 40 shared tokens has 2**40 parts."""
    run = [f"p:{i:02d}" for i in range(40)]
    rows = [([*run, "h:a", "h:b"], True)] * 20 + [([*run, "h:a"], False)] * 30 + [([*run, "h:b"], False)] * 30
    rules = url_rules.mine(spark.createDataFrame([(sorted(t), b) for t, b in rows], "tokens array<string>, bad boolean")).collect()
    assert [(r["tokens"], r["confidence"]) for r in rules] == [(["h:a", "h:b"], 1.0)]


def test_url_odd_rows(spark):
    urls = [None, "", "no scheme", "://", "http://NET/", "http://a.net", "http://x.example.net/en/1?q#f", "http://EXAMPLE.com/de/", "x://y://org/fr/", "http://é.ORG/fr/a\nb", "http://a.net/#?"] * 2
    made = spark.createDataFrame([(None if i == 1 else i, u, None if i == 2 else "<p>casino", "clash", "clash") for i, u in enumerate(urls)], "page_id bigint, url string, html string, host string, tokens string")
    rows = url_rules.op10_url_rules(made).collect()
    assert Counter((r["host"], r["path"], r["rule"]) for r in rows) == Counter((*brute.host_path(u), brute.url_rule(*brute.host_path(u))[0]) for u in urls)
    assert url_rules.op10_url_rules(made.limit(0)).count() == 0


def test_mined_rules_match_like_a_scan(spark):
    rows = [(["h:casino", "h:com", f"p:{i % 5}x"], True) for i in range(40)] + [(["h:com", f"p:{i % 5}x", f"h:{i % 9}q"], False) for i in range(200)]
    labelled = spark.createDataFrame([(sorted(t), b) for t, b in rows], "tokens array<string>, bad boolean")
    rules = url_rules.mine(labelled)
    mined = [(set(r["tokens"]), r["confidence"]) for r in rules.collect()]
    assert mined == [({"h:casino"}, 1.0)]
    hit = {tuple(r["tokens"]) for r in url_rules.match(labelled.select("tokens").distinct(), rules).collect()}
    assert hit == {tuple(sorted(t)) for t, _ in rows if any(m <= set(t) for m, _ in mined)}


def test_rare_bad_host_is_mined(spark):
    rows = [(["h:casino", "h:com"], True)] * 9 + [(["h:com", f"p:{i % 50}x"], False) for i in range(20_000)]
    rules = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean")).collect()
    assert [(r["tokens"], r["confidence"], r["support"]) for r in rules] == [(["h:casino"], 1.0, 9 / 20_009)]


def test_mixed_tokens_block_together(spark):
    rows = [(["h:a", "h:b", "p:c"], True)] * 20 + [(["h:a", "p:c"], False)] * 30 + [(["h:b", "p:c"], False)] * 30 + [(["h:a", "h:b"], False)]
    rules = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean")).collect()
    assert sorted((r["tokens"], r["confidence"]) for r in rules) == [(["h:a", "h:b"], 20 / 21), (["h:a", "h:b", "p:c"], 1.0)]


def test_tokens_of_deep_urls(spark):
    url = "http://a.org/" + "/".join("abcdefgh") + "?" + "&".join(f"{c}=1" for c in "stuvwx")
    made = spark.createDataFrame([(url,)], "url string").select(url_rules.tokens_of(F.col("url"), url_rules.host_of(F.col("url")), url_rules.path_of(F.col("url"))).alias("t"))
    assert made.first()["t"] == sorted(["h:a", "h:org", *(f"p:{c}" for c in "abcdefgh"), *(f"q:{c}" for c in "stuvwx")])
