"""What a review of larger tables found, in small."""

import numpy as np
import pandas as pd

from strataloom.functions import storage
from strataloom.operators import embeddings, matching, retrieval, text
from strataloom.streaming import jobs


def test_references_end_with_a_semicolon():
    cases = {"a&amp": "a&amp", "a&ampb; c": "a&ampb; c", "&lt;b&gt; &copy; &#65;&#x42; &eacute;": "<b> © AB é", "&amp;lt;": "&lt;", "R&D &nosuch; &": "R&D &nosuch; &"}
    assert {k: text.visible_text(k) for k in cases} == cases


def plan(df):
    return df._jdf.queryExecution().toString()


def test_nearest_rows_without_copies_of_rows(spark, monkeypatch):
    """Several blocks of queries, equal vectors, several dimensions; neither side is written once for each block of the other."""
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 16)
    draw = np.random.default_rng(5)
    vectors = [v.tolist() for v in draw.integers(-2, 3, (300, 3)).astype(float)] + [v.tolist() for v in draw.normal(size=(60, 5))]
    rows = spark.createDataFrame([(f"r{i}", v) for i, v in enumerate(vectors)], "id string, vector array<double>")
    asked = rows.selectExpr("id AS query", "vector AS qv", "id AS skip").where("substring(id, -1) IN ('0', '3', '7')")
    found = retrieval.vec_topk(asked, rows, 7)
    assert "sequence(" not in plan(found) and "CartesianProduct" in plan(found)
    want = set()
    for i, a in enumerate(map(np.array, vectors)):
        if str(i)[-1] in "037" and a @ a:
            same = [(j, np.array(b)) for j, b in enumerate(vectors) if j != i and len(b) == len(a) and np.array(b) @ np.array(b)]
            sims = [(-np.floor(a @ b / np.sqrt((a @ a) * (b @ b)) * 1e6 + 0.5) / 1e6, f"r{j}") for j, b in same]
            want |= {(f"r{i}", name, round(-s, 6), rank) for rank, (s, name) in enumerate(sorted(sims)[:7], 1)}
    assert {(r["query"], r["id"], round(r["sim"], 6), r["rank"]) for r in found.collect()} == want


def concepts(spark, n):
    """Questions that each hold the name of one of n concepts, and a definition that all share."""
    named = spark.range(n).selectExpr("id AS iri", "concat('name', id, ' of') AS label", "concat('x', id) AS alt", "'common thing' AS definition")
    return spark.range(4 * n).selectExpr("id AS query", f"concat('how is Name', id % {n}, ' of the common thing') AS question"), named


def test_scores_of_concepts_join_no_texts(spark):
    """Texts were joined to their parts, which broadcasts took to the driver (token_overlap_score, concept_keyword)."""
    asked, named = concepts(spark, 12)
    for least, some in ((0.0, 48 * 12), (0.42, 48 * 12), (0.9, 48)):
        found = retrieval.scored_concepts(asked, named, least)
        assert "HashJoin" not in plan(found) and "SortMergeJoin" not in plan(found)
        got = {(r["query"], r["iri"]): r["score"] for r in found.collect()}
        assert {k for k, v in got.items() if v == 1.0} == {(q, q % 12) for q in range(48)}
        assert len(got) == some and set(got.values()) <= {1.0, 0.88}


def test_contained_concepts_join_no_texts(spark):
    """The same of concept_substring."""
    asked, named = concepts(spark, 12)
    found = retrieval.substring_concepts(asked, named)
    assert "HashJoin" not in plan(found) and "SortMergeJoin" not in plan(found)
    got = {(r["query"], r["iri"]): r["score"] for r in found.collect()}
    assert len(got) == 48 * 12 and {k for k, v in got.items() if v != 0.35} == {(q, q % 12) for q in range(48)}


def test_merged_candidates_join_nothing(spark):
    """Pairs were joined to pairs, which broadcasts took to the driver (concept_merge)."""
    sure = spark.createDataFrame([(1, 1, 0.35), (1, 2, 0.9)], "query int, iri int, score double")
    other = spark.createDataFrame([(1, 1, 0.8), (1, 3, 0.5), (1, 3, 0.6), (2, 1, 0.41)], "query int, iri int, score double")
    found = retrieval.merge_candidates(sure, [other])
    assert "Join" not in plan(found)
    assert sorted(map(tuple, found.collect())) == [(1, 1, 0.35), (1, 2, 0.9), (1, 3, 0.6)]


def test_keyword_search_shuffles_no_words(spark, monkeypatch):
    """Several blocks of queries, terms that repeat or are nowhere, equal scores; words and pairs went through joins before."""
    monkeypatch.setattr(retrieval, "HELD", 7)
    draw = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in draw.integers(0, 9, draw.integers(0, 12))) for _ in range(200)]
    docs = spark.createDataFrame([*enumerate(texts), (200, None), (201, " ,; ")], "id int, text string")
    asked = [f"W{a} w{b}, w{a}" for a in range(9) for b in range(9)] + ["w1 nowhere", "", None]
    found = retrieval.kw_search(spark.createDataFrame(list(enumerate(asked)), "query int, question string"), docs, "id", "text", 4)
    assert "HashJoin" not in plan(found) and "SortMergeJoin" not in plan(found)
    want = set()
    for q, question in enumerate(asked[:81]):
        terms = {f"w{q // 9}", f"w{q % 9}"}
        held = [(d, x.split()) for d, x in enumerate(texts) if terms <= set(x.split())]
        scores = sorted((-np.floor(sum(x.count(t) for t in terms) / len(x) * 1e6 + 0.5) / 1e6, d) for d, x in held)
        want |= {(q, d, round(-s, 6), rank) for rank, (s, d) in enumerate(scores[:4], 1)}
    assert {(r["query"], r["id"], round(r["score"], 6), r["rank"]) for r in found.collect()} == want


def test_matches_without_copies_for_each_ball(spark, monkeypatch):
    """Random directions: every row may lie near every ball, and was written once for each before; several blocks and many groups."""
    monkeypatch.setattr(matching, "QUERY_BLOCK", 32)
    monkeypatch.setattr(matching, "BLOCK", 40)
    monkeypatch.setattr(matching, "_GROUPS", 3)
    vectors = np.random.default_rng(8).normal(size=(150, 6))
    vectors[7] = vectors[3]
    frame = spark.createDataFrame([(i, f"g{i % 5}", v.tolist()) for i, v in enumerate(vectors)], "id bigint, grp string, vector array<double>")
    assert "CartesianProduct" in plan(matching.candidates(frame, frame, 0.3, 6)) and "CoGroup" not in plan(matching.candidates(frame, frame, 0.3, 6))
    length = np.sqrt((vectors**2).sum(axis=1))
    sims = np.floor(vectors @ vectors.T / np.outer(length, length) * 1e6 + 0.5) / 1e6
    want = {(i, f"g{g}"): min((-sims[i, j], j) for j in range(g, 150, 5)) for i in range(150) for g in range(5) if g != i % 5}
    want = {k: (round(-s, 6), j) for k, (s, j) in want.items() if -s >= 0.3}
    found = matching.match(frame, frame, 0.9, 0.3, by_target=True, pivots=6)
    assert {(r["id"], r["target"]): (round(r["sim"], 6), r["other"]) for r in found.collect()} == want


def test_training_keeps_the_last_vectors_only(spark, tmp_path, monkeypatch):
    """Each round of each epoch left a table of all vectors on disk."""
    monkeypatch.setattr(storage, "shared_folder", lambda _: f"file://{tmp_path}")
    kg = spark.createDataFrame([(f"a{i}", f"p{i % 2}", f"b{i % 5}", True) for i in range(40)], "s string, p string, o string, iri boolean")
    made = embeddings.transe_fit(kg, dimensions=4, epochs=2, buckets=3)
    assert made.count() == 40 + 5 + 2
    left = [x.name for x in tmp_path.iterdir()]
    assert sum(x.startswith(("vectors-", "trained-")) for x in left) == 1, left


def test_new_keys_ask_their_state_nothing():
    """Each question to the state is a round trip to Spark; a key that is new has none (st_triples_clean)."""

    class Empty:
        def exists(self):
            return False

        def update(self, value):
            pass

        def updateValue(self, key, value):
            pass

    work = jobs.Fused(None)
    work.winner = work.objects = work.seen = Empty()  # containsKey and getValue are not there
    rows = pd.DataFrame({"o": ["x", "y", "x"], "source": ["1", "1", "2"], "confidence": [50.0, 90.0, 50.0]})
    told = next(work.handleInputRows(("s", "p"), iter([rows]), None))
    assert told.values.tolist() == [["s", "p", "object", "x", 75.0, 2], ["s", "p", "object", "y", 90.0, 1], ["s", "p", "winner", "x", 75.0, 2]]
