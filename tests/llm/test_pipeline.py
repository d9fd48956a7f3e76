"""The pipeline's stages, one after the other, against what each is to decide."""

import brute
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from strataloom.llm import simhash


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "language ID", "SimHash near-dedup", "PII", "best-fit packing"]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        source = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        rows = docs.collect()
        if name != "best-fit packing":
            assert docs.columns == columns and len(rows) <= before
            before = len(rows)
        if name == "quality rules":
            for r in source.values():
                s = brute.stats(r["text"])
                failed = s["n_words"] < 50 or 100 * s["n_repeat_words"] > 50 * s["n_words"]
                assert not failed or r["doc_id"] not in {x["doc_id"] for x in rows}
        if name in ("quality rules", "language ID", "SimHash near-dedup"):
            assert all(r == source[r["doc_id"]] for r in rows)
        if name == "SimHash near-dedup":
            linked = {r["doc_id"]: r["component_id"] for r in simhash.op1_simhash(spark.createDataFrame(list(source.values()), docs.schema)).collect()}
            assert {r["doc_id"] for r in rows} == set(linked.values()) and len(rows) < len(source)
        if name == "PII":
            assert len(rows) == len(source)
            for r in rows:
                assert not brute.base_spans(r["text"])
                if not brute.base_spans(source[r["doc_id"]]["text"]) and "[" not in r["text"]:
                    assert r["text"] == source[r["doc_id"]]["text"]
        if name == "best-fit packing":
            library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            sizes = {i: len(library.encode(x["text"], add_special_tokens=False).ids) for i, x in source.items()}
            found = dict.fromkeys(sizes, 0)
            for r in rows:
                found[r["doc_id"]] += r["piece_length"]
            assert found == sizes
    assert rows


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_only_linked_rows_go(spark):
    words = [" ".join(f"{w}{i}" for i in range(60)) for w in ("ant", "bee", "cat", "dog", "elk")]
    # a copy of text 0 shares an id with the unique text 1; texts 2 and 3 have no id, 2 is there twice
    rows = [(1, words[0]), (2, words[0]), (2, words[1]), (None, words[2]), (None, words[2]), (None, words[3]), (None, words[0]), (3, words[4]), (3, words[4])]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").collect()
    assert sorted((r["text"], r["doc_id"]) for r in kept) == [(words[0], 1), (words[1], 2), (words[2], None), (words[3], None), (words[4], 3)]
