"""Vector and keyword retrieval, rank fusion and evidence scoring for many queries at once."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions.binding import rows_of
from strataloom.functions.numbers import rounded
from strataloom.functions.pairs import PACK, meet
from strataloom.functions.storage import materialise
from strataloom.operators.text import embed_hash

#: Rows and queries that are compared at once.
ROW_BLOCK, QUERY_BLOCK = 2048, 512
RRF = 60
#: What the share of a name's tokens counts.
TOKEN_WEIGHT = 0.55


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def best(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark limits each partition before the shuffle."""
    return ranked(df, by, order, name).where(F.col(name) <= k)


def _first(names: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest values, of equal ones those of the smaller names."""
    if len(values) > k:
        edge = np.partition(values, -k)[-k]
        where = np.flatnonzero(values >= edge)
    else:
        where = np.arange(len(values))
    where = where[values[where] > -np.inf]
    return where[np.lexsort((names[where], -values[where]))][:k]


class Best:
    """The k best names of each of n queries, out of what has been added; of equal scores the smaller names."""

    def __init__(self, n: int, k: int):
        self.k, self.cut = k, np.full(n, -np.inf)  # no name below its query's cut can be among the best
        self.kept, self.new, self.waiting = (np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0)), [], 0

    def add(self, query: np.ndarray, names: np.ndarray, scores: np.ndarray) -> None:
        if len(query):
            self.new.append((query, names, scores))
            self.waiting += len(query)
            if self.waiting > max(1 << 17, len(self.kept[0])):
                self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, name, score) of the best, in order."""
        if self.new:
            kinds = [part for part in (self.kept, *self.new) if len(part[0])]
            query, names, scores = (np.concatenate(x) for x in zip(*kinds, strict=True))
            self.new, self.waiting = [], 0
            code = np.unique(names, return_inverse=True)[1] if names.dtype == object else names
            order = np.lexsort((-scores, code, query))
            query, names, scores, code = query[order], names[order], scores[order], code[order]
            once = np.r_[True, (query[1:] != query[:-1]) | (code[1:] != code[:-1])]
            query, names, scores, code = query[once], names[once], scores[once], code[once]
            order = np.lexsort((code, -scores, query))
            query, names, scores = query[order], names[order], scores[order]
            start = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
            place = np.arange(len(query)) - np.repeat(start, np.diff(np.r_[start, len(query)]))
            self.kept = tuple(x[place < self.k] for x in (query, names, scores))
            full = place == self.k - 1
            self.cut[query[full]] = np.maximum(self.cut[query[full]], scores[full])
        return self.kept


#: Queries that a task holds at most, the hits that it keeps for them, and queries that meet rows in one product.
HELD, HITS, STRIP = 16_384, 400_000, 256


def matrices(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, vectors, lengths) of the vectors of each dimension, without those that have no length."""
    sizes = np.diff(column.offsets.to_numpy())
    values, starts = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.r_[0, np.cumsum(sizes)]
    for d in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == d)
        m = values[starts[at][:, None] + np.arange(d)] if len(at) < len(sizes) else values.reshape(-1, d)
        length = np.sqrt((m * m).sum(axis=1))
        sound = length > 0
        yield at[sound], m[sound], length[sound]


def _rounded(products: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.floor(products / lengths * 1e6 + 0.5) / 1e6


def _compared(k: int, by: str, apart: str | None):
    """The k most similar names of all rows for each query of a block."""

    def run(block: pa.RecordBatch, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = block.column("query")
        told = lambda batch, c: batch.column(c).to_numpy(zero_copy_only=False)
        sides = {m.shape[1]: (at, m, length, (m / length[:, None]).astype(np.float32)) for at, m, length in matrices(block.column("qv"))}
        barred = [(told(block, "skip"), "id")] if "skip" in block.schema.names else []
        barred += [(told(block, apart), apart)] if apart else []
        best = Best(len(queries), k)
        for batch in batches:
            names = told(batch, by)
            others = [(mine, told(batch, c)) for mine, c in barred]
            for rows, b, lb in matrices(batch.column("vector")):
                if b.shape[1] not in sides:
                    continue
                asked, a, la, a32 = sides[b.shape[1]]
                margin = (b.shape[1] + 8) * 2.4e-7 + 1e-6  # of products in single precision, and of rounding
                b32 = (b / lb[:, None]).astype(np.float32)
                for i in range(0, len(a), STRIP):
                    some = asked[i : i + STRIP]
                    for j in range(0, len(b), ROW_BLOCK):
                        part = rows[j : j + ROW_BLOCK]
                        cut = best.cut[some]
                        fresh = cut == -np.inf
                        if fresh.any():
                            f = np.flatnonzero(fresh)
                            sims = _rounded(a[i + f] @ b[j : j + ROW_BLOCK].T, la[i + f][:, None] * lb[None, j : j + ROW_BLOCK])
                            for mine, theirs in others:
                                sims[mine[some[f]][:, None] == theirs[part][None, :]] = -np.inf
                            order = np.argsort(names[part], kind="stable")
                            starts = np.flatnonzero(np.r_[True, names[part][order][1:] != names[part][order][:-1]])
                            sims = np.maximum.reduceat(sims[:, order], starts, axis=1)  # of rows of one name the best
                            edge = np.partition(sims, -k, axis=1)[:, -k] if sims.shape[1] > k else np.full(len(f), -np.inf)
                            q, r = np.nonzero((sims >= edge[:, None]) & (sims > -np.inf))
                            best.add(some[f[q]], names[part][order][starts[r]], sims[q, r])
                            best.cut[some[f]] = edge
                            cut = np.where(fresh, np.inf, cut)
                            if fresh.all():
                                continue
                        q, r = np.nonzero(a32[i : i + STRIP] @ b32[j : j + ROW_BLOCK].T >= (cut - margin).astype(np.float32)[:, None])
                        for mine, theirs in others:
                            free = mine[some[q]] != theirs[part[r]]
                            q, r = q[free], r[free]
                        sims = _rounded((a[i + q] * b[j + r]).sum(axis=1), la[i + q] * lb[j + r])
                        near = sims >= cut[q]
                        best.add(some[q[near]], names[part[r[near]]], sims[near])
        query, name, sim = best.settle()
        kinds = [block.schema.field("query").type, batch.schema.field(by).type]
        for i in range(0, len(query), PACK):
            part = slice(i, i + PACK)
            yield pa.RecordBatch.from_arrays([queries.take(pa.array(query[part])), pa.array(name[part].tolist(), kinds[1]), pa.array(sim[part])], names=["query", by, "sim"])

    return run


def nearest(queries: DataFrame, rows: DataFrame, k: int, by: str = "id", apart: str | None = None) -> DataFrame:
    """(query, by, sim): cosine similarity to six digits of at least the k nearest rows of each query.

    queries (query, qv), rows (id, vector); with `by` the rows of a name count as one; a query meets neither the id in
    its column `skip`, if it has one, nor rows with its own value of `apart`. Every query meets every row: blocks of queries
    stay with tasks that all rows stream past, in products of single precision; what may be among the k best is compared
    exactly. Vectors without length take no part; only vectors of equal dimension are compared.
    """
    extra = [apart] if apart else []
    vector = lambda c: F.col(c).cast("array<double>").alias(c)
    q = queries.select("query", vector("qv"), *extra, *(c for c in ("skip",) if c in queries.columns)).where("qv IS NOT NULL")
    r = rows.select("id", vector("vector"), *extra, *(c for c in (by,) if c != "id")).where("vector IS NOT NULL")
    kinds = {"query": queries.schema["query"].dataType.simpleString(), by: rows.schema[by].dataType.simpleString()}
    schema = ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", sim double"
    cores = queries.sparkSession.sparkContext.defaultParallelism
    size = min(HELD, max(1, HITS // k), max(QUERY_BLOCK, -(-q.count() // (2 * cores))))
    return meet(q, r, size, _compared(k, by, apart), schema)


def vec_topk(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query, id, sim, rank): exact nearest rows; ties to the smaller id."""
    return best(nearest(queries, rows, k), ["query"], [F.desc("sim"), F.asc("id")], k)


def vec_topk_dedup(queries: DataFrame, rows: DataFrame, refs: DataFrame, k: int) -> DataFrame:
    """Nearest hit of each referenced object, then the k best; refs (id, ref)."""
    hits = nearest(queries, rows.join(refs, "id"), k, "ref").groupBy("query", "ref").agg(F.max("sim").alias("sim"))
    return best(hits, ["query"], [F.desc("sim"), F.asc("ref")], k)


def _signed(dimensions: int, signs: int, seed: int):
    """Which sides of random planes through the origin a matrix of vectors lies on, as booleans."""
    planes = np.random.default_rng(seed).normal(size=(dimensions, signs))
    return lambda vectors: np.array(vectors.tolist(), dtype=np.float64) @ planes >= 0


def _copies(least: float):
    """Ids of rows that are near a smaller id of the same part; parts come sorted, their members (asks 0) first."""

    def near(asking: pd.DataFrame, ids: np.ndarray, unit: np.ndarray) -> list:
        found = []
        for i in range(0, len(asking), ROW_BLOCK):
            part = asking.iloc[i : i + ROW_BLOCK]
            a = np.array(part["vector"].tolist(), dtype=np.float64)
            sims = a / np.sqrt((a * a).sum(axis=1))[:, None] @ unit.T
            found += part["id"].to_numpy()[((sims >= least) & (ids[None, :] < part["id"].to_numpy()[:, None])).any(axis=1)].tolist()
        return found

    def run(frames):
        name, ids, unit = None, None, None
        for f in frames:
            out = []
            for key, part in f.groupby(["bucket", "part"], sort=False):
                members = part[part["asks"] == 0]
                if len(members):
                    m = np.array(members["vector"].tolist(), dtype=np.float64)
                    m /= np.sqrt((m * m).sum(axis=1))[:, None]
                    more = members["id"].to_numpy()
                    # ids ascend, so those that came with an earlier batch are smaller
                    ids, unit = (np.concatenate([ids, more]), np.concatenate([unit, m])) if key == name else (more, m)
                elif key != name:
                    continue
                name = key
                out += near(part, ids, unit)
            yield pd.DataFrame({"id": out})

    return run


def near_duplicates_by_vector(rows: DataFrame, dimensions: int, least: float = 0.97, miss: float = 1e-6, seed: int = 9) -> DataFrame:
    """Rows (id, vector) without those that are as similar as `least` to a row with a smaller id.

    Of equal vectors the smallest id stays. The others are dealt to buckets by signs against random planes: as many
    signs as leave a few rows in a bucket, and as many tables as miss a pair at the threshold with a probability of
    `miss`, which is the share of such pairs that may be lost. A large bucket is cut into parts, and each of its rows
    asks every part. Rows without length stay.
    """
    sound = rows.where((F.size("vector") == dimensions) & (norm("vector") > 0)).select("id", "vector")
    once = materialise(sound.groupBy("vector").agg(F.min("id").alias("id")), "vectors")
    n = once.count()
    bits = min(26, max(4, math.ceil(math.log2(max(n, 1) / 8))))
    agree = (1 - math.acos(least) / math.pi) ** bits
    tables = math.ceil(math.log(miss) / math.log(1 - agree))

    def dealt(frames):
        signs, weight = _signed(dimensions, tables * bits, seed), 1 << np.arange(bits, dtype=np.int64)
        for f in frames:
            name = signs(f["vector"]).reshape(-1, tables, bits) @ weight + (np.arange(tables, dtype=np.int64) << 32)
            yield f.assign(buckets=name.tolist())

    kind = rows.schema["id"].dataType.simpleString()
    spread = once.select("id", "vector").mapInPandas(dealt, f"id {kind}, vector {rows.schema['vector'].dataType.simpleString()}, buckets array<bigint>").select("id", "vector", F.explode("buckets").alias("bucket"))
    spread = materialise(spread, "buckets")
    busy = materialise(spread.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "busy")
    parts = F.ceil(F.col("n") / ROW_BLOCK).cast("int")
    held = spread.join(busy, "bucket").select("id", "vector", "bucket", parts.alias("parts"), F.pmod(F.xxhash64("id"), parts).cast("int").alias("own"))
    asking = held.select("id", "vector", "bucket", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    asking = asking.select("id", "vector", "bucket", "part", (F.col("part") != F.col("own")).cast("int").alias("asks"))
    copies = asking.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "asks", "id").mapInPandas(_copies(least), f"id {kind}")
    lost = copies.unionByName(sound.select("id").join(once.select("id"), "id", "left_anti")).distinct()
    return rows.join(lost, "id", "left_anti")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0))


#: Distinct words of all questions up to which others are left out as documents are read; with more, none are.
WORDS_ASKED = 200_000


def _counted(asked: list[str] | None):
    """(key, length, terms, tfs): the words of documents (key, w) that are asked for, or all, once each with their counts; documents without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if asked is None else pa.array(asked, pa.string())
        for batch in (b.slice(i, QUERY_BLOCK) for b in batches for i in range(0, b.num_rows, QUERY_BLOCK)):
            words = batch.column(1)
            sizes = np.diff(words.offsets.to_numpy())
            coded = words.flatten().dictionary_encode()
            if not len(coded):
                continue
            index, n = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
            code = np.repeat(np.arange(len(sizes)), sizes) * n + index
            if wanted is not None:
                code = code[pc.is_in(coded.dictionary, value_set=wanted).to_numpy(zero_copy_only=False)[index]]
            code, tf = np.unique(code, return_counts=True)
            each = np.bincount(code // n, minlength=len(sizes))
            some = np.flatnonzero(each)
            offsets = pa.array(np.r_[0, np.cumsum(each[some])].astype(np.int32))
            told = [pa.ListArray.from_arrays(offsets, x) for x in (coded.dictionary.take(pa.array(code % n)), pa.array(tf.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), pa.array(sizes[some].astype(np.int32)), *told], names=["key", "length", "terms", "tfs"])

    return run


def _keyword_hits(k: int):
    """Of each block of queries (query, terms) the k documents that score best and hold all terms; queries of equal terms count as one."""

    def run(block: pa.RecordBatch, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, asked = block.column("query"), block.column("terms")
        coded, ends = asked.flatten().dictionary_encode(), np.r_[0, np.cumsum(np.diff(asked.offsets.to_numpy()))]
        codes, words, same = coded.indices.to_numpy(), coded.dictionary, {}
        for i in range(len(queries)):
            same.setdefault(tuple(sorted(codes[ends[i] : ends[i + 1]].tolist())), []).append(i)
        sets = list(same)
        terms, starts = np.concatenate([np.array(x) for x in sets]), np.r_[0, np.cumsum([len(x) for x in sets])[:-1]]
        best = Best(len(sets), k)
        for batch in batches:
            names, length = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "length"))
            column = batch.column("terms")
            held = column.flatten().dictionary_encode()
            term = pc.fill_null(pc.index_in(held.dictionary, value_set=words), -1).to_numpy()[held.indices.to_numpy()]
            docs, tf = np.repeat(np.arange(len(names)), np.diff(column.offsets.to_numpy())), batch.column("tfs").flatten().to_numpy()
            order = np.argsort(term, kind="stable")
            term, docs, tf = term[order], docs[order], tf[order].astype(np.int64)
            first = np.searchsorted(term, np.arange(len(words) + 1))
            count = np.diff(first)
            for s in np.flatnonzero(np.minimum.reduceat(count[terms], starts)).tolist():
                rare, *rest = sorted(sets[s], key=count.__getitem__)
                at, total = docs[first[rare] : first[rare + 1]], tf[first[rare] : first[rare + 1]]
                for t in rest:
                    theirs = docs[first[t] : first[t + 1]]
                    place = np.minimum(np.searchsorted(theirs, at), len(theirs) - 1)
                    both = theirs[place] == at
                    at, total = at[both], total[both] + tf[first[t] : first[t + 1]][place[both]]
                scores = np.floor(total / length[at] * 1e6 + 0.5) / 1e6
                if len(at) > k:
                    best.cut[s] = max(best.cut[s], np.partition(scores, -k)[-k])
                near = scores >= best.cut[s]
                best.add(np.full(np.count_nonzero(near), s), names[at[near]], scores[near])
        which, name, score = best.settle()
        ends = np.searchsorted(which, np.arange(len(sets) + 1))
        for s, members in enumerate(same.values()):
            part = slice(ends[s], ends[s + 1])
            told = pa.array(name[part].tolist(), batch.schema.field("key").type)
            for i in members if len(told) else ():
                yield pa.RecordBatch.from_arrays([queries.take(pa.array([i] * len(told))), told, pa.array(score[part])], names=["query", "key", "score"])

    return run


def kw_search(queries: DataFrame, docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """Documents that hold every term of a query, by their share of the words; queries (query, question).

    Documents are reduced to the words that are asked for, with their counts, where they are read, and stream past blocks
    of queries; only the best of a block go on, so neither words nor pairs of queries and documents are shuffled.
    """
    asked = queries.select("query", F.array_distinct(tokens(F.col("question"))).alias("terms")).where(F.size("terms") > 0)
    asked = materialise(asked, "terms")
    words = [r["term"] for r in asked.select(F.explode("terms").alias("term")).distinct().limit(WORDS_ASKED + 1).collect()]
    kinds = {"query": queries.schema["query"].dataType.simpleString(), "key": docs.schema[key].dataType.simpleString()}
    split = docs.select(F.col(key).alias("key"), tokens(F.col(text)).alias("w"))
    counted = split.mapInArrow(_counted(words if len(words) <= WORDS_ASKED else None), f"key {kinds['key']}, length int, terms array<string>, tfs array<int>")
    found = meet(asked, counted, min(HELD, max(1, HITS // k)), _keyword_hits(k), f"query {kinds['query']}, key {kinds['key']}, score double", spread=True)
    return best(found.withColumnRenamed("key", key), ["query"], [F.desc("score"), F.asc(key)], k)


def rrf_fuse(rankings: list[DataFrame], key: str, k: int, constant: int = RRF) -> DataFrame:
    """Sum of 1 / (constant + rank) over lists (query, key, rank from 1)."""
    parts = [r.select("query", key, (1.0 / (constant + F.col("rank"))).alias("part")) for r in rankings]
    fused = reduce(DataFrame.unionByName, parts).groupBy("query", key).agg(rounded(F.sum("part"), 8).alias("score"))
    return best(fused, ["query"], [F.desc("score"), F.asc(key)], k)


def hybrid(vector: DataFrame, keyword: DataFrame, key: str, group: DataFrame | None, group_key: str, k: int) -> DataFrame:
    """Fused hits with both scores (similarity and keyword score, 0 where absent), the best of each group, k of them."""
    vector, keyword = materialise(vector, "vector"), materialise(keyword, "keyword")  # each is read twice
    fused = rrf_fuse([vector, keyword], key, 4 * k).drop("rank")
    out = fused.join(vector.select("query", key, "sim"), ["query", key], "left").join(keyword.select("query", key, F.col("score").alias("kw")), ["query", key], "left").fillna(0.0, ["sim", "kw"])
    if group is not None:
        out = best(out.join(group, key), ["query", group_key], [F.desc("score"), F.asc(key)], 1, "one").drop("one")
    return best(out, ["query"], [F.desc("score"), F.asc(key)], k)


#: Words that hint at the role of what is asked for, fixed values.
ROLE_HINTS = {"join_guide": r"join|关联|连接|left\s+join|inner\s+join", "business_metric": "指标|口径|gmv|营收|转化|客单价|复购|留存", "column_glossary": "字段|列名|含义|字典", "query_pattern": "sql|查询|示例|怎么查"}


def role_hints(question: Column) -> Column:
    return F.array_sort(F.array_compact(F.array(*(F.when(question.rlike(f"(?i){p}"), r) for r, p in ROLE_HINTS.items()))))


def name_tokens(text: Column) -> Column:
    """ASCII words and single CJK characters of a text, once each."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.trim(text)), F.lit("[a-z0-9_]+|[\\u4e00-\\u9fff]"), F.lit(0)))


def _low(c: str) -> Column:
    return F.lower(F.trim(F.col(c)))


def _automaton(names: list[dict]) -> ahocorasick.Automaton | None:
    """Finds all names of dictionaries name -> concepts in a text; it holds the places of these in each dictionary."""
    made = ahocorasick.Automaton()
    for key in dict.fromkeys(chain(*names)):
        made.add_word(key, tuple(np.array(x.get(key, ()), np.int64) for x in names))
    made.make_automaton()
    return made if len(made) else None


def _hits(automaton: ahocorasick.Automaton | None, asked: str) -> Iterator[tuple]:
    """What the automaton holds for each name in a text, once."""
    return {id(x): x for _, x in automaton.iter(asked)}.values() if automaton and asked else ()


def _pairs(score):
    """(query, iri, score) of the places and scores that score(concepts) tells for each question of a batch."""

    def run(block: pa.RecordBatch, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored, iris = score(block.to_pydict()), block.column("iri")
        for batch in batches:
            found, n = [], 0
            queries, questions = batch.column("query"), zip(*(batch.column(c).to_pylist() for c in batch.schema.names if c != "query"), strict=True)
            for i, question in enumerate(questions):
                at, scores = scored(*question)
                if len(at):
                    found.append((np.full(len(at), i), at, scores))
                    n += len(at)
                if found and (n >= HITS or i + 1 == batch.num_rows):
                    q, at, scores = (np.concatenate(x) for x in zip(*found, strict=True))
                    found, n = [], 0
                    for j in range(0, len(q), PACK):
                        part = slice(j, j + PACK)
                        yield pa.RecordBatch.from_arrays([queries.take(pa.array(q[part])), iris.take(pa.array(at[part])), pa.array(scores[part])], names=["query", "iri", "score"])

    return run


def _meet_concepts(questions: DataFrame, concepts: DataFrame, score) -> DataFrame:
    """Blocks of LABEL_BLOCK concepts become automata in tasks, and all questions pass by each."""
    kinds = [f"{c} {df.schema[c].dataType.simpleString()}" for c, df in (("query", questions), ("iri", concepts))]
    return meet(concepts, questions, LABEL_BLOCK, _pairs(score), ", ".join([*kinds, "score double"]))


def _scored(least: float):
    """1 if a name occurs in the question, 0.88 if its definition does, else TOKEN_WEIGHT of the share of its tokens.

    Of n tokens m must be there for the least score, so one of any n - m + 1 is: only the rarest of a label are looked up.
    """
    share = max(0.0, (least - 1e-6) / TOKEN_WEIGHT)  # a score is rounded to six digits, hence the margin

    def build(concepts: dict):
        labels: dict[str, list] = {}
        meanings: dict[str, list] = {}
        held = [frozenset(x or ()) for x in concepts["tokens"]]
        common = Counter(chain(*held))
        by_token: dict[str, list] = {}
        for i, (label, meaning) in enumerate(zip(concepts["label"], concepts["meaning"], strict=True)):
            if label == "":
                continue
            if label is not None:
                labels.setdefault(label, []).append(i)
            if len(meaning) >= 2:
                meanings.setdefault(meaning, []).append(i)
            must = max(1, math.ceil(len(held[i]) * share))
            for token in sorted(held[i], key=lambda t: (common[t], t))[: max(0, len(held[i]) - must + 1)]:
                by_token.setdefault(token, []).append(i)
        places = {t: np.array(x, np.int64) for t, x in by_token.items()}
        sizes, scores, automaton = np.array([len(x) for x in held], float), np.zeros(len(held)), _automaton([labels, meanings])

        def scored(asked: str | None, tokens: list[str] | None) -> tuple[np.ndarray, np.ndarray]:
            if not asked:
                return np.zeros(0, np.int64), np.zeros(0)
            looked = [places[t] for t in tokens or () if t in places]
            if looked:
                at, count = np.unique(np.concatenate(looked), return_counts=True)
                if share:
                    mine = frozenset(tokens)
                    count = np.array([len(held[i] & mine) for i in at.tolist()])
                scores[at] = np.floor(count / sizes[at] * TOKEN_WEIGHT * 1e6 + 0.5) / 1e6
            hits = _hits(automaton, asked)
            for _, defined in hits:
                scores[defined] = 0.88
            for named, _ in hits:
                scores[named] = 1.0
            found = np.flatnonzero((scores > 0) & (scores >= least))
            told = scores[found]
            scores[:] = 0
            return found, told

        return scored

    return build


def scored_concepts(questions: DataFrame, named: DataFrame, least: float = 0.0) -> DataFrame:
    """(query, iri, score) of all that score more than 0, and `least` or more; named (iri, label, definition), iri unique.

    Case and blanks around names and questions are ignored. Names are met by automata, tokens by lists of the labels that bear them.
    """
    concepts = named.select("iri", _low("label").alias("label"), F.coalesce(_low("definition"), F.lit("")).alias("meaning"), name_tokens(F.col("label")).alias("tokens"))
    return _meet_concepts(questions.select("query", _low("question").alias("asked"), name_tokens(F.col("question")).alias("tokens")), concepts, _scored(least))


def _contained(concepts: dict):
    """The value of a concept whose label stands in the question, 0.35 if only another of its names does."""
    found: dict[str, list] = {}
    for i, names in enumerate(concepts["names"]):
        for name in names:
            found.setdefault(name, []).append(i)
    automaton, labels, values = _automaton([found]), concepts["label"], concepts["value"]

    def scored(asked: str | None, question: str | None) -> tuple[np.ndarray, np.ndarray]:
        hits = [at for (at,) in _hits(automaton, asked)]
        at = np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.int64)
        return at, np.array([values[i] if labels[i] is not None and labels[i] in question else 0.35 for i in at.tolist()])

    return scored


def substring_concepts(questions: DataFrame, named: DataFrame) -> DataFrame:
    """(query, iri, score) of concepts whose label, alternative label or definition occurs in the question; iri unique."""
    names = [F.when(F.length(F.trim(F.col(c))) >= least, _low(c)) for c, least in (("label", 2), ("alt", 2), ("definition", 4))]
    value = F.least(F.lit(1.0), rounded(0.60 + 0.04 * F.length("label"), 4))
    concepts = named.select("iri", F.array_distinct(F.array_compact(F.array(*names))).alias("names"), F.lower("label").alias("label"), value.alias("value"))
    return _meet_concepts(questions.select("query", _low("question").alias("asked"), F.lower("question").alias("question")), concepts, _contained)


def concept_index(concepts: DataFrame, dimensions: int = 64) -> DataFrame:
    """(base, ref_id, content, embedding) of concepts (base, iri, kind, label, definition, formula, caliber).

    Concepts without iri or label are left out; the embedding is that of the text below the header. ref_id is the
    first half of the iri's SHA-256 modulo 2^31 - 1.
    """
    there = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    body = F.array_join(F.filter(F.array("label", "definition", "formula", "caliber", "kind"), there), "；")
    number = F.conv(F.substring(F.sha2("iri", 256), 1, 16), 16, 10).cast("decimal(20,0)") % (2**31 - 1)
    rows = concepts.where(there(F.col("iri")) & there(F.col("label"))).select("base", "iri", "kind", F.trim("label").alias("label"), "definition", "formula", "caliber").withColumn("body", body)
    head = F.concat(F.lit("kb_id:"), "base", F.lit("\niri:"), "iri", F.lit("\ntype:"), "kind", F.lit("\nlabel:"), "label", F.lit("\n\n"), "body")
    return rows.select("base", number.cast("bigint").alias("ref_id"), head.alias("content"), embed_hash(F.col("body"), dimensions).alias("embedding"))


def replace_bases(index: DataFrame, bases: DataFrame, new: DataFrame) -> DataFrame:
    """The index with the new rows in place of all that it holds for these bases (base)."""
    return index.join(bases, "base", "left_anti").select(*new.columns).unionByName(new)


def merge_candidates(sure: DataFrame, others: list[DataFrame], least: float = 0.42) -> DataFrame:
    """Best score of each (query, iri); sure hits are kept as they are and mask the same iri elsewhere."""
    rest = reduce(DataFrame.unionByName, others).where(F.col("score") >= least).select("query", "iri", F.lit(None).cast("double").alias("sure"), "score")
    both = sure.select("query", "iri", F.col("score").alias("sure"), F.lit(None).cast("double").alias("score")).unionByName(rest)
    return both.groupBy("query", "iri").agg(F.coalesce(F.max("sure"), F.max("score")).alias("score"))


#: Labels whose automaton a task builds, or that it looks through, at once.
LABEL_BLOCK = 20_000


def _inside(groups: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
    """The labels (g, low, size) of groups that lie inside a longer text of their group: one pass over each text, whatever the number of labels."""
    found = set()
    if len(groups) and len(texts):
        held: dict[str, list] = {}
        for g, low, size in zip(groups["g"], groups["low"], groups["size"], strict=True):
            held.setdefault(low, []).append((g, size))
        labels = ahocorasick.Automaton()
        for low in held:
            labels.add_word(low, low)
        labels.make_automaton()
        for g, low, size in zip(texts["g"], texts["low"], texts["size"], strict=True):
            for _, part in labels.iter(low):
                found.update((g, part, n) for other, n in held[part] if other == g and n < size)
    return pd.DataFrame(sorted(found), columns=["g", "low", "size"])


def maximal_labels(concepts: DataFrame, key: str, label: str, kind: str) -> DataFrame:
    """Concepts whose label is in no longer label of the same kind and key, whatever the case; null labels are in none.

    Blocks of labels become automata that find all their labels in a text in one pass. Groups are dealt to buckets of about
    LABEL_BLOCK labels; a bucket that is larger is cut into blocks, and each block of texts meets each automaton.
    """
    group = F.to_json(F.struct(F.col(key).alias("k"), F.col(kind).alias("c")))
    named = concepts.where(F.col(label) != "").select(group.alias("g"), F.lower(label).alias("low"), F.length(label).alias("size")).distinct()
    named = materialise(named, "labels")
    buckets = F.lit(max(1, -(-named.count() // LABEL_BLOCK)))
    dealt = named.withColumn("bucket", F.pmod(F.xxhash64("g"), buckets))
    # a row for each bucket, of which there is one for LABEL_BLOCK labels
    parts = [(r["bucket"], -(-r["n"] // LABEL_BLOCK)) for r in dealt.groupBy("bucket").agg(F.count("*").alias("n")).collect()]
    sizes = lambda: concepts.sparkSession.createDataFrame(parts, "bucket bigint, parts bigint")
    own, every = F.pmod(F.xxhash64("g", "low"), F.col("parts")), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))
    automata = dealt.join(sizes(), "bucket").withColumn("i", own).withColumn("j", every)
    fresh = dealt.select(*(F.col(c).alias(c) for c in dealt.columns))
    texts = fresh.join(sizes(), "bucket").withColumn("j", own).withColumn("i", every)
    inside = automata.groupBy("bucket", "i", "j").cogroup(texts.groupBy("bucket", "i", "j")).applyInPandas(_inside, "g string, low string, size int").distinct()
    told = concepts.join(inside, (group == F.col("g")) & (F.lower(label) == F.col("low")) & (F.length(label) == F.col("size")), "left_anti")
    return told


def mentions(texts: DataFrame, key: str, text: str, tables: DataFrame, least: int = 6) -> DataFrame:
    """(key, table_id, how): tables named as db.table, or by a bare name of `least` characters or more.

    Dots tie words together only between them, so a full stop ends a name, and a longer path holds the name of its
    parts. Names with other characters than letters, digits and underscores are not found.
    """
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+(?:\.[\p{L}\p{N}_]+)*"), F.lit(0))
    words = rows_of(texts, [key], F.array_distinct(runs), "run").select(key, F.split("run", r"\.").alias("parts"))
    full = tables.select("table_id", F.lower(F.concat_ws(".", F.trim("db"), F.trim("name"))).alias("word"), F.lit("qualified").alias("how"))
    bare = tables.where(F.length(F.trim("name")) >= least).select("table_id", F.lower(F.trim("name")).alias("word"), F.lit("bare").alias("how"))
    pairs = words.where(F.size("parts") > 1).select(key, F.explode(F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda i: F.array_join(F.slice("parts", i, 2), "."))).alias("word"))
    bits = words.select(key, F.explode("parts").alias("word"))
    return pairs.join(full, "word").unionByName(bits.join(bare, "word")).groupBy(key, "table_id").agg(F.max("how").alias("how"))


def resolve_refs(refs: DataFrame, tables: DataFrame) -> DataFrame:
    """(ref, status, table_id, confidence): exact, ambiguous or unresolved.

    A ref is tried as a full or bare name, then its last two parts and its last part are, then the tables that it
    mentions; the first of these that gives tables decides.
    """
    low = F.lower(F.trim("ref"))
    parts = F.split(low, r"\.")
    keys = F.array(low, F.when(F.size(parts) > 1, F.array_join(F.slice(parts, -2, 2), ".")), F.element_at(parts, -1))
    wanted = refs.select("ref").distinct()
    named = wanted.select("ref", F.posexplode(keys).alias("level", "name"))
    known = tables.select("table_id", F.explode(F.array(F.lower(F.concat_ws(".", "db", "name")), F.lower("name"))).alias("name"))
    hits = named.join(known, "name").select("ref", "level", "table_id").unionByName(mentions(wanted, "ref", "ref", tables).select("ref", F.lit(3).alias("level"), "table_id"))
    counted = hits.groupBy("ref", "level").agg(F.count_distinct("table_id").alias("n"), F.min("table_id").alias("table_id"))
    first = counted.groupBy("ref").agg(F.min_by(F.struct("n", "table_id"), "level").alias("x"))
    out = wanted.join(first, "ref", "left")
    status = F.when(F.col("x").isNull(), "unresolved").when(F.col("x.n") == 1, "exact").otherwise("ambiguous")
    return out.select("ref", status.alias("status"), F.when(F.col("x.n") == 1, F.col("x.table_id")).alias("table_id"), F.when(status == "exact", 95).when(status == "ambiguous", 50).otherwise(0).alias("confidence"))


#: References without a table that are kept for each entry.
PENDING = 20


def linked_refs(refs: DataFrame, tables: DataFrame) -> DataFrame:
    """(entry, ref, at, table_id): refs (entry, ref, at) with the one table that they name, null if none or several."""
    found = resolve_refs(refs.select("ref").distinct(), tables).select("ref", "table_id")
    return refs.where(F.trim("ref") != "").select("entry", "ref", "at").join(found, "ref", "left").select("entry", "ref", "at", "table_id")


def stash_pending(refs: DataFrame, tables: DataFrame, most: int = PENDING) -> DataFrame:
    """(entry, ref, at): the last refs of each entry that name no one table, at most `most`; `at` orders an entry's refs."""
    known = linked_refs(refs, tables).where("table_id IS NOT NULL").select("ref").distinct()
    without = refs.where(F.trim("ref") != "").select("entry", "ref", "at").join(known, "ref", "left_anti").select("entry", "ref", "at")
    return best(without, ["entry"], [F.desc("at"), F.desc("ref")], most).drop("rank")


def catch_up(pending: DataFrame, tables: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New links (entry, table_id), each once, and the refs that stay pending; tables are all that are known now."""
    tried = linked_refs(pending, tables)
    new = tried.where("table_id IS NOT NULL").select("entry", "table_id").distinct().join(links, ["entry", "table_id"], "left_anti")
    return new, tried.where("table_id IS NULL").select("entry", "ref", "at")


def fuzzy_name(names: DataFrame, tables: DataFrame) -> DataFrame:
    """First rule that hits: same name, snake to camel, without s, without es; all without regard to case."""
    low = F.lower(F.trim("name_ref"))
    keys = F.array(low, F.replace(low, F.lit("_"), F.lit("")), F.regexp_replace(low, "s$", ""), F.regexp_replace(low, "es$", ""))
    hits = names.select("name_ref", F.posexplode(keys).alias("rule", "name")).join(tables.select(F.lower("name").alias("name"), "table_id"), "name")
    return hits.groupBy("name_ref").agg(F.min(F.struct("rule", "table_id")).alias("x")).select("name_ref", "x.rule", "x.table_id")


def evidence(knowledge: DataFrame, vectors: DataFrame, links: DataFrame, bonus: DataFrame, w1: float, w2: float, constant: int = RRF, link_bonus: float = 0.02) -> DataFrame:
    """(query, table_id, part, source): what each kind of evidence contributes; knowledge and vectors (query, table_id, rank from 1)."""
    kinds = {"knowledge": (knowledge, w1 / (constant + F.col("rank"))), "table_embedding": (vectors, w2 / (constant + F.col("rank"))), "explicit_link": (links, F.lit(link_bonus)), "bonus": (bonus, F.col("bonus"))}
    return reduce(DataFrame.unionByName, [df.select("query", "table_id", part.alias("part"), F.lit(source).alias("source")) for source, (df, part) in kinds.items()])


def table_score(knowledge: DataFrame, vectors: DataFrame, links: DataFrame, bonus: DataFrame, w1: float, w2: float, constant: int = RRF, link_bonus: float = 0.02) -> DataFrame:
    """Sum of the contributions of each kind of evidence; knowledge and vectors (query, table_id, rank from 1)."""
    return traced_score(evidence(knowledge, vectors, links, bonus, w1, w2, constant, link_bonus)).drop("sources")


def traced_score(parts: DataFrame) -> DataFrame:
    """(query, table_id, score, sources) from rows of evidence; sources in order."""
    return parts.groupBy("query", "table_id").agg(rounded(F.sum("part"), 8).alias("score"), F.sort_array(F.collect_set("source")).alias("sources"))


def tables_by_source(traced: DataFrame) -> DataFrame:
    """(query, source, table_ids): the inversion of the sources of each table, ids in order."""
    each = traced.select("query", "table_id", F.explode("sources").alias("source"))
    return each.groupBy("query", "source").agg(F.sort_array(F.collect_set("table_id")).alias("table_ids"))


def expand(scores: DataFrame, candidates: DataFrame, weight: float, most: int = 4, constant: int = RRF) -> DataFrame:
    """Candidates (query, table_id, rank) that have no score yet, at most `most` of each query, with a small score."""
    new = candidates.join(scores.select("query", "table_id"), ["query", "table_id"], "left_anti")
    picked = best(new, ["query"], [F.asc("rank"), F.asc("table_id")], most, "place")
    return picked.select("query", "table_id", rounded(weight / (constant + F.col("place")), 8).alias("score"))


def graph_expand(scores: DataFrame, edges: DataFrame, blocked: DataFrame, weight: float = 0.006, most: int = 4) -> DataFrame:
    """Neighbours (a - b either way) of each query's best table, but for blocked ones."""
    first = best(scores, ["query"], [F.desc("score"), F.asc("table_id")], 1).select("query", F.col("table_id").alias("a"))
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    near = first.join(both, "a").where("a <> b").select("query", F.col("b").alias("table_id")).join(blocked, "table_id", "left_anti").withColumn("rank", F.lit(1))
    return expand(scores, near, weight, most)


def gradient_select(scores: DataFrame, least: float = 0.012, relaxed: float = 0.006, most: int = 10, more: int = 20) -> DataFrame:
    """The best tables over the threshold, or if there is none more tables over a lower one, with the reason."""
    order = [F.desc("score"), F.asc("table_id")]
    top = F.max("score").over(Window.partitionBy("query"))
    rows = ranked(scores.withColumn("top", top), ["query"], order)
    strict, loose = F.col("top") >= least, F.col("top") >= relaxed
    kept = rows.where((strict & (F.col("score") >= least) & (F.col("rank") <= most)) | (~strict & loose & (F.col("score") >= relaxed) & (F.col("rank") <= more)))
    return kept.select("query", "table_id", "score", "rank", F.when(strict, "").otherwise("low_confidence").alias("reason"))


def latest_per_key(df: DataFrame, keys: list[str], when: list[str]) -> DataFrame:
    """The newest row of each key; the order columns must tell rows apart."""
    return best(df, keys, [F.desc(c) for c in when], 1, "newest").drop("newest")


def context_pack(hits: DataFrame, key: str, text: str, budget: int, most: int = 20) -> DataFrame:
    """Best unique hits of each query while the running length stays within the budget; hits have a rank."""
    once = best(hits, ["query", key], [F.asc("rank")], 1, "one").drop("one")
    run = Window.partitionBy("query").orderBy("rank", key)
    packed = once.withColumn("place", F.row_number().over(run)).withColumn("used", F.sum(F.length(text)).over(run.rowsBetween(Window.unboundedPreceding, 0)))
    return packed.where((F.col("place") <= most) & (F.col("used") <= budget))
