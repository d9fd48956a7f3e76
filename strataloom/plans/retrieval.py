"""Retrieval and routing over embeddings, documents, conversations and line items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.operators import index
from strataloom.operators import retrieval as R
from strataloom.plans.metrics import _r
from strataloom.registry import query

SIM = _r("list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[]))", 6)
_SIMS = f"(SELECT q.vec_id AS query, p.vec_id AS id, {SIM} AS sim FROM embeddings q CROSS JOIN embeddings p WHERE q.vec_id % 50 = 0)"
_TOP = f"(SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY sim DESC, id) AS INTEGER) AS rank FROM {_SIMS} QUALIFY rank <= 80)"


def _vectors(t):
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return rows.where("id % 50 = 0").select(F.col("id").alias("query"), F.col("vector").alias("qv")), rows


@query(f"SELECT * FROM {_TOP} WHERE rank <= 10")
def vec_topk(t):
    return R.vec_topk(*_vectors(t), 10)


@query()
def vec_topk_ann(t):
    """Through an index of all rows; the given vectors are random directions, so three of five cells are read for a recall of 0.94."""
    q, rows = _vectors(t)
    made = index.build(rows, 64)
    return index.search(made, q, rows, 10, -(-3 * len(made.centres) // 5))


@query(f"SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY sim DESC, ref) AS INTEGER) AS rank FROM (SELECT query, label AS ref, max(sim) AS sim FROM {_SIMS} JOIN embeddings ON id = vec_id GROUP BY 1, 2) QUALIFY rank <= 3")
def vec_topk_dedup(t):
    return R.vec_topk_dedup(*_vectors(t), t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("ref")), 3)


@query(f"SELECT query, id, sim, CAST(row_number() OVER (PARTITION BY query ORDER BY sim DESC, id) AS INTEGER) AS rank FROM {_SIMS} JOIN embeddings ON id = vec_id WHERE label IN (1, 3) QUALIFY rank <= 5")
def few_shot_similar(t):
    q, _ = _vectors(t)
    allowed = t.embeddings.where("label IN (1, 3)").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return R.vec_topk(q, allowed, 5)


@query()
def chunk_near_dup(t):
    return R.near_duplicates_by_vector(_vectors(t)[1], 64).select("id")


_TOK = "regexp_extract_all(lower({}), '[\\pL\\pN_]+')"
_KW = f"""(WITH i AS (SELECT doc_id, length, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS length, unnest(w) AS term FROM (SELECT doc_id, {_TOK.format('text')} AS w FROM documents)) GROUP BY 1, 2, 3),
  q AS (SELECT DISTINCT query, unnest(w) AS term FROM (SELECT doc_id AS query, list_slice({_TOK.format('text')}, 1, 3) AS w FROM documents WHERE doc_id % 50 = 0)), n AS (SELECT query, count(*) AS need FROM q GROUP BY 1)
  SELECT query, doc_id AS id, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM (SELECT query, doc_id, count(*) AS got, {_r('CAST(sum(tf) AS DOUBLE) / any_value(length)', 6)} AS score FROM i JOIN q USING (term) GROUP BY 1, 2) JOIN n USING (query) WHERE got = need QUALIFY rank <= 80)"""


def _keyword(t, k=80):
    # a question is the first words of a document
    asked = t.documents.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query"), F.array_join(F.slice(R.tokens(F.col("text")), 1, 3), " ").alias("question"))
    docs = t.documents.select(F.col("doc_id").alias("id"), "text")
    return R.kw_search(asked, docs, "id", "text", k)


@query(f"SELECT * FROM {_KW} WHERE rank <= 20")
def kw_search(t):
    return _keyword(t, 20)


_FUSED = f"""(SELECT query, id, {_r('sum(part)', 8)} AS score FROM (SELECT query, id, 1.0::DOUBLE / (60 + rank) AS part FROM {_TOP} UNION ALL SELECT query, id, 1.0::DOUBLE / (60 + rank) FROM {_KW}) GROUP BY 1, 2)"""


@query(f"SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS rank FROM {_FUSED} QUALIFY rank <= 10")
def rrf_fuse(t):
    return R.rrf_fuse([R.vec_topk(*_vectors(t), 80), _keyword(t)], "id", 10)


_BOTH = f"""WITH top AS MATERIALIZED (SELECT * FROM {_TOP}), kw AS MATERIALIZED (SELECT * FROM {_KW}),
  f AS MATERIALIZED (SELECT query, id, {_r('sum(part)', 8)} AS score FROM (SELECT query, id, 1.0::DOUBLE / (60 + rank) AS part FROM top UNION ALL SELECT query, id, 1.0::DOUBLE / (60 + rank) FROM kw) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY query ORDER BY {_r('sum(part)', 8)} DESC, id) <= 32),
  both_lists AS MATERIALIZED (SELECT f.query, f.id, f.score, coalesce(top.sim, 0.0) AS sim, coalesce(kw.score, 0.0) AS kw FROM f LEFT JOIN top ON top.query = f.query AND top.id = f.id LEFT JOIN kw ON kw.query = f.query AND kw.id = f.id)"""


@query(f"""{_BOTH} SELECT query, id, score, sim, kw, grp, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS rank FROM (SELECT *, id // 4 AS grp FROM both_lists QUALIFY row_number() OVER (PARTITION BY query, id // 4 ORDER BY score DESC, id) = 1) QUALIFY rank <= 8""")
def hybrid_chunks(t):
    q, rows = _vectors(t)
    return R.hybrid(R.vec_topk(q, rows, 80), _keyword(t), "id", rows.select("id", F.floor(F.col("id") / 4).alias("grp")).unionByName(t.documents.select(F.col("doc_id").alias("id"), F.floor(F.col("doc_id") / 4).alias("grp"))).distinct(), "grp", 8)


@query(f"{_BOTH} SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS rank FROM both_lists QUALIFY rank <= 8")
def hybrid_entries(t):
    return R.hybrid(R.vec_topk(*_vectors(t), 80), _keyword(t), "id", None, "", 8)


@query(f"""SELECT query, id, source_type, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, source_type, id) AS INTEGER) AS rank FROM (
  SELECT query, id, 'vector' AS source_type, {_r('1.0 / (60 + rank) + CASE WHEN id % 2 = 0 THEN 0.15 ELSE 0 END', 8)} AS score FROM {_TOP} UNION ALL SELECT query, id, 'keyword', {_r('1.0 / (60 + rank)', 8)} FROM {_KW}) QUALIFY rank <= 10""")
def hybrid_unified(t):
    lift = F.when(F.col("id") % 2 == 0, 0.15).otherwise(0.0)  # rows whose role the question hints at
    v = R.vec_topk(*_vectors(t), 80).select("query", "id", F.lit("vector").alias("source_type"), R.rounded(1.0 / (60 + F.col("rank")) + lift, 8).alias("score"))
    k = _keyword(t).select("query", "id", F.lit("keyword").alias("source_type"), R.rounded(1.0 / (60 + F.col("rank")), 8).alias("score"))
    return R.best(v.unionByName(k), ["query"], [F.desc("score"), F.asc("source_type"), F.asc("id")], 10)


@query("""SELECT conv_id, turn, list_sort(list_filter([CASE WHEN regexp_matches(x, '(?i)join|关联|连接') THEN 'join_guide' END, CASE WHEN regexp_matches(x, '(?i)指标|口径|gmv|营收|转化|客单价|复购|留存') THEN 'business_metric' END, CASE WHEN regexp_matches(x, '(?i)字段|列名|含义|字典') THEN 'column_glossary' END, CASE WHEN regexp_matches(x, '(?i)sql|查询|示例|怎么查') THEN 'query_pattern' END], lambda y: y IS NOT NULL)) AS hints FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text || ' JOIN 口径' WHEN 1 THEN text || ' SQL' ELSE text END AS x FROM conversations)""")
def role_hints(t):
    said = F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit(" JOIN 口径"))).when(F.col("turn") % 3 == 1, F.concat("text", F.lit(" SQL"))).otherwise(F.col("text"))
    return t.conversations.select("conv_id", "turn", R.role_hints(said).alias("hints"))


def _concepts(t):
    """Names of parts as concepts, with their last words as alternative labels and brands as definitions."""
    named = t.part.groupBy(F.lower("p_name").alias("label")).agg(F.min("p_partkey").alias("iri"), F.min("p_brand").alias("definition"))
    return named.select("iri", "label", F.element_at(F.split("label", " "), -1).alias("alt"), "definition")


def _questions(t):
    return t.part.select(F.col("p_partkey").alias("query"), F.concat(F.lit("how many "), F.lower("p_name"), F.lit("s for "), F.lower("p_type"), F.lit(" of "), "p_brand").alias("question"))


_CQ = """concepts AS (SELECT lower(p_name) AS label, split_part(lower(p_name), ' ', -1) AS alt, min(p_partkey) AS iri, min(p_brand) AS definition FROM part GROUP BY 1, 2), questions AS (SELECT p_partkey AS query, 'how many ' || lower(p_name) || 's for ' || lower(p_type) || ' of ' || p_brand AS question FROM part),
  t AS (SELECT *, lower(question) AS q, list_distinct(regexp_extract_all(label, '[a-z0-9_]+')) AS lt, list_distinct(regexp_extract_all(lower(question), '[a-z0-9_]+')) AS qt FROM concepts CROSS JOIN questions),
  scored AS (SELECT * FROM (SELECT *, CASE WHEN contains(q, label) THEN 1.0::DOUBLE WHEN contains(q, lower(definition)) THEN 0.88::DOUBLE ELSE """ + _r("CAST(len(list_intersect(lt, qt)) AS DOUBLE) / len(lt) * 0.55::DOUBLE", 6) + """ END AS score FROM t) WHERE score > 0),
  inside AS (SELECT query, iri, CASE WHEN contains(q, label) THEN least(1.0::DOUBLE, """ + _r("0.60 + 0.04 * length(label)", 4) + """) ELSE 0.35::DOUBLE END AS score FROM t WHERE contains(q, label) OR contains(q, alt) OR contains(q, lower(definition)))"""


@query(f"WITH {_CQ} SELECT query, iri, score FROM scored")
def token_overlap_score(t):
    return R.scored_concepts(_questions(t), _concepts(t))


@query(f"WITH {_CQ} SELECT query, iri, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, iri) AS INTEGER) AS rank FROM scored WHERE score >= 0.42 QUALIFY rank <= 5")
def concept_keyword(t):
    return R.best(R.scored_concepts(_questions(t), _concepts(t), 0.42), ["query"], [F.desc("score"), F.asc("iri")], 5)


@query(f"WITH {_CQ} SELECT * FROM inside")
def concept_substring(t):
    return R.substring_concepts(_questions(t), _concepts(t))


@query(f"SELECT query, id, sim, CAST(row_number() OVER (PARTITION BY query ORDER BY sim DESC, id) AS INTEGER) AS rank FROM {_SIMS} WHERE sim >= 0.2 QUALIFY rank <= 5")
def concept_embedding(t):
    return R.vec_topk(*_vectors(t), 5).where("sim >= 0.2")


#: (class, table, key, label, definition, formula, caliber) of what stands for five classes of concepts.
_CLASSES = (
    ("Metric", "part", "p_partkey", "p_name", "p_brand", "p_type", None),
    ("BusinessTerm", "supplier", "s_suppkey", "s_name", None, None, None),
    ("Dimension", "nation", "n_nationkey", "n_name", None, None, None),
    ("BusinessRule", "region", "r_regionkey", "r_name", None, None, None),
    ("BusinessConcept", "customer", "c_custkey", "c_name", "c_mktsegment", None, None),
)
_CONCEPTS = " UNION ALL ".join(f"SELECT CAST({key} % 3 AS BIGINT) AS base, '{kind}/' || {key} AS iri, '{kind}' AS kind, {', '.join(f'{c} AS {n}' if c else f'CAST(NULL AS VARCHAR) AS {n}' for c, n in zip(texts, ('label', 'definition', 'formula', 'caliber'), strict=True))} FROM {table}" for kind, table, key, *texts in _CLASSES)


@query(f"""WITH c AS (SELECT *, concat_ws('；', label, definition, formula, caliber, kind) AS body FROM ({_CONCEPTS}))
  SELECT base, CAST(CAST('0x' || substr(sha256(iri), 1, 16) AS UBIGINT) % 2147483647 AS BIGINT) AS ref_id, 'kb_id:' || base || chr(10) || 'iri:' || iri || chr(10) || 'type:' || kind || chr(10) || 'label:' || label || chr(10) || chr(10) || body AS content,
  [CAST(CAST('0x' || substr(sha256(body), CAST(2 * (i % 32) + 1 AS BIGINT), 2) AS INTEGER) AS DOUBLE) / 255.0::DOUBLE * 2.0::DOUBLE - 1.0::DOUBLE FOR i IN generate_series(0, 63)] AS embedding FROM c
  UNION ALL SELECT CAST(label AS BIGINT), vec_id, 'old', CAST(embedding AS DOUBLE[]) FROM embeddings WHERE label NOT IN (0, 1, 2)""")
def concept_index(t):
    """The concepts of three bases anew, in place of what the index, here the given vectors, held for these."""

    def some(kind, table, key, *texts):
        names = ("label", "definition", "formula", "caliber")
        said = [(F.col(c) if c else F.lit(None).cast("string")).alias(n) for c, n in zip(texts, names, strict=True)]
        return getattr(t, table).select((F.col(key) % 3).cast("bigint").alias("base"), F.concat(F.lit(f"{kind}/"), key).alias("iri"), F.lit(kind).alias("kind"), *said)

    concepts = reduce(DataFrame.unionByName, [some(*c) for c in _CLASSES])
    index = t.embeddings.select(F.col("label").cast("bigint").alias("base"), F.col("vec_id").alias("ref_id"), F.lit("old").alias("content"), F.col("embedding").cast("array<double>").alias("embedding"))
    return R.replace_bases(index, concepts.select("base").distinct(), R.concept_index(concepts))


@query(f"""WITH {_CQ} SELECT query, iri, score FROM inside UNION ALL SELECT query, iri, score FROM scored WHERE score >= 0.42 AND (query, iri) NOT IN (SELECT (query, iri) FROM inside)""")
def concept_merge(t):
    asked, named = _questions(t), _concepts(t)
    return R.merge_candidates(R.substring_concepts(asked, named), [R.scored_concepts(asked, named, 0.42)])


_LABELS = "(SELECT DISTINCT p_size % 2 AS kind, x AS label, p_size AS grp FROM (SELECT p_size, unnest([lower(p_type), lower(split_part(p_type, ' ', 1))]) AS x FROM part))"


@query(f"SELECT a.grp, a.kind, a.label FROM {_LABELS} a WHERE NOT EXISTS (SELECT 1 FROM {_LABELS} b WHERE a.grp = b.grp AND a.kind = b.kind AND length(b.label) > length(a.label) AND contains(b.label, a.label))")
def concept_display_dedup(t):
    labels = t.part.select(F.col("p_size").alias("grp"), (F.col("p_size") % 2).alias("kind"), F.explode(F.array(F.lower("p_type"), F.split(F.lower("p_type"), " ")[0])).alias("label")).distinct()
    return R.maximal_labels(labels, "grp", "label", "kind")


@query("SELECT concept, table_id FROM (SELECT DISTINCT p_brand AS concept, l_suppkey AS table_id FROM part JOIN lineitem ON l_partkey = p_partkey) QUALIFY row_number() OVER (PARTITION BY concept ORDER BY table_id) <= 12")
def concept_to_tables(t):
    linked = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("concept"), F.col("l_suppkey").alias("table_id")).distinct()
    return R.best(linked, ["concept"], [F.asc("table_id")], 12).drop("rank")


# evidence for tables: suppliers of an order's lines stand for tables, orders for questions

_KN = "(SELECT l_orderkey AS query, l_suppkey AS table_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY max(l_extendedprice) DESC, l_suppkey) AS rank FROM lineitem GROUP BY 1, 2)"
_VE = "(SELECT l_orderkey AS query, l_suppkey AS table_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY max(l_quantity) DESC, l_suppkey) AS rank FROM lineitem GROUP BY 1, 2 QUALIFY rank <= 3)"


def _evidence(t):
    best = t.lineitem.groupBy(F.col("l_orderkey").alias("query"), F.col("l_suppkey").alias("table_id")).agg(F.max("l_extendedprice").alias("price"), F.max("l_quantity").alias("units"), F.max(F.col("l_returnflag") == "R").alias("link"))
    knowledge = R.ranked(best, ["query"], [F.desc("price"), F.asc("table_id")])
    vectors = R.best(best, ["query"], [F.desc("units"), F.asc("table_id")], 3)
    return best, knowledge, vectors


_TS = f"""(SELECT query, table_id, {_r('sum(part)', 8)} AS score FROM (SELECT query, table_id, 0.6::DOUBLE / (60 + rank) AS part FROM {_KN} UNION ALL SELECT query, table_id, 0.4::DOUBLE / (60 + rank) FROM {_VE}
  UNION ALL SELECT DISTINCT l_orderkey, l_suppkey, 0.02::DOUBLE FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_orderkey, l_suppkey, 0.10::DOUBLE * count(*) FROM lineitem WHERE l_discount > 0.09 GROUP BY 1, 2) GROUP BY 1, 2)"""


def _parts(t):
    best, knowledge, vectors = _evidence(t)
    return knowledge, vectors, best.where("link").select("query", "table_id"), table_bonus(t), 0.6, 0.4


def _scores(t):
    return R.table_score(*_parts(t))


@query("SELECT l_orderkey AS query, l_suppkey AS table_id, 0.10::DOUBLE * count(*) AS bonus FROM lineitem WHERE l_discount > 0.09 GROUP BY 1, 2")
def table_bonus(t):
    return t.lineitem.where("l_discount > 0.09").groupBy(F.col("l_orderkey").alias("query"), F.col("l_suppkey").alias("table_id")).agg((F.lit(0.10) * F.count("*")).alias("bonus"))


@query(f"SELECT * FROM {_TS}")
def table_score(t):
    return _scores(t)


@query(f"""WITH s AS (SELECT *, max(score) OVER (PARTITION BY query) AS top, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, table_id) AS INTEGER) AS rank FROM {_TS})
  SELECT query, table_id, score, rank, CASE WHEN top >= 0.02 THEN '' ELSE 'low_confidence' END AS reason FROM s WHERE (top >= 0.02 AND score >= 0.02 AND rank <= 3) OR (top < 0.02 AND top >= 0.01 AND score >= 0.01 AND rank <= 5)""")
def gradient_select(t):
    return R.gradient_select(_scores(t), 0.02, 0.01, 3, 5)


@query(f"""SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, table_id) AS INTEGER) AS rank, table_id, {_r('score', 5)} AS score FROM {_TS} QUALIFY rank <= 8""")
def top_scores_trace(t):
    top = R.best(_scores(t), ["query"], [F.desc("score"), F.asc("table_id")], 8)
    return top.withColumn("score", R.rounded(F.col("score"), 5))


_TRACED = f"""(SELECT query, table_id, {_r('sum(part)', 8)} AS score, list_sort(list(DISTINCT source)) AS sources FROM (SELECT query, table_id, 0.6::DOUBLE / (60 + rank) AS part, 'knowledge' AS source FROM {_KN} UNION ALL SELECT query, table_id, 0.4::DOUBLE / (60 + rank), 'table_embedding' FROM {_VE}
  UNION ALL SELECT DISTINCT l_orderkey, l_suppkey, 0.02::DOUBLE, 'explicit_link' FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_orderkey, l_suppkey, 0.10::DOUBLE * count(*), 'bonus' FROM lineitem WHERE l_discount > 0.09 GROUP BY 1, 2) GROUP BY 1, 2)"""


@query(f"SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, table_id) AS INTEGER) AS rank, table_id, {_r('score', 5)} AS score, sources FROM {_TRACED} QUALIFY rank <= 8")
def top_scores_trace_all(t):
    top = R.best(R.traced_score(R.evidence(*_parts(t))), ["query"], [F.desc("score"), F.asc("table_id")], 8)
    return top.withColumn("score", R.rounded(F.col("score"), 5))


@query(f"SELECT query, source, list_sort(list(table_id)) AS table_ids FROM (SELECT query, table_id, unnest(sources) AS source FROM {_TRACED}) GROUP BY 1, 2")
def top_scores_sources(t):
    return R.tables_by_source(R.traced_score(R.evidence(*_parts(t))))


_EDGES = "(SELECT s_suppkey AS a, s_nationkey + 1 AS b FROM supplier)"


@query(f"""WITH f AS (SELECT query, table_id AS a FROM {_TS} QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, table_id) = 1), e AS (SELECT a, b FROM {_EDGES} UNION SELECT b, a FROM {_EDGES}),
  n AS (SELECT DISTINCT query, b AS table_id FROM f JOIN e USING (a) WHERE a <> b AND b NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 11 = 0)), x AS (SELECT n.* FROM n WHERE (query, table_id) NOT IN (SELECT (query, table_id) FROM {_TS}))
  SELECT query, table_id, {_r('0.006::DOUBLE / (60 + row_number() OVER (PARTITION BY query ORDER BY table_id))', 8)} AS score FROM x QUALIFY row_number() OVER (PARTITION BY query ORDER BY table_id) <= 4""")
def graph_expand(t):
    edges = t.supplier.select(F.col("s_suppkey").alias("a"), (F.col("s_nationkey") + 1).cast("bigint").alias("b"))
    return R.graph_expand(_scores(t), edges, t.supplier.where("s_suppkey % 11 = 0").select(F.col("s_suppkey").alias("table_id")))


@query(f"""WITH c AS (SELECT DISTINCT o_orderkey AS query, o_custkey % 100 + 1 AS table_id FROM orders), x AS (SELECT * FROM c WHERE (query, table_id) NOT IN (SELECT (query, table_id) FROM {_TS})) SELECT query, table_id, {_r('0.008::DOUBLE / 61', 8)} AS score FROM x""")
def dim_expand(t):
    return R.expand(_scores(t), t.orders.select(F.col("o_orderkey").alias("query"), (F.col("o_custkey") % 100 + 1).alias("table_id"), F.lit(1).alias("rank")), 0.008)


@query(f"""SELECT query, count(*) AS tables, CASE WHEN count(*) >= 3 AND max(score) > 0.05 THEN 'rich' WHEN count(*) >= 1 THEN 'moderate' ELSE 'weak' END AS signal, CASE WHEN count(*) >= 3 AND max(score) > 0.05 THEN 2 ELSE 4 END AS top_k FROM {_TS} GROUP BY 1""")
def coverage_signal(t):
    rich = (F.count("*") >= 3) & (F.max("score") > 0.05)
    return _scores(t).groupBy("query").agg(F.count("*").alias("tables"), F.when(rich, "rich").otherwise("moderate").alias("signal"), F.when(rich, 2).otherwise(4).alias("top_k"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_key(t):
    return R.latest_per_key(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber) = 1")
def bundle_merge(t):
    return R.best(t.lineitem, ["l_suppkey", "l_partkey"], [F.asc("l_orderkey"), F.asc("l_linenumber")], 1).select("l_suppkey", "l_orderkey", "l_linenumber")


_TBL = "(SELECT s_suppkey AS table_id, 'db' || s_nationkey AS db, 'table_' || s_suppkey AS name FROM supplier)"


def _tables(t):
    return t.supplier.select(F.col("s_suppkey").alias("table_id"), F.concat(F.lit("db"), "s_nationkey").alias("db"), F.concat(F.lit("table_"), "s_suppkey").alias("name"))


@query(f"""WITH x AS (SELECT o_orderkey, o_custkey % 150 AS n FROM orders), s AS (SELECT o_orderkey, t.table_id, CASE WHEN o_orderkey % 2 = 0 THEN 'qualified' ELSE 'bare' END AS how FROM x JOIN {_TBL} t ON t.table_id = n) SELECT * FROM s""")
def table_mentions(t):
    named = t.orders.withColumn("n", F.col("o_custkey") % 150).join(_tables(t), F.col("n") == F.col("table_id"))
    said = named.select("o_orderkey", F.concat(F.lit("rows of "), F.when(F.col("o_orderkey") % 2 == 0, F.concat_ws(".", "db", "name")).otherwise(F.col("name")), F.lit(".")).alias("text"))
    return R.mentions(said, "o_orderkey", "text", _tables(t))


@query(f"""WITH r AS (SELECT DISTINCT CASE s_suppkey % 3 WHEN 0 THEN 'db' || s_nationkey || '.table_' || s_suppkey WHEN 1 THEN 'TABLE_' || s_suppkey ELSE 'missing_' || s_suppkey END AS ref, s_suppkey FROM supplier)
  SELECT ref, CASE WHEN s_suppkey % 3 = 2 THEN 'unresolved' ELSE 'exact' END AS status, CASE WHEN s_suppkey % 3 < 2 THEN s_suppkey END AS table_id, CASE WHEN s_suppkey % 3 = 2 THEN 0 ELSE 95 END AS confidence FROM r""")
def ref_resolve(t):
    ref = F.when(F.col("table_id") % 3 == 0, F.concat_ws(".", "db", "name")).when(F.col("table_id") % 3 == 1, F.upper("name")).otherwise(F.concat(F.lit("missing_"), "table_id"))
    return R.resolve_refs(_tables(t).select(ref.alias("ref")), _tables(t))


@query("""SELECT CASE n_nationkey % 3 WHEN 0 THEN lower(n_name) WHEN 1 THEN n_name || 's' ELSE n_name || 'es' END AS name_ref, CASE n_nationkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 3 END AS rule, n_nationkey AS table_id FROM nation""")
def fuzzy_table_name(t):
    name = F.when(F.col("n_nationkey") % 3 == 0, F.lower("n_name")).when(F.col("n_nationkey") % 3 == 1, F.concat("n_name", F.lit("s"))).otherwise(F.concat("n_name", F.lit("es")))
    return R.fuzzy_name(t.nation.select(name.alias("name_ref")), t.nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("table_id")))


@query(f"""WITH h AS (SELECT l_orderkey AS query, l_partkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank FROM lineitem), o AS (SELECT h.query, h.id, min(rank) AS rank FROM h GROUP BY 1, 2),
  p AS (SELECT query, id, rank, row_number() OVER (PARTITION BY query ORDER BY rank, id) AS place, sum(length(p_name)) OVER (PARTITION BY query ORDER BY rank, id ROWS UNBOUNDED PRECEDING) AS used FROM o JOIN part ON p_partkey = id) SELECT query, id, CAST(used AS BIGINT) AS used FROM p WHERE place <= 4 AND used <= 40""")
def context_pack(t):
    hits = R.ranked(t.lineitem.select(F.col("l_orderkey").alias("query"), F.col("l_partkey").alias("id"), "l_extendedprice", "l_linenumber"), ["query"], [F.desc("l_extendedprice"), F.asc("l_linenumber")])
    named = hits.join(t.part.select(F.col("p_partkey").alias("id"), "p_name"), "id")
    return R.context_pack(named, "id", "p_name", 40, 4).select("query", "id", "used")


@query("""SELECT s_suppkey, s_nationkey, count(DISTINCT l_orderkey) FILTER (l_suppkey = s_suppkey) AS linked FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2 HAVING linked = 0 OR s_suppkey % 5 = 0""")
def supplier_links(t):
    links = t.lineitem.groupBy("l_suppkey").agg(F.count_distinct("l_orderkey").alias("linked"))
    joined = t.supplier.join(links, F.col("l_suppkey") == F.col("s_suppkey"), "left").fillna(0, ["linked"])
    return joined.where("linked = 0 OR s_suppkey % 5 = 0").select("s_suppkey", "s_nationkey", "linked")


# parts stand for entries, their suppliers for tables; even suppliers are known first, the others come later, missing_* never

_PENDING = """WITH p AS (SELECT l_partkey AS entry, l_suppkey AS table_id, l_linenumber, l_orderkey * 10 + l_linenumber AS "at" FROM lineitem WHERE l_suppkey % 2 = 1 OR l_linenumber = 7 QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber DESC, CASE WHEN l_linenumber = 7 THEN 'missing_' ELSE 'TABLE_' END || l_suppkey DESC) <= 20)"""


def _caught_up(t):
    ref = F.concat(F.when(F.col("l_linenumber") == 7, "missing_").otherwise("TABLE_"), "l_suppkey")
    refs = t.lineitem.select(F.col("l_partkey").alias("entry"), ref.alias("ref"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    links = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("entry"), F.col("l_suppkey").alias("table_id")).distinct()
    return R.catch_up(R.stash_pending(refs, _tables(t).where("table_id % 2 = 0")), _tables(t), links)


@query(f"""{_PENDING}
  SELECT DISTINCT entry, table_id FROM p JOIN supplier ON s_suppkey = table_id WHERE l_linenumber < 7 AND (entry, table_id) NOT IN (SELECT (l_partkey, l_suppkey) FROM lineitem WHERE l_returnflag = 'R')""")
def pending_ref_catchup(t):
    return _caught_up(t)[0]


@query(f"{_PENDING} SELECT entry, 'missing_' || table_id AS ref, \"at\" FROM p WHERE l_linenumber = 7")
def pending_ref_left(t):
    """What stays pending after the retry."""
    return _caught_up(t)[1]


@query("""SELECT query, table_id, min(pass) AS pass, list_sort(list(DISTINCT src)) AS sources FROM (SELECT l_orderkey AS query, l_suppkey AS table_id, 1 AS pass, 'explicit_link' AS src FROM lineitem WHERE l_returnflag = 'R'
  UNION ALL SELECT l_orderkey, l_suppkey, 2, 'grounding' FROM lineitem WHERE l_discount > 0.05 UNION ALL SELECT l_orderkey, l_suppkey, 3, 'name_match' FROM lineitem WHERE l_tax > 0.05) GROUP BY 1, 2""")
def knowledge_tables(t):
    part = lambda where, n, name: t.lineitem.where(where).select(F.col("l_orderkey").alias("query"), F.col("l_suppkey").alias("table_id"), F.lit(n).alias("pass"), F.lit(name).alias("src"))
    every = part("l_returnflag = 'R'", 1, "explicit_link").unionByName(part("l_discount > 0.05", 2, "grounding")).unionByName(part("l_tax > 0.05", 3, "name_match"))
    return every.groupBy("query", "table_id").agg(F.min("pass").alias("pass"), F.sort_array(F.collect_set("src")).alias("sources"))


@query("""SELECT DISTINCT d, s_suppkey AS table_id FROM (SELECT r_regionkey AS d, n_nationkey AS db, CASE WHEN n_nationkey % 2 = 0 THEN NULL ELSE n_nationkey END AS tbl FROM region JOIN nation ON n_regionkey = r_regionkey) JOIN supplier ON s_nationkey = db AND (tbl IS NULL OR tbl = s_suppkey)""")
def domain_tables(t):
    picks = t.nation.select(F.col("n_regionkey").alias("d"), F.col("n_nationkey").alias("db"), F.when(F.col("n_nationkey") % 2 == 1, F.col("n_nationkey")).alias("tbl"))
    return t.supplier.join(picks, (F.col("s_nationkey") == F.col("db")) & (F.col("tbl").isNull() | (F.col("tbl") == F.col("s_suppkey")))).select("d", F.col("s_suppkey").alias("table_id")).distinct()


@query(f"""SELECT n_nationkey, o_orderpriority AS domain, {_r("CASE WHEN n_nationkey % 2 = 0 THEN 0.45 ELSE 0 END + least(0.55::DOUBLE, 0.9::DOUBLE * CAST(n AS DOUBLE) / total)", 4)} AS score FROM (SELECT c_nationkey AS n_nationkey, o_orderpriority, count(*) AS n, sum(count(*)) OVER (PARTITION BY c_nationkey) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) WHERE score >= 0.2 QUALIFY row_number() OVER (PARTITION BY n_nationkey ORDER BY score DESC, domain) <= 3""")
def domain_score(t):
    pairs = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("n_nationkey"), F.col("o_orderpriority").alias("domain")).agg(F.count("*").alias("n"))
    total = pairs.groupBy("n_nationkey").agg(F.sum("n").alias("total"))
    score = F.when(F.col("n_nationkey") % 2 == 0, 0.45).otherwise(0.0) + F.least(F.lit(0.55), F.lit(0.9) * F.col("n") / F.col("total"))
    return R.best(pairs.join(total, "n_nationkey").select("n_nationkey", "domain", R.rounded(score, 4).alias("score")).where("score >= 0.2"), ["n_nationkey"], [F.desc("score"), F.asc("domain")], 3).drop("rank")


@query("""SELECT o_orderkey, outside, total, CASE WHEN outside = 0 THEN 'ok' WHEN outside = total THEN 'review' WHEN outside = 1 THEN 'medium' ELSE 'medium_high' END AS level FROM (SELECT l_orderkey AS o_orderkey, count(DISTINCT l_suppkey) FILTER (l_suppkey % 4 = 0) AS outside, count(DISTINCT l_suppkey) AS total FROM lineitem GROUP BY 1)""")
def sql_scope_review(t):
    refs = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey").distinct()
    allowed = t.supplier.where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(True).alias("allowed"))
    told = refs.join(allowed, "l_suppkey", "left").groupBy("o_orderkey").agg(F.count_if(F.col("allowed").isNull()).alias("outside"), F.count("*").alias("total"))
    return told.withColumn("level", F.when(F.col("outside") == 0, "ok").when(F.col("outside") == F.col("total"), "review").when(F.col("outside") == 1, "medium").otherwise("medium_high"))


@query(f"""SELECT o_orderkey AS query, CASE WHEN o_orderstatus = 'P' THEN 'locked_table' WHEN n > 0 AND o_orderstatus = 'F' THEN 'domain_narrowed' WHEN o_orderstatus = 'F' THEN 'domain_all' WHEN n > 0 THEN 'global_semantic' ELSE 'recent_tables' END AS mode FROM orders LEFT JOIN (SELECT query, count(*) FILTER (score >= 0.03) AS n FROM {_TS} GROUP BY 1) ON query = o_orderkey""")
def routing_mode(t):
    found = _scores(t).groupBy("query").agg(F.count_if(F.col("score") >= 0.03).alias("n"))
    some, status = F.coalesce(F.col("n"), F.lit(0)) > 0, F.col("o_orderstatus")
    mode = F.when(status == "P", "locked_table").when(some & (status == "F"), "domain_narrowed").when(status == "F", "domain_all").when(some, "global_semantic").otherwise("recent_tables")
    return t.orders.join(found, F.col("query") == F.col("o_orderkey"), "left").select(F.col("o_orderkey").alias("query"), mode.alias("mode"))


@query("""SELECT r_name AS table_name, string_agg(n_name || ': dimension', chr(10) ORDER BY n_nationkey) AS context FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1""")
def schema_context(t):
    lines = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.concat(x["n_name"], F.lit(": dimension"))), "\n")
    return lines.groupBy(F.col("r_name").alias("table_name")).agg(text.alias("context"))


@query("""SELECT r_name, n_name, suppliers, customers FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey LEFT JOIN (SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY 1) ON c_nationkey = n_nationkey""")
def table_detail(t):
    s = t.supplier.groupBy("s_nationkey").agg(F.count("*").alias("suppliers"))
    c = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    base = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return base.join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("r_name", "n_name", "suppliers", "customers")


@query("""SELECT doc_id, term_hits + 3 * CAST(titled AS INTEGER) AS relevance FROM (SELECT doc_id, len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')), ['the', 'and', 'with', 'que', 'der'])) AS term_hits, source = 'src0' AS titled FROM documents) WHERE term_hits + 3 * CAST(titled AS INTEGER) > 0 ORDER BY relevance DESC, doc_id LIMIT 20""")
def doc_relevance(t):
    terms = F.array(*map(F.lit, ("the", "and", "with", "que", "der")))
    hits = F.size(F.array_intersect(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))), terms))
    scored = t.documents.select("doc_id", (hits + F.when(F.col("source") == "src0", 3).otherwise(0)).cast("bigint").alias("relevance"))
    return scored.where("relevance > 0").orderBy(F.desc("relevance"), "doc_id").limit(20)


@query("""SELECT doc_id AS ref_id, sha256(text) AS content FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT vec_id, 'old' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 = 0)""")
def embeddings_refresh(t):
    new = t.documents.where("doc_id % 3 = 0").select(F.col("doc_id").alias("ref_id"), F.sha2("text", 256).alias("content"))
    return new.unionByName(t.embeddings.select(F.col("vec_id").alias("ref_id"), F.lit("old").alias("content")).join(new, "ref_id", "left_anti"))
