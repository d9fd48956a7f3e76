"""Graph queries over the derived triples."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.operators import graph as G
from strataloom.plans.fixtures import KG, kg
from strataloom.registry import query


def entities_sql(kind, props):
    cols = ", ".join(f"min(CASE WHEN p = '{p}' THEN o END) AS {p}" for p in props)
    return f"(SELECT g, s, {cols} FROM {KG} GROUP BY g, s HAVING max(CASE WHEN p = 'type' AND o = '{kind}' THEN 1 ELSE 0 END) = 1)"


LABELS = f"(SELECT s, min(o) AS label FROM {KG} WHERE p = 'label' GROUP BY 1)"


@query(f"SELECT * FROM {entities_sql('Metric', ['label', 'formula', 'status'])} ORDER BY label, s LIMIT 500")
def kg_entities(t):
    return G.entities(kg(t), "Metric", ["label", "formula", "status"]).orderBy("label", "s").limit(500)


@query(f"SELECT s, string_agg(DISTINCT o, '|||' ORDER BY o) AS values FROM {KG} WHERE p = 'altLabel' GROUP BY 1")
def kg_synonyms(t):
    return G.gathered(kg(t), "altLabel")


@query(f"SELECT g, s, label, status FROM {entities_sql('Term', ['label', 'status'])} WHERE contains(lower(label), '12')")
def kg_search_terms(t):
    return G.search(kg(t), "Term", "12", ["label"])


@query(f"SELECT g, s, label, formula, status FROM {entities_sql('Metric', ['label', 'formula', 'status'])} WHERE (contains(lower(label), '12') OR contains(lower(formula), '12')) AND (status IS NULL OR status = 'approved')")
def kg_search_metrics(t):
    return G.search(kg(t), "Metric", "12", ["label", "formula"], ("approved",))


@query(f"SELECT g, count(*) AS triples, count(DISTINCT s) AS subjects, count(*) FILTER (p = 'type') AS typed FROM {KG} GROUP BY 1")
def kg_counts(t):
    return G.counts(kg(t))


graph_stats = query(f"SELECT g, count(*) AS triples, count(DISTINCT s) AS subjects, count(*) FILTER (p = 'type') AS typed FROM {KG} GROUP BY 1", "graph_stats")(lambda t: G.counts(kg(t)))


@query(f"""WITH e AS (SELECT * FROM {KG} WHERE iri AND p <> 'type'), n AS (SELECT 'n/' || n_nationkey AS node FROM nation WHERE n_nationkey < 5), b AS (SELECT s AS node, 'out' AS direction, p, o AS other FROM e JOIN n ON s = node UNION ALL SELECT o, 'in', p, s FROM e JOIN n ON o = node)
  SELECT other, node, direction, p, label FROM b LEFT JOIN {LABELS} l ON l.s = other QUALIFY row_number() OVER (PARTITION BY node ORDER BY direction, p, other) <= 20""")
def kg_neighbors(t):
    return G.neighbours(kg(t), t.nation.where("n_nationkey < 5").select(F.expr("'n/' || n_nationkey").alias("node")), 20)


@query(f"SELECT s AS a, o AS b FROM {KG} WHERE p IN ('joinableWith', 'transformsFrom') UNION SELECT o, s FROM {KG} WHERE p IN ('joinableWith', 'transformsFrom')")
def kg_join_neighbors(t):
    return G.both_ways(kg(t), ("joinableWith", "transformsFrom"))


_REL = f"""WITH e AS (SELECT DISTINCT s, p, o FROM {KG} WHERE p IN ({', '.join(f"'{p}'" for p in G.RELATIONS)})), n AS (SELECT 's/' || s_suppkey AS node FROM supplier WHERE s_suppkey % 10 = 0)
  SELECT e.s, p, o, coalesce(a.label, list_extract(string_split(e.s, '/'), -1)) AS s_label, coalesce(b.label, list_extract(string_split(o, '/'), -1)) AS o_label FROM e LEFT JOIN {LABELS} a ON a.s = e.s LEFT JOIN {LABELS} b ON b.s = o WHERE e.s IN (SELECT node FROM n) OR o IN (SELECT node FROM n)"""


@query(_REL)
def kg_concept_relations(t):
    return G.relations_of(kg(t), t.supplier.where("s_suppkey % 10 = 0").select(F.expr("'s/' || s_suppkey").alias("node")))


@query(f"""WITH f AS (SELECT DISTINCT s AS node FROM {entities_sql('Metric', ['label', 'formula'])} WHERE contains(lower(coalesce(label, '')), '12') OR contains(lower(coalesce(formula, '')), '12')),
  e AS (SELECT s AS a, o AS b FROM {KG} WHERE p IN ('joinableWith', 'transformsFrom')), n AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b)
  SELECT DISTINCT node, k.o AS table_iri, n.b AS neighbour FROM f JOIN {KG} k ON k.s = node AND k.p = 'computedFrom' LEFT JOIN n ON n.a = k.o""")
def kg_full_route(t):
    triples = kg(t)
    found = G.search(triples, "Metric", "12", ["label", "formula"]).select(F.col("s").alias("node"))
    tables = triples.where("p = 'computedFrom'").join(found, F.col("s") == F.col("node")).select("node", F.col("o").alias("a"))
    return tables.join(G.both_ways(triples, ("joinableWith", "transformsFrom")), "a", "left").select("node", F.col("a").alias("table_iri"), F.col("b").alias("neighbour")).distinct()


@query(f"""SELECT a.s AS table_iri, label, count(m) AS metrics, coalesce(string_agg(ml, ', ' ORDER BY m), '') AS metric_labels FROM {entities_sql('Table', ['label'])} a LEFT JOIN (SELECT k.s AS m, o, l.label AS ml FROM {KG} k JOIN {LABELS} l ON l.s = k.s WHERE p = 'computedFrom') ON o = a.s GROUP BY 1, 2""")
def kg_table_context(t):
    triples = kg(t)
    m = triples.where("p = 'computedFrom'").join(G.labels(triples), "s").select(F.col("s").alias("m"), F.col("o").alias("table_iri"), F.col("label").alias("ml"))
    per = m.groupBy("table_iri").agg(F.count("*").alias("metrics"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("m", "ml"))), lambda x: x["ml"]), ", ").alias("metric_labels"))
    return G.entities(triples, "Table", ["label"]).select(F.col("s").alias("table_iri"), "label").join(per, "table_iri", "left").fillna(0, ["metrics"]).fillna("", ["metric_labels"])


@query(f"SELECT kind, string_agg(s, chr(10) ORDER BY s) AS block FROM (SELECT o AS kind, s FROM {KG} WHERE p = 'type' QUALIFY row_number() OVER (PARTITION BY o ORDER BY s) <= 15) GROUP BY 1")
def kg_context_sections(t):
    from strataloom.operators.retrieval import best

    first = best(kg(t).where("p = 'type'").select(F.col("o").alias("kind"), "s"), ["kind"], [F.asc("s")], 15)
    return first.groupBy("kind").agg(F.array_join(F.array_sort(F.collect_list("s")), "\n").alias("block"))


@query(f"""SELECT g, count(DISTINCT CASE WHEN p = 'type' AND o = 'Term' THEN s END) AS vocabulary, count(DISTINCT CASE WHEN p = 'type' AND o = 'Metric' THEN s END) AS metric, count(DISTINCT CASE WHEN p = 'type' AND o = 'Concept' THEN s END) AS concept, count(DISTINCT CASE WHEN p = 'type' AND o = 'Table' THEN s END) AS physical,
  count(*) FILTER (iri AND p IN ({', '.join(f"'{p}'" for p in G.RELATIONS)})) AS relation, count(*) FILTER (NOT iri AND p NOT IN ('type', 'status')) AS attribute FROM {KG} GROUP BY 1""")
def layer_counts(t):
    return G.layer_counts(kg(t))


@query(f"SELECT e.g, e.s, label, status, values FROM {entities_sql('Term', ['label', 'status'])} e LEFT JOIN (SELECT s, string_agg(DISTINCT o, '|||' ORDER BY o) AS values FROM {KG} WHERE p = 'broader' GROUP BY 1) USING (s)")
def layer_items(t):
    triples = kg(t)
    return G.entities(triples, "Term", ["label", "status"]).join(G.gathered(triples, "broader"), "s", "left")


@query(f"WITH i AS (SELECT s, p, o FROM {KG} WHERE NOT iri AND contains(lower(s || ' ' || p || ' ' || o), '1')), n AS (SELECT count(*) AS total FROM i) SELECT s, p, o, total, total > 60 AS has_more FROM (SELECT * FROM i ORDER BY p, s, o LIMIT 40 OFFSET 20) CROSS JOIN n")
def layer_page(t):
    return G.page(kg(t).where("not iri").select("s", "p", "o"), "1", [F.asc("p"), F.asc("s"), F.asc("o")], 20, 40)


@query(f"SELECT s AS source, o AS target, p AS type FROM {KG} WHERE iri AND p <> 'type' ORDER BY s, p, o LIMIT 500")
def kg_graph_view(t):
    return kg(t).where("iri and p <> 'type'").orderBy("s", "p", "o").limit(500).select(F.col("s").alias("source"), F.col("o").alias("target"), F.col("p").alias("type"))


@query(f"SELECT o AS source, k.s AS target, label FROM {KG} k LEFT JOIN {LABELS} l ON l.s = k.s WHERE p = 'transformsFrom' AND contains(k.s, '3')")
def kg_lineage_view(t):
    triples = kg(t)
    return triples.where("p = 'transformsFrom' and contains(s, '3')").join(G.labels(triples), "s", "left").select(F.col("o").alias("source"), F.col("s").alias("target"), "label")


@query(f"SELECT s, label, coalesce(status, 'draft') AS status FROM {entities_sql('Term', ['label', 'status'])} WHERE coalesce(status, 'draft') = 'draft' ORDER BY s LIMIT 100")
def kg_triples_page(t):
    return G.entities(kg(t), "Term", ["label", "status"]).select("s", "label", F.coalesce("status", F.lit("draft")).alias("status")).where("status = 'draft'").orderBy("s").limit(100)


@query(f"""WITH RECURSIVE up AS (SELECT s AS child, min(o) AS parent FROM {KG} WHERE p = 'broader' GROUP BY 1), h AS (SELECT DISTINCT parent AS node, parent AS root, parent AS path, 0 AS depth FROM up WHERE parent NOT IN (SELECT child FROM up) UNION ALL SELECT child, root, path || ' > ' || child, depth + 1 FROM h JOIN up ON parent = node) SELECT * FROM h""")
def kg_hierarchy(t):
    return G.hierarchy(kg(t))


@query(f"SELECT s, chunk_id, doc_id, source, substr(text, 1, 240) AS preview FROM (SELECT s, CAST(regexp_extract(o, 'chunk/(\\d+)$', 1) AS BIGINT) AS chunk_id FROM {KG} WHERE p = 'groundedBy') JOIN documents ON doc_id = chunk_id")
def kg_provenance(t):
    chunks = t.documents.select(F.col("doc_id").alias("chunk_id"), "doc_id", F.col("text").alias("content"))
    return G.provenance(kg(t), chunks, t.documents.select("doc_id", "source"))


_BASES = "(SELECT DISTINCT 'g' || (n_nationkey % 3) AS g, 'd' || (n_nationkey % 2) AS domain FROM nation WHERE n_nationkey < 4)"


@query(f"SELECT domain, s, o AS kind, min(g) AS g FROM {KG} JOIN {_BASES} USING (g) WHERE p = 'type' GROUP BY 1, 2, 3")
def kg_federate(t):
    return G.federated(kg(t), domain_bases(t))


@query(_BASES[1:-1])
def domain_bases(t):
    return t.nation.where("n_nationkey < 4").select(F.expr("'g' || (n_nationkey % 3)").alias("g"), F.expr("'d' || (n_nationkey % 2)").alias("domain")).distinct()


@query(f"SELECT domain, kind, count(*) AS n FROM (SELECT domain, s, o AS kind FROM {KG} JOIN {_BASES} USING (g) WHERE p = 'type' GROUP BY 1, 2, 3) GROUP BY ROLLUP (domain, kind)")
def kg_federate_totals(t):
    return G.overview(kg_federate(t))
