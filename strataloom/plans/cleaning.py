"""Triple construction and cleaning over the derived triples."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strataloom.functions.storage import shared_folder
from strataloom.operators import cleaning as L
from strataloom.operators import triples as C
from strataloom.operators import validation as V
from strataloom.plans.fixtures import KG, kg
from strataloom.plans.metrics import _r
from strataloom.plans.retrieval import _SIMS, _tables, _vectors
from strataloom.registry import query

RAW = """(SELECT 'p/' || l_partkey AS s, 'suppliedBy' AS p, 's/' || l_suppkey AS o, l_returnflag AS source, floor(1000 * (1 - l_discount) + 0.5) / 10 AS confidence FROM lineitem)"""
_ONE = "floor(({}) * 10 + 0.5 + 1e-7) / 10"


def raw(t):
    return t.lineitem.select(F.expr("'p/' || l_partkey").alias("s"), F.lit("suppliedBy").alias("p"), F.expr("'s/' || l_suppkey").alias("o"), F.col("l_returnflag").alias("source"), (F.floor(1000 * (1 - F.col("l_discount")) + 0.5) / 10).alias("confidence"))


@query(r"SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_type)), '\s+', '_', 'g'), '[^\w.\-]', '', 'g') AS slug, 'part/' || p_brand || '/' || p_partkey AS iri FROM part")
def make_iri(t):
    return t.part.select("p_partkey", C.slug(F.col("p_type")).alias("slug"), C.iri("part", F.regexp_replace("p_brand", "#", "#"), F.col("p_partkey")).alias("iri")).withColumn("iri", F.url_decode("iri"))


_REPLY = "'{\"items\": [{\"name\": \"' || p_type || '\", \"definition\": \"' || p_brand || '\", \"confidence\": ' || (p_size * 2) || ', \"synonyms\": [\"' || lower(p_type) || '\"]}]}'"
_FIRST = "(SELECT *, regexp_replace(regexp_replace(lower(trim(p_type)), '\\s+', '_', 'g'), '[^\\w.\\-]', '', 'g') AS key FROM part QUALIFY row_number() OVER (PARTITION BY key ORDER BY p_partkey) = 1)"


def _family(name, kind):
    k = kind.lower()

    @query(f"""SELECT '{k}/' || key AS s, unnest(['type', 'label', 'definition', 'confidence', 'status', 'altLabel']) AS p, unnest(['{kind}', p_type, p_brand, CAST(CAST(p_size * 2 AS DOUBLE) AS VARCHAR), CASE WHEN p_size * 2 >= 85 THEN 'approved' ELSE 'draft' END, lower(p_type)]) AS o, unnest([true, false, false, false, false, false]) AS iri FROM {_FIRST}""", name)
    def make(t):
        replies = t.part.select(F.col("p_partkey").alias("reply_id"), F.expr(_REPLY).alias("reply"))
        return C.from_replies(replies, kind, "name:string,definition:string,confidence:double,synonyms:array<string>")


for _name, _kind in (("triples_from_terms", "Term"), ("triples_from_metrics", "Metric"), ("triples_from_dimensions", "Dimension"), ("triples_from_rules", "BusinessRule")):
    _family(_name, _kind)


@query("""SELECT 'c/' || c_custkey AS s, CASE c_custkey % 2 WHEN 0 THEN 'related' ELSE 'derivedFrom' END AS p, 'n/' || c_nationkey AS o FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 4 <> 0""")
def triples_from_relations(t):
    known = t.nation.where("n_nationkey % 4 <> 0").select(F.col("n_nationkey").alias("c_nationkey"))
    kind = F.when(F.col("c_custkey") % 2 == 0, "related").otherwise("derivedFrom")
    return t.customer.join(known, "c_nationkey", "left_semi").select(F.expr("'c/' || c_custkey").alias("s"), kind.alias("p"), F.expr("'n/' || c_nationkey").alias("o"))


@query("SELECT 'n/' || n_nationkey AS s, 'broader' AS p, 'r/' || n_regionkey AS o FROM nation UNION ALL SELECT 'r/' || n_regionkey, 'narrower', 'n/' || n_nationkey FROM nation")
def triples_from_hierarchy(t):
    n, r = F.expr("'n/' || n_nationkey"), F.expr("'r/' || n_regionkey")
    both = F.array(F.struct(n.alias("s"), F.lit("broader").alias("p"), r.alias("o")), F.struct(r.alias("s"), F.lit("narrower").alias("p"), n.alias("o")))
    return t.nation.select(F.explode(both).alias("x")).select("x.*")


@query("""SELECT DISTINCT s, p, o FROM (SELECT 'm/' || event_type AS s, 'computedFrom' AS p, 'u/' || (user_id % 20) AS o FROM events WHERE user_id % 3 = 0 UNION ALL SELECT 'u/' || (user_id % 20), 'joinableWith', 'v/' || event_type FROM events WHERE user_id % 3 = 1 UNION ALL SELECT 't/' || event_type, 'mapsTo', 'u/' || (user_id % 20) FROM events WHERE user_id % 3 = 2)""")
def triples_from_chunk_meta(t):
    u = F.expr("'u/' || (user_id % 20)")
    named = lambda p: F.concat(F.lit(p), "event_type")
    x = F.when(F.col("user_id") % 3 == 0, F.struct(named("m/").alias("s"), F.lit("computedFrom").alias("p"), u.alias("o"))).when(F.col("user_id") % 3 == 1, F.struct(u.alias("s"), F.lit("joinableWith").alias("p"), named("v/").alias("o"))).otherwise(F.struct(named("t/").alias("s"), F.lit("mapsTo").alias("p"), u.alias("o")))
    return t.events.select(x.alias("x")).select("x.*").distinct()


@query("""SELECT 'table/' || s_suppkey AS s, unnest(['type', 'label', 'platform']) AS p, unnest(['PhysicalTable', s_name, 'db' || s_nationkey]) AS o, unnest([true, false, false]) AS iri FROM supplier""")
def triples_from_catalog(t):
    return C.flatten(t.supplier, F.expr("'table/' || s_suppkey"), {"type": (F.lit("PhysicalTable"), True), "label": (F.col("s_name"), False), "platform": (F.expr("'db' || s_nationkey"), False)})


@query("""SELECT kind, min(a) AS a, min(b) AS b FROM (SELECT 'term_column' AS kind, c_mktsegment AS a, 'n' || c_nationkey AS b FROM customer UNION ALL SELECT 'metric_table', upper(c_mktsegment), 'n' || c_nationkey FROM customer UNION ALL SELECT 'term_column', lower(c_mktsegment), 'N' || c_nationkey FROM customer) GROUP BY kind, lower(a), lower(b)""")
def relation_edges(t):
    c = t.customer
    make = lambda kind, a, b: c.select(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))
    every = make("term_column", F.col("c_mktsegment"), F.expr("'n' || c_nationkey")).unionByName(make("metric_table", F.upper("c_mktsegment"), F.expr("'n' || c_nationkey"))).unionByName(make("term_column", F.lower("c_mktsegment"), F.expr("'N' || c_nationkey")))
    return every.groupBy("kind", F.lower("a").alias("la"), F.lower("b").alias("lb")).agg(F.min("a").alias("a"), F.min("b").alias("b")).select("kind", "a", "b")


@query("""SELECT DISTINCT 'class/' || p_brand AS s, p, CASE p WHEN 'type' THEN 'Class' WHEN 'subClassOf' THEN 'Part' ELSE p_brand END AS o, p <> 'label' AS iri FROM part CROSS JOIN (SELECT unnest(['type', 'subClassOf', 'label']) AS p)""")
def triples_from_subclasses(t):
    brands = t.part.select("p_brand").distinct()
    return C.flatten(brands, F.concat(F.lit("class/"), "p_brand"), {"type": (F.lit("Class"), True), "subClassOf": (F.lit("Part"), True), "label": (F.col("p_brand"), False)})


@query(f"WITH x AS (SELECT DISTINCT n FROM (SELECT s AS n FROM {KG} UNION ALL SELECT o FROM {KG} WHERE iri) WHERE n LIKE 's/%') SELECT n AS s, 'sameAs' AS p, 'supplier/' || substr(n, 3) AS o FROM x UNION ALL SELECT 'supplier/' || substr(n, 3), 'sameAs', n FROM x")
def iri_bridge(t):
    triples = kg(t)
    old = triples.select(F.col("s").alias("n")).unionByName(triples.where("iri").select(F.col("o").alias("n"))).where("n like 's/%'").distinct()
    new = F.concat(F.lit("supplier/"), F.substring("n", 3, 100))
    both = F.array(F.struct(F.col("n").alias("s"), F.lit("sameAs").alias("p"), new.alias("o")), F.struct(new.alias("s"), F.lit("sameAs").alias("p"), F.col("n").alias("o")))
    return old.select(F.explode(both).alias("x")).select("x.*")


@query("SELECT 'p/' || l_partkey AS s, 'suppliedBy' AS p, 's/' || l_suppkey AS o, l_returnflag AS source, floor(least(100.0::DOUBLE, greatest(0.0::DOUBLE, l_quantity * 3 - 10)) * 10 + 0.5 + 1e-7) / 10 AS confidence FROM lineitem WHERE l_returnflag <> 'A'")
def clean_normalise(t):
    odd = raw(t).withColumn("s", F.concat(F.lit("  "), "s", F.lit(" "))).withColumn("o", F.when(F.col("source") == "A", " ").otherwise(F.col("o")))
    wide = t.lineitem.select((F.col("l_quantity") * 3 - 10).alias("confidence"), F.concat(F.lit("  p/"), "l_partkey", F.lit(" ")).alias("s"), F.lit("suppliedBy").alias("p"), F.when(F.col("l_returnflag") == "A", " ").otherwise(F.concat(F.lit("s/"), "l_suppkey")).alias("o"), F.col("l_returnflag").alias("source"))
    return C.normalise(wide.select(odd.columns))


_LINKED = "SELECT 'p/' || p_partkey AS s, 'computedFrom' AS p, CASE WHEN p_partkey % 3 = 2 THEN 'nowhere_' || p_partkey ELSE 'table_' || (p_partkey % 90 + 1) END AS o FROM part"


@query(f"SELECT s, p, CASE WHEN known THEN 'table/' || substr(o, 7) ELSE o END AS o, CASE WHEN known THEN 'linked' ELSE 'unresolved' END AS state FROM (SELECT *, o IN (SELECT 'table_' || s_suppkey FROM supplier) AS known FROM ({_LINKED}))")
def clean_link_tables(t):
    o = F.when(F.col("p_partkey") % 3 == 2, F.concat(F.lit("nowhere_"), "p_partkey")).otherwise(F.concat(F.lit("table_"), F.col("p_partkey") % 90 + 1))
    made = t.part.select(F.expr("'p/' || p_partkey").alias("s"), F.lit("computedFrom").alias("p"), o.alias("o"))
    good, bad = C.link_tables(made, _tables(t), ("computedFrom",))
    return good.withColumn("state", F.lit("linked")).unionByName(bad.withColumnRenamed("reason", "state"))


@query(f"""SELECT query, id AS best, sim, CASE WHEN sim >= 0.40 THEN 'merge' WHEN sim >= 0.30 THEN 'quarantine' ELSE 'new' END AS decision FROM {_SIMS} WHERE id % 50 <> 0 QUALIFY row_number() OVER (PARTITION BY query ORDER BY sim DESC, id) = 1""")
def clean_disambiguate(t):
    q, rows = _vectors(t)
    return C.disambiguate(q, rows.where("id % 50 <> 0"), 0.40, 0.30)


@query(f"""WITH m AS (SELECT query, id FROM {_SIMS} WHERE id % 50 <> 0 AND sim >= 0.40 QUALIFY row_number() OVER (PARTITION BY query ORDER BY sim DESC, id) = 1),
  e AS (SELECT vec_id AS s, 'label' AS p, label::VARCHAR AS o, false AS iri FROM embeddings UNION ALL SELECT vec_id, 'near', (vec_id - vec_id % 50)::VARCHAR, true FROM embeddings)
  SELECT CAST(coalesce(x.id, e.s) AS VARCHAR) AS s, p, CASE WHEN iri THEN coalesce(CAST(y.id AS VARCHAR), o) ELSE o END AS o, iri FROM e LEFT JOIN m x ON x.query = e.s LEFT JOIN m y ON e.iri AND CAST(y.query AS VARCHAR) = e.o""")
def clean_disambiguate_rewrite(t):
    """Both ends of triples take the name of the known entity that they are merged into."""
    q, rows = _vectors(t)
    merges = L.decide(q, rows.where("id % 50 <> 0"), 0.40, 0.30).where("decision = 'merge'")
    names = L.canonical(merges.select("node", "into")).select(F.col("node").cast("string").alias("node"), F.col("canonical").cast("string").alias("canonical"))
    s = F.col("vec_id").cast("string").alias("s")
    own = t.embeddings.select(s, F.lit("label").alias("p"), F.col("label").cast("string").alias("o"), F.lit(False).alias("iri"))
    near = t.embeddings.select(s, F.lit("near").alias("p"), (F.col("vec_id") - F.col("vec_id") % 50).cast("string").alias("o"), F.lit(True).alias("iri"))
    return L.rewrite(own.unionByName(near), names)


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, id) AS n FROM {_SIMS} WHERE id % 50 <> 0 QUALIFY n <= 3)
  SELECT query AS node, string_agg(id::VARCHAR, '|' ORDER BY n) FILTER (sim >= 0.30) AS candidates FROM r GROUP BY 1 HAVING max(sim) >= 0.30 AND max(sim) < 0.40""")
def clean_disambiguate_quarantine(t):
    """Entities that may be known ones, with the three likeliest."""
    q, rows = _vectors(t)
    asked = L.decide(q, rows.where("id % 50 <> 0"), 0.40, 0.30).where("decision = 'arbitrate'")
    return asked.select("node", F.array_join("candidates", "|").alias("candidates"))


_PREDICATES = ("type", "label", "altLabel", "broader", "groundedBy", "derivedFrom", "computedFrom", "joinableWith", "transformsFrom", "suppliedBy", "linkMethod")
_KNOWN = "(SELECT unnest(" + repr(list(_PREDICATES)) + ") AS x)"
_LABEL = r"lower(regexp_replace(regexp_replace(regexp_extract(x, '([^/#:]*)$', 1), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[_\-\s]+', ' ', 'g'))"


def _letters(names):
    return f"(SELECT x, pair, count(*) AS n FROM (SELECT x, unnest(list_transform(range(1, length(l)), lambda i: substr(l, i, 2))) AS pair FROM (SELECT x, ' ' || {_LABEL} || ' ' AS l FROM {names})) GROUP BY 1, 2)"


def _near(unknown):
    """(x, best, sim, suggestions) for each distinct x of `unknown` that has a known predicate at 0.60 or more."""
    width = lambda g: f"(SELECT x, sqrt(sum(n * n)) AS w FROM {g} GROUP BY 1)"
    return f"""(WITH a AS MATERIALIZED (SELECT * FROM {_letters(f'(SELECT DISTINCT x FROM {unknown})')}), b AS MATERIALIZED (SELECT * FROM {_letters(_KNOWN)}),
      d AS (SELECT a.x, b.x AS known, sum(a.n * b.n) AS dot FROM a JOIN b USING (pair) GROUP BY 1, 2),
      c AS (SELECT d.x, known, floor(dot / (u.w * v.w) * 1e6 + 0.5) / 1e6 AS sim FROM d JOIN {width('a')} u ON u.x = d.x JOIN {width('b')} v ON v.x = d.known),
      r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY sim DESC, known) AS k FROM c WHERE sim >= 0.60 QUALIFY k <= 3)
      SELECT x, arg_min(known, k) AS best, max(sim) AS sim, string_agg(known, '|' ORDER BY k) AS suggestions FROM r GROUP BY 1)"""


_ODD = f"""(SELECT s, CASE WHEN p = 'label' AND s LIKE 'p/%' THEN 'labell' WHEN p = 'label' AND s LIKE 'c/%' THEN 'pref_label' WHEN p = 'formula' THEN 'strange' WHEN p = 'groundedBy' THEN 'http://x.org/v#grounded-by' WHEN p = 'status' THEN 'own:status' ELSE p END AS p, o FROM {KG})"""


@query(f"""WITH k AS MATERIALIZED (SELECT * FROM {_ODD}), n AS MATERIALIZED (SELECT * FROM {_near("(SELECT p AS x FROM k WHERE p NOT LIKE 'own:%' AND p NOT IN (SELECT x FROM " + _KNOWN + "))")}),
  t AS (SELECT k.*, n.best, n.sim, n.suggestions, p LIKE 'own:%' OR p IN (SELECT x FROM {_KNOWN}) AS known FROM k LEFT JOIN n ON n.x = k.p)
  SELECT s, CASE WHEN sim >= 0.85 THEN best ELSE p END AS p, o, CASE WHEN known OR sim >= 0.85 THEN NULL WHEN sim IS NULL THEN 'unknown_predicate' ELSE 'unknown_predicate_fuzzy' END AS reason, CASE WHEN sim < 0.85 THEN suggestions ELSE '' END AS suggestions FROM t""")
def clean_predicates(t):
    p = F.when((F.col("p") == "label") & F.startswith("s", F.lit("p/")), "labell").when((F.col("p") == "label") & F.startswith("s", F.lit("c/")), "pref_label").when(F.col("p") == "formula", "strange").when(F.col("p") == "groundedBy", "http://x.org/v#grounded-by").when(F.col("p") == "status", "own:status").otherwise(F.col("p"))
    return L.map_predicates(kg(t).select("s", p.alias("p"), "o"), _predicates(t), "own:").withColumn("suggestions", F.array_join("suggestions", "|"))


def _predicates(t):
    return t.spark.createDataFrame([(x,) for x in _PREDICATES], "predicate string")


_FUSED = f"(SELECT s, p, o, {_ONE.format('100 * (1 - product(1 - confidence / 100))')} AS confidence, count(DISTINCT source) AS sources FROM {RAW} GROUP BY 1, 2, 3)"


@query(f"SELECT * FROM {_FUSED}")
def clean_fuse(t):
    return C.fuse(raw(t))


_JUDGED = f"(SELECT *, first_value(o) OVER (PARTITION BY s, p ORDER BY sources DESC, confidence DESC, o) AS winner FROM {_FUSED})"


@query(f"SELECT * FROM {_JUDGED}")
def clean_conflict(t):
    return C.conflicts(C.fuse(raw(t)))


@query(f"SELECT DISTINCT CASE WHEN p = 'joinableWith' THEN least(s, o) ELSE s END AS s, p, CASE WHEN p = 'joinableWith' THEN greatest(s, o) ELSE o END AS o FROM (SELECT s, p, o FROM {KG} UNION ALL SELECT o, p, s FROM {KG} WHERE p = 'joinableWith')")
def clean_dedup(t):
    triples = kg(t).select("s", "p", "o")
    return C.deduplicate(triples.unionByName(triples.where("p = 'joinableWith'").select(F.col("o").alias("s"), "p", F.col("s").alias("o"))))


@query(f"SELECT s, CASE WHEN max(confidence) >= 99.9 THEN 'approved' ELSE 'draft' END AS status FROM {_FUSED} GROUP BY 1")
def clean_status_gate(t):
    return C.status_gate(C.fuse(raw(t)), 99.9)


#: Line items as raw triples of every kind that a stage of cleaning looks at.
_KINDS = {
    "s": "CASE WHEN l_linenumber % 4 = 3 THEN ' p/' || l_partkey || ' ' ELSE 'p/' || l_partkey END",
    "p": "CASE l_linenumber % 7 WHEN 0 THEN 'computedFrom' WHEN 1 THEN 'suppliedBy' WHEN 2 THEN 'supplied_by' WHEN 3 THEN 'suppliedFor' WHEN 4 THEN 'own:note' WHEN 5 THEN 'joinableWith' ELSE 'odd' END",
    "o": "CASE WHEN l_quantity > 49 THEN ' ' WHEN l_linenumber % 7 = 0 AND l_partkey % 3 = 2 THEN 'nowhere_' || l_suppkey WHEN l_linenumber % 7 = 0 THEN 'table_' || l_suppkey WHEN l_linenumber % 7 = 5 THEN 'p/' || (l_suppkey * 10) ELSE 's/' || l_suppkey END",
    "source": "l_returnflag",
    "confidence": "CASE WHEN l_tax = 0 THEN NULL ELSE floor(1000 * (1 - l_discount) + 0.5) / 10 END",
}
_FUNCTIONAL = ["suppliedBy", "computedFrom"]
_STAGES = f"""raw AS MATERIALIZED (SELECT {', '.join(f'{e} AS {c}' for c, e in _KINDS.items())} FROM lineitem),
  syntax AS MATERIALIZED (SELECT trim(s) AS s, trim(p) AS p, trim(o) AS o, source, floor(least(100.0::DOUBLE, greatest(0.0::DOUBLE, coalesce(confidence, 70.0::DOUBLE))) * 10 + 0.5 + 1e-7) / 10 AS confidence FROM raw WHERE trim(o) <> ''),
  linked AS MATERIALIZED (SELECT *, p = 'computedFrom' AS named, p = 'computedFrom' AND o IN (SELECT 'table_' || s_suppkey FROM supplier) AS found FROM syntax),
  after_link AS MATERIALIZED (SELECT s, p, CASE WHEN found THEN 'table/' || substr(o, 7) ELSE o END AS o, source, CASE WHEN found THEN 95.0 ELSE confidence END AS confidence FROM linked WHERE found OR NOT named
    UNION ALL SELECT s, 'linkMethod', 'exact', source, 95.0 FROM linked WHERE found),
  near AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, id) AS k FROM {_SIMS} WHERE id % 50 <> 0 QUALIFY k <= 3),
  merged AS MATERIALIZED (SELECT 'p/' || query AS node, 'p/' || id AS canonical FROM near WHERE k = 1 AND sim >= 0.40),
  asked AS MATERIALIZED (SELECT 'p/' || query AS s, string_agg('p/' || id, '|' ORDER BY k) FILTER (sim >= 0.30) AS suggestions FROM near GROUP BY query HAVING max(sim) >= 0.30 AND max(sim) < 0.40 AND 'p/' || query IN (SELECT s FROM after_link)),
  renamed AS MATERIALIZED (SELECT coalesce(x.canonical, a.s) AS s, p, coalesce(y.canonical, a.o) AS o, source, confidence FROM after_link a LEFT JOIN merged x ON x.node = a.s LEFT JOIN merged y ON y.node = a.o),
  alike AS MATERIALIZED (SELECT * FROM {_near("(SELECT p AS x FROM renamed WHERE p NOT LIKE 'own:%' AND p NOT IN (SELECT x FROM " + _KNOWN + "))")}),
  told AS MATERIALIZED (SELECT r.s, CASE WHEN sim >= 0.85 THEN best ELSE p END AS p, o, source, confidence, CASE WHEN p LIKE 'own:%' OR p IN (SELECT x FROM {_KNOWN}) OR sim >= 0.85 THEN NULL WHEN sim IS NULL THEN 'unknown_predicate' ELSE 'unknown_predicate_fuzzy' END AS reason, CASE WHEN sim < 0.85 THEN suggestions ELSE '' END AS suggestions FROM renamed r LEFT JOIN alike ON alike.x = r.p),
  fused AS MATERIALIZED (SELECT s, p, o, {_ONE.format('100 * (1 - product(1 - confidence / 100))')} AS confidence, count(DISTINCT source) AS sources FROM told WHERE reason IS NULL GROUP BY 1, 2, 3),
  judged AS MATERIALIZED (SELECT *, CASE WHEN p IN ('suppliedBy', 'computedFrom') THEN first_value(o) OVER (PARTITION BY s, p ORDER BY sources DESC, confidence DESC, o) ELSE o END AS winner FROM fused),
  once AS MATERIALIZED (SELECT CASE WHEN p = 'joinableWith' THEN least(s, o) ELSE s END AS s2, p, CASE WHEN p = 'joinableWith' THEN greatest(s, o) ELSE o END AS o2, max(confidence) AS confidence FROM judged WHERE o = winner GROUP BY 1, 2, 3),
  production AS MATERIALIZED (SELECT s2 AS s, p, o2 AS o, confidence FROM once UNION ALL SELECT s2, 'approvalStatus', CASE WHEN max(confidence) >= 99.9 THEN 'approved' ELSE 'draft' END, 100.0 FROM once GROUP BY s2)"""


def _cleaned(t):
    made = t.lineitem.select(*(F.expr(e).alias(c) for c, e in _KINDS.items()))
    q, rows = _vectors(t)
    name = lambda c: F.concat(F.lit("p/"), F.col(c).cast("string")).alias(c)
    told = L.decide(q, rows.where("id % 50 <> 0"), 0.40, 0.30)
    told = told.select(name("node"), "decision", name("into"), F.transform("candidates", lambda x: F.concat(F.lit("p/"), x)).alias("candidates"))
    return L.run(made, _tables(t), told, _predicates(t), "own:", ("computedFrom",), _FUNCTIONAL, 99.9)


@query(f"""WITH {_STAGES}
  SELECT 'production' AS stage, s, p, o, confidence, '' AS suggestions FROM production
  UNION ALL SELECT 'unresolved_table_ref', s, p, o, confidence, '' FROM linked WHERE named AND NOT found
  UNION ALL SELECT 'entity_arbitrate', s, NULL, NULL, NULL, suggestions FROM asked
  UNION ALL SELECT reason, s, p, o, confidence, suggestions FROM told WHERE reason IS NOT NULL
  UNION ALL SELECT 'conflict', s, p, o, confidence, winner FROM judged WHERE o <> winner""")
def clean_pipeline(t):
    """All stages of cleaning, with what each holds back and why."""
    return _cleaned(t).rows().withColumn("suggestions", F.array_join("suggestions", "|"))


@query(f"""WITH {_STAGES} SELECT unnest(['input', 'syntax', 'link', 'quarantine_link', 'quarantine_disambiguate', 'predicates', 'quarantine_predicates', 'conflict', 'quarantine_conflict', 'production']) AS stage,
  unnest([(SELECT count(*) FROM raw), (SELECT count(*) FROM syntax), (SELECT count(*) FROM after_link), (SELECT count(*) FROM linked WHERE named AND NOT found), (SELECT count(*) FROM asked), (SELECT count(*) FROM told WHERE reason IS NULL), (SELECT count(*) FROM told WHERE reason IS NOT NULL),
    (SELECT count(*) FROM judged WHERE o = winner), (SELECT count(*) FROM judged WHERE o <> winner), (SELECT count(*) FROM production)]) AS n""")
def clean_pipeline_counts(t):
    """How many rows enter and leave each stage, observed while the stages ran."""
    return t.spark.createDataFrame(list(_cleaned(t).counts.items()), "stage string, n bigint")


def _status_shapes(graph):
    """Subjects need a status, which is one of two words."""
    typed = graph.select("s", F.lit("type").alias("p"), F.lit("Any").alias("o")).distinct()
    kg_ = graph.select("s", "p", "o").unionByName(typed).withColumn("iri", F.lit(False))
    spark = graph.sparkSession
    need = spark.createDataFrame([("Any", "approvalStatus", 1, "Violation")], "class string, path string, least int, severity string")
    words = spark.createDataFrame([("Any", "approvalStatus", "in", ["approved", "draft"], None, None, "Violation")], "class string, path string, kind string, allowed array<string>, low double, high double, severity string")
    return V.min_count(kg_, need).unionByName(V.values(kg_, words))


@query(f"""WITH {_STAGES} SELECT s, p, o, confidence FROM production""")
def clean_publish(t):
    """The published graph after a batch that conforms, and after one without status that is blocked by its shapes."""
    store = f"{shared_folder(t.spark)}/graph-{uuid.uuid4().hex}"
    good = _cleaned(t).production.select("s", "p", "o", "confidence")
    bad = kg(t).where("p = 'label'").select("s", "p", "o", F.lit(100.0).alias("confidence"))
    told = [L.publish(batch, _status_shapes, store)[0] for batch in (good, bad)]
    if told != [True, False]:
        raise RuntimeError(f"published: {told}")
    return L.published(t.spark, store, good)


@query(f"SELECT s, p, o, winner FROM {_JUDGED} WHERE o <> winner ORDER BY s, p, o LIMIT 50 OFFSET 25")
def quarantine_page(t):
    return C.clean(raw(t)).where("stage = 'conflict'").orderBy("s", "p", "o").offset(25).limit(50).select("s", "p", "o", "winner")


def _items(t):
    return t.orders.select(F.col("o_orderkey").alias("item_id"), F.expr("'p/' || o_custkey").alias("s"), F.lit("computedFrom").alias("p"), F.col("o_orderpriority").alias("o"), F.array(F.expr("'x' || o_orderkey")).alias("suggestions"))


@query("""SELECT o_orderkey AS item_id, 'p/' || o_custkey AS s, 'computedFrom' AS p, CASE o_orderkey % 5 WHEN 0 THEN o_orderpriority WHEN 2 THEN 'table/' || o_custkey WHEN 3 THEN 'x' || o_orderkey END AS o, CASE o_orderkey % 5 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' WHEN 2 THEN 'map' WHEN 3 THEN 'pick' ELSE 'wait' END AS decision, CASE o_orderkey % 5 WHEN 1 THEN 'dropped' WHEN 4 THEN 'open' ELSE 'recheck' END AS state FROM orders""")
def quarantine_resolve(t):
    key = F.col("o_orderkey")
    decision = F.when(key % 5 == 0, "approve").when(key % 5 == 1, "reject").when(key % 5 == 2, "map").when(key % 5 == 3, "pick")
    return C.quarantine_decide(_items(t), t.orders.where("o_orderkey % 5 < 4").select(key.alias("item_id"), decision.alias("decision"), F.col("o_custkey").cast("string").alias("target")))


@query("SELECT o_orderkey AS item_id, 'table/' || o_custkey AS o FROM orders WHERE o_orderkey % 5 = 2")
def quarantine_fix(t):
    return quarantine_resolve(t).where("decision = 'map'").select("item_id", "o")


@query(f"SELECT s, p, o, CASE WHEN sources = 1 THEN 'drop' ELSE 'pick_first' END AS template FROM {_JUDGED} WHERE o <> winner AND s LIKE 'p/1%'")
def quarantine_match(t):
    found = C.clean(raw(t)).where("stage = 'conflict' and s like 'p/1%'")
    return found.select("s", "p", "o", F.when(F.col("sources") == 1, "drop").otherwise("pick_first").alias("template"))


_B = "CASE o_orderkey % 4 WHEN 0 THEN 'draft' WHEN 1 THEN 'linked' WHEN 2 THEN 'pending_review' ELSE 'approved' END"
_A = "CASE o_orderkey % 3 WHEN 0 THEN 'linked' WHEN 1 THEN 'approved' ELSE 'rejected' END"


@query(f"""SELECT 'o/' || o_orderkey AS s, b AS before, a AS after, ok, CASE WHEN ok THEN a ELSE b END AS status, CASE WHEN NOT ok THEN 'transition not allowed' END AS reason FROM (SELECT *, (b, a) IN (('draft', 'linked'), ('pending_review', 'approved'), ('pending_review', 'rejected'), ('draft', 'rejected')) AS ok FROM (SELECT o_orderkey, {_B} AS b, {_A} AS a FROM orders))""")
def promote_status(t):
    return C.promote(t.orders.select(F.expr("'o/' || o_orderkey").alias("s"), F.expr(_B).alias("before"), F.expr(_A).alias("after")), t.spark)


_NEXT = f"(SELECT s, p, CASE WHEN p = 'label' AND s LIKE '%5' THEN o || ' new' ELSE o END AS o FROM {KG} WHERE NOT (p = 'broader' AND s LIKE '%7') UNION ALL SELECT DISTINCT s, 'note', 'added' FROM {KG} WHERE s LIKE '%3')"


def _next(t):
    triples = kg(t)
    o = F.when((F.col("p") == "label") & F.col("s").like("%5"), F.concat("o", F.lit(" new"))).otherwise(F.col("o"))
    return triples.where("not (p = 'broader' and s like '%7')").select("s", "p", o.alias("o")).unionByName(triples.where("s like '%3'").select("s", F.lit("note").alias("p"), F.lit("added").alias("o")).distinct())


@query(f"""WITH a AS (SELECT s, p, o FROM {KG}), b AS (SELECT * FROM {_NEXT}), plus AS (SELECT * FROM b EXCEPT SELECT * FROM a), less AS (SELECT * FROM a EXCEPT SELECT * FROM b)
  SELECT coalesce(x.s, y.s) AS s, coalesce(x.p, y.p) AS p, coalesce(added, []::VARCHAR[]) AS added, coalesce(removed, []::VARCHAR[]) AS removed FROM (SELECT s, p, list_sort(list(o)) AS added FROM plus GROUP BY 1, 2) x FULL JOIN (SELECT s, p, list_sort(list(o)) AS removed FROM less GROUP BY 1, 2) y ON x.s = y.s AND x.p = y.p""")
def version_diff(t):
    return C.version_diff(kg(t).select("s", "p", "o"), _next(t))


@query(f"""WITH a AS (SELECT s, p, o FROM {KG}), b AS (SELECT * FROM {_NEXT}), c AS (SELECT s FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION SELECT s FROM (SELECT * FROM a EXCEPT SELECT * FROM b))
  SELECT s, 'version' AS p, CASE WHEN s LIKE 'c/%' THEN CAST(CAST(substr(s, 3) AS BIGINT) % 4 + 2 AS VARCHAR) ELSE '2' END AS o FROM c
  UNION ALL SELECT s, 'changeNote', 'label of ' || s FROM c WHERE s LIKE 'p/%'
  UNION ALL SELECT 'c/' || c_custkey, 'certificationStatus', 'deprecated' FROM customer WHERE c_custkey % 50 = 0 UNION ALL SELECT 'c/' || c_custkey, 'changeNote', 'Deprecated: ' || c_mktsegment FROM customer WHERE c_custkey % 100 = 0""")
def version_write(t):
    """Changed subjects take their next version and a note; some are deprecated, half of them for a reason."""
    versions = t.customer.select(F.expr("'c/' || c_custkey").alias("s"), (F.col("c_custkey") % 4 + 1).alias("version"))
    notes = t.part.select(F.expr("'p/' || p_partkey").alias("s"), F.expr("'label of p/' || p_partkey").alias("note"))
    gone = t.customer.where("c_custkey % 50 = 0").select(F.expr("'c/' || c_custkey").alias("s"), F.when(F.col("c_custkey") % 100 == 0, F.col("c_mktsegment")).alias("reason"))
    return L.with_version(version_diff(t), versions, notes).unionByName(L.deprecated(gone))


_GONE = f"(SELECT s AS x FROM {KG} WHERE p = 'groundedBy' AND o IN ('chunk/1', 'chunk/2', 'chunk/3') UNION SELECT unnest(['chunk/1', 'chunk/2', 'chunk/3']))"


@query(f"SELECT s, p, o FROM {KG} WHERE s NOT IN (SELECT x FROM {_GONE}) AND o NOT IN (SELECT x FROM {_GONE})")
def cascade_delete(t):
    chunks = t.spark.createDataFrame([("chunk/1",), ("chunk/2",), ("chunk/3",)], "chunk string")
    return C.cascade(kg(t).select("s", "p", "o"), chunks)


@query("SELECT 'orders' AS kind, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0) UNION ALL SELECT 'customers', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 5 <> 0) UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)")
def orphans(t):
    parts = [
        ("orders", C.orphans(t.orders, t.customer.where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"])),
        ("customers", C.orphans(t.customer, t.nation.where("n_nationkey % 5 <> 0").select(F.col("n_nationkey").alias("c_nationkey")), ["c_nationkey"])),
        ("labels", C.orphans(t.labels, t.documents.where("doc_id % 3 <> 0").select("doc_id"), ["doc_id"])),
    ]
    out = None
    for kind, rows in parts:
        one = rows.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT source AS source_key, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END, n_chars DESC, doc_id) = 1")
def source_dedup(t):
    from strataloom.operators.retrieval import best

    return best(t.documents, ["source"], [(F.col("doc_id") % 2).asc(), F.desc("n_chars"), F.asc("doc_id")], 1).select(F.col("source").alias("source_key"), "doc_id")


@query("SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'deleted' WHEN doc_id % 7 = 0 THEN 'updated' ELSE 'unchanged' END AS action FROM documents UNION ALL SELECT doc_id + 1000000, 'created' FROM documents WHERE doc_id % 13 = 0")
def incremental_sync(t):
    body = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = t.documents.where("doc_id % 11 <> 0").select("doc_id", body.alias("text")).unionByName(t.documents.where("doc_id % 13 = 0").select((F.col("doc_id") + 1000000).alias("doc_id"), "text"))
    return C.sync(t.documents, new, "doc_id", "text")


@query(f"SELECT DISTINCT s, p, o, iri FROM {KG}")
def triples_read(t):
    return C.from_lines(C.to_lines(kg(t))).distinct()


@query(f"SELECT DISTINCT s, p, o, iri, g FROM {KG}")
def graph_insert(t):
    triples = kg(t)
    return triples.unionByName(triples.where("p = 'label'")).dropDuplicates(["s", "p", "o", "g"])


@query(f"SELECT s, p, o, iri, g FROM {KG} WHERE g <> 'g1'")
def graph_clear(t):
    return kg(t).where("g <> 'g1'")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'v2 ' || text ELSE text END AS content FROM documents")
def chunk_upsert(t):
    new = t.documents.where("doc_id % 4 = 0").select("doc_id", F.concat(F.lit("v2 "), "text").alias("content"))
    return t.documents.select("doc_id", F.col("text").alias("content")).join(new.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(new)
