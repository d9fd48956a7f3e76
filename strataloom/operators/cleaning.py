"""Cleaning raw triples in stages, and publishing what passes.

Raw triples have s, p, o, source, confidence. Each stage tags the rows that it holds back with a reason and
suggestions, is written once with its counts observed on the way, and hands on the others; so neither what is kept nor what
is held back is computed twice. What is published is written as a snapshot first, which counts only when a manifest names it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from strataloom.functions.numbers import rounded
from strataloom.functions.storage import materialise
from strataloom.operators.reasoning import components
from strataloom.operators.retrieval import best, resolve_refs, vec_topk
from strataloom.operators.triples import APPROVE_FROM, conflicts, fuse, normalise, status_gate

#: Similarity from which two names are one, and from which they may be.
SAME, MAYBE = 0.85, 0.60
SUGGESTED = 3
LINKED_CONFIDENCE = 95.0
NO_SUGGESTION = "CAST(array() AS array<string>)"


def label_of(iri: Column) -> Column:
    """What follows the last /, # or : of a name, in lower case, with a space for each change of case, underscore or hyphen."""
    last = F.regexp_extract(iri, "([^/#:]*)$", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(last, "([a-z0-9])([A-Z])", "$1 $2"), r"[_\-\s]+", " "))


def _pairs_of_letters(names: DataFrame, name: str) -> DataFrame:
    """(name, pair, n, length): how often each pair of neighbouring letters stands in a name's label, borders included, and the length of these counts as a vector."""
    bordered = names.select(name, F.concat(F.lit(" "), label_of(F.col(name)), F.lit(" ")).alias("label"))
    each = bordered.select(name, F.explode(F.transform(F.sequence(F.lit(1), F.length("label") - 1), lambda i: F.substring("label", i, F.lit(2)))).alias("pair"))
    counted = each.groupBy(name, "pair").agg(F.count("*").alias("n"))
    length = counted.groupBy(name).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("length"))
    return counted.join(length, name)


def nearest_names(asked: DataFrame, known: DataFrame, least: float = MAYBE, k: int = SUGGESTED) -> DataFrame:
    """(p, predicate, sim, rank): the k known predicates whose labels are most alike to each asked p, from `least` on.

    Likeness is the cosine of the counts of letter pairs, so only names that share a pair meet. Known predicates are a small table.
    """
    a = _pairs_of_letters(asked.select("p").distinct(), "p")
    b = _pairs_of_letters(known.select("predicate").distinct(), "predicate").select("predicate", "pair", F.col("n").alias("m"), F.col("length").alias("width"))
    dots = a.join(b, "pair").groupBy("p", "predicate", "length", "width").agg(F.sum(F.col("n") * F.col("m")).alias("dot"))
    sims = dots.select("p", "predicate", rounded(F.col("dot") / (F.col("length") * F.col("width")), 6).alias("sim"))
    return best(sims.where(F.col("sim") >= least), ["p"], [F.desc("sim"), F.asc("predicate")], k)


def map_predicates(triples: DataFrame, known: DataFrame, prefix: str, same: float = SAME, maybe: float = MAYBE) -> DataFrame:
    """Triples with p mapped, reason and suggestions.

    Known predicates and those of the own prefix pass; others become the nearest known one if it is alike enough, or
    are held back, with suggestions if there are any. Only distinct unknown predicates are compared.
    """
    unknown = triples.select("p").distinct().join(known.select(F.col("predicate").alias("p")), "p", "left_anti").where(~F.startswith("p", F.lit(prefix)))
    near = nearest_names(unknown, known, maybe).groupBy("p").agg(F.array_sort(F.collect_list(F.struct("rank", "predicate", "sim"))).alias("near"))
    told = unknown.join(near, "p", "left").select("p", F.lit(True).alias("odd"), "near")
    first = F.get("near", F.lit(0))
    sure = F.coalesce(first["sim"] >= same, F.lit(False))
    reason = F.when(F.col("odd").isNull() | sure, None).when(F.col("near").isNull(), "unknown_predicate").otherwise("unknown_predicate_fuzzy")
    names = F.when(sure | F.col("near").isNull(), F.expr(NO_SUGGESTION)).otherwise(F.transform("near", lambda x: x["predicate"]))
    rest = [c for c in triples.columns if c != "p"]
    return triples.join(told, "p", "left").select(F.when(sure, first["predicate"]).otherwise(F.col("p")).alias("p"), *rest, reason.alias("reason"), names.alias("suggestions")).select(*triples.columns, "reason", "suggestions")


def link(triples: DataFrame, tables: DataFrame, predicates: tuple[str, ...]) -> DataFrame:
    """Triples with reason and suggestions; objects of some predicates become table ids, each with a triple that says how it was linked."""
    named = F.col("p").isin(*predicates)
    told = resolve_refs(triples.where(named).select(F.col("o").alias("ref")), tables).select("ref", "status", "table_id")
    joined = triples.join(told, named & (F.col("o") == F.col("ref")), "left")
    reason = F.when(named & (F.col("status") != "exact"), F.concat("status", F.lit("_table_ref")))
    linked = named & (F.col("status") == "exact")
    rest = [c for c in triples.columns if c not in ("p", "o", "confidence")]
    row = lambda p, o, c: F.struct(*(F.col(x) for x in rest), p.alias("p"), o.alias("o"), c.alias("confidence"))
    sure = F.lit(LINKED_CONFIDENCE)
    table = F.concat(F.lit("table/"), F.col("table_id").cast("string"))
    made = F.when(linked, F.array(row(F.col("p"), table, sure), row(F.lit("linkMethod"), F.col("status"), sure))).otherwise(F.array(row(F.col("p"), F.col("o"), F.col("confidence"))))
    return joined.select(F.explode(made).alias("x"), reason.alias("reason")).select(*(F.col(f"x.{c}").alias(c) for c in triples.columns), "reason", F.expr(NO_SUGGESTION).alias("suggestions"))


def decide(new: DataFrame, known: DataFrame, same: float = SAME, maybe: float = MAYBE) -> DataFrame:
    """(node, decision, into, candidates): merge, arbitrate or new for each new entity (query, qv) by its nearest known (id, vector).

    Candidates are the nearest three from `maybe` on.
    """
    near = vec_topk(new, known, SUGGESTED).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "sim"))).alias("near"))
    first = F.get("near", F.lit(0))
    decision = F.when(first["sim"] >= same, "merge").when(first["sim"] >= maybe, "arbitrate").otherwise("new")
    likely = F.transform(F.filter("near", lambda x: x["sim"] >= maybe), lambda x: x["id"].cast("string"))
    return near.select(F.col("query").alias("node"), decision.alias("decision"), F.when(decision == "merge", first["id"]).alias("into"), likely.alias("candidates"))


def canonical(merges: DataFrame) -> DataFrame:
    """(node, canonical) for all nodes that merges (node, into) rename: chains and several merges into one end at one entity.

    That is the smallest of a connected component that is itself merged into nothing, or the smallest if all are.
    """
    edges = merges.select(F.col("node").alias("a"), F.col("into").alias("b")).where("a <> b").distinct()
    roots = materialise(components(edges), "components")
    merged = edges.select(F.col("a").alias("node")).distinct().withColumn("merged", F.lit(True))
    told = roots.join(merged, "node", "left").withColumn("merged", F.coalesce("merged", F.lit(False)))
    chosen = told.groupBy("root").agg(F.min(F.struct("merged", "node"))["node"].alias("canonical"))
    return roots.join(chosen, "root").select("node", "canonical").where("node <> canonical")


def rewrite(triples: DataFrame, names: DataFrame) -> DataFrame:
    """Triples with both ends renamed by (node, canonical); with a column iri only objects that are nodes are."""
    if "iri" in triples.columns:
        node = F.col("iri")
    else:
        node = F.lit(True)
    subject = names.select(F.col("node").alias("s"), F.col("canonical").alias("new_s"))
    target = names.select(F.col("node").alias("o_"), F.col("canonical").alias("new_o"))
    told = triples.join(subject, "s", "left").join(target, node & (F.col("o") == F.col("o_")), "left")
    ends = {"s": F.coalesce("new_s", "s"), "o": F.coalesce("new_o", "o")}
    return told.select(*(ends.get(c, F.col(c)).alias(c) for c in triples.columns))


def deduplicated(fused: DataFrame, symmetric: tuple[str, ...] = ("joinableWith",)) -> DataFrame:
    """Each triple once, symmetric ones with their ends in order, with the highest confidence and number of sources."""
    swap = F.col("p").isin(*symmetric)
    ends = fused.withColumns({"s": F.when(swap, F.least("s", "o")).otherwise(F.col("s")), "o": F.when(swap, F.greatest("s", "o")).otherwise(F.col("o"))})
    return ends.groupBy("s", "p", "o").agg(F.max("confidence").alias("confidence"), F.max("sources").alias("sources"))


@dataclass
class Cleaned:
    """What cleaning makes of raw triples: production and quarantine as stored tables, and counts by stage."""

    production: DataFrame
    quarantine: DataFrame
    counts: dict[str, int] = field(default_factory=dict)

    def rows(self) -> DataFrame:
        """Both, with the stage `production` or the reason why a row was held back."""
        kept = self.production.select(F.lit("production").alias("stage"), "s", "p", "o", "confidence", F.expr(NO_SUGGESTION).alias("suggestions"))
        return kept.unionByName(self.quarantine.select(F.col("reason").alias("stage"), "s", "p", "o", "confidence", "suggestions"))


HELD = ("s", "p", "o", "confidence", "reason", "suggestions")


def run(raw: DataFrame, tables: DataFrame, decisions: DataFrame, predicates: DataFrame, prefix: str, table_predicates: tuple[str, ...], functional: list[str] | None = None, approve_from: float = APPROVE_FROM) -> Cleaned:
    """All stages: normalise, link tables, merge entities, check predicates, fuse, judge conflicts, deduplicate, give a status.

    decisions is what `decide` gives for the new entities. Triples of an entity that awaits arbitration go on under its
    name; the question is held back. Counts are those of rows that enter and leave each stage.
    """
    counts: dict[str, int] = {}

    def staged(df: DataFrame, name: str) -> DataFrame:
        seen = Observation(name)
        stored = materialise(df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count("reason").alias("held")), name)
        told = seen.get
        counts[name] = told["rows"] - told["held"]
        counts[f"quarantine_{name}"] = told["held"]
        return stored

    kept = lambda df: df.where(F.col("reason").isNull()).drop("reason", "suggestions")
    held = lambda df: df.where(F.col("reason").isNotNull()).select(*HELD)
    columns = ["s", "p", "o", "source", "confidence"]
    untagged = lambda df: df.select("*", F.lit(None).cast("string").alias("reason"), F.expr(NO_SUGGESTION).alias("suggestions"))

    entered = Observation("input")
    clean = staged(untagged(normalise(raw.select(*columns).observe(entered, F.count(F.lit(1)).alias("rows")))), "syntax")
    counts = {"input": entered.get["rows"], **counts}
    linked = staged(link(kept(clean), tables, table_predicates), "link")
    known = materialise(decisions, "decisions")
    names = canonical(known.where("decision = 'merge'").select("node", "into"))
    asked = known.where("decision = 'arbitrate'").join(kept(linked).select(F.col("s").alias("node")).distinct(), "node", "left_semi")
    none = F.lit(None).cast("string")
    asked = asked.select(F.col("node").alias("s"), none.alias("p"), none.alias("o"), F.lit(None).cast("double").alias("confidence"), F.lit("entity_arbitrate").alias("reason"), F.col("candidates").alias("suggestions"))
    asked = staged(asked, "disambiguate")
    mapped = staged(map_predicates(rewrite(kept(linked), names), predicates, prefix), "predicates")
    judged = conflicts(fuse(kept(mapped)), functional)
    lost = F.when(F.col("o") != F.col("winner"), "conflict")
    told = staged(judged.select("*", lost.alias("reason"), F.when(lost.isNotNull(), F.array("winner")).otherwise(F.expr(NO_SUGGESTION)).alias("suggestions")), "conflict")
    once = materialise(deduplicated(kept(told)), "once")
    status = status_gate(once, approve_from).select("s", F.lit("approvalStatus").alias("p"), F.col("status").alias("o"), F.lit(100.0).alias("confidence"), F.lit(1).cast("bigint").alias("sources"))
    production = staged(untagged(once.unionByName(status)), "production")
    del counts["quarantine_production"], counts["disambiguate"], counts["quarantine_syntax"]
    return Cleaned(kept(production), held(linked).unionByName(held(asked)).unionByName(held(mapped)).unionByName(held(told)), counts)


# publishing


def _manifests(store: str) -> str:
    return f"{store}/manifests"


def manifest(spark: SparkSession, store: str) -> tuple[int, list[str]]:
    """(version, snapshots) of what is published; (0, []) where nothing is."""
    try:
        known = spark.read.schema("version bigint, snapshots array<string>").parquet(_manifests(store))
        last = known.orderBy(F.desc("version")).first()
    except AnalysisException:
        return 0, []
    return (last.version, list(last.snapshots)) if last else (0, [])


def published(spark: SparkSession, store: str, like: DataFrame) -> DataFrame:
    """The stored graph: each triple of the snapshots that the last manifest names, once."""
    _, snapshots = manifest(spark, store)
    graph = spark.read.schema(like.schema).parquet(*snapshots) if snapshots else like.limit(0)
    return graph.dropDuplicates(["s", "p", "o"])


def publish(batch: DataFrame, validate: Callable[[DataFrame], DataFrame], store: str) -> tuple[bool, DataFrame]:
    """(published, violations): write a snapshot, validate it as it is stored, and name it in a new manifest if nothing violates a shape.

    Readers see a batch whole or not at all: the manifest of a version is one job's output in a folder of its own, which appears when the job
    commits, and a second writer of the same version fails. A blocked or broken snapshot is left unnamed.
    """
    spark = batch.sparkSession
    version, snapshots = manifest(spark, store)
    path = f"{store}/snapshots/{version + 1}-{spark.range(1).select(F.expr('uuid()')).first()[0]}"
    batch.write.parquet(path)
    stored = spark.read.schema(batch.schema).parquet(path)
    found = materialise(validate(stored), "violations")
    if not found.where("severity = 'Violation'").isEmpty():
        return False, found
    row = spark.createDataFrame([(version + 1, [*snapshots, path])], "version bigint, snapshots array<string>")
    row.coalesce(1).write.mode("errorifexists").parquet(f"{_manifests(store)}/v={version + 1}")
    return True, found


# versions


def with_version(changed: DataFrame, versions: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """Triples (s, p, o) that give each changed subject (s) its next version, and a note where notes (s, note) has one; versions (s, version) may lack it."""
    subjects = changed.select("s").distinct()
    last = versions.groupBy("s").agg(F.max(F.col("version").cast("bigint")).alias("last"))
    made = subjects.join(last, "s", "left").select("s", F.lit("version").alias("p"), (F.coalesce("last", F.lit(1)) + 1).cast("string").alias("o"))
    if notes is None:
        return made
    said = notes.where(F.trim("note") != "").join(subjects, "s", "left_semi")
    return made.unionByName(said.select("s", F.lit("changeNote").alias("p"), F.col("note").alias("o")))


def deprecated(entities: DataFrame) -> DataFrame:
    """Triples that deprecate entities (s, reason); a reason that is null or blank gives no note."""
    made = entities.select("s", F.lit("certificationStatus").alias("p"), F.lit("deprecated").alias("o"))
    return made.unionByName(entities.where(F.trim("reason") != "").select("s", F.lit("changeNote").alias("p"), F.concat(F.lit("Deprecated: "), "reason").alias("o"))).distinct()
