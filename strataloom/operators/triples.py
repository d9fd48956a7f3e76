"""Building, cleaning, versioning and removing triples.

Raw triples have s, p, o, source, confidence. Every stage returns what it keeps and what it quarantines, so
that stages compose without counting in between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions.numbers import rounded
from strataloom.operators.retrieval import best, resolve_refs, vec_topk

APPROVE_FROM = 85.0
DEFAULT_CONFIDENCE = 70.0
#: Allowed changes of status.
TRANSITIONS = (("draft", "linked"), ("linked", "shacl_passed"), ("shacl_passed", "pending_review"), ("pending_review", "approved"), ("pending_review", "rejected"), ("draft", "rejected"), ("approved", "pending_review"))


def slug(name: Column) -> Column:
    """Lower case, spaces to underscores, only word characters, CJK and ._- stay."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"\s+", "_"), r"[^\w一-鿿.\-]", "")


def iri(kind: str, *parts: Column) -> Column:
    return F.concat_ws("/", F.lit(kind), *(F.replace(F.url_encode(p.cast("string")), F.lit("+"), F.lit("%20")) for p in parts))


def one(x: Column) -> Column:
    """One digit, half up, with room for the last bits of a product."""
    return F.floor(x * 10 + 0.5 + 1e-7) / 10


def flatten(records: DataFrame, subject: Column, fields: dict[str, tuple[Column, bool]]) -> DataFrame:
    """One triple for each non-null field; fields: predicate to (value, is a node)."""
    made = F.array(*(F.struct(subject.alias("s"), F.lit(p).alias("p"), v.cast("string").alias("o"), F.lit(node).alias("iri")) for p, (v, node) in fields.items()))
    return records.select(F.explode(F.filter(made, lambda x: x["o"].isNotNull() & (x["o"] != ""))).alias("x")).select("x.*")


def from_replies(replies: DataFrame, kind: str, shape: str, threshold: float = APPROVE_FROM) -> DataFrame:
    """Triples from JSON replies {items: [{name, definition, confidence, synonyms}]}: the first of each name wins."""
    items = replies.select("reply_id", F.posexplode(F.from_json("reply", f"items array<struct<{shape}>>")["items"]).alias("n", "x"))
    named = items.where(F.trim("x.name") != "").withColumn("key", slug(F.col("x.name")))
    first = best(named, ["key"], [F.asc("reply_id"), F.asc("n")], 1)
    status = F.when(F.coalesce("x.confidence", F.lit(DEFAULT_CONFIDENCE)) >= threshold, "approved").otherwise("draft")
    subject = F.concat(F.lit(f"{kind.lower()}/"), F.col("key"))
    base = flatten(first, subject, {"type": (F.lit(kind), True), "label": (F.col("x.name"), False), "definition": (F.col("x.definition"), False), "confidence": (F.col("x.confidence"), False), "status": (status, False)})
    extra = first.select(subject.alias("s"), F.lit("altLabel").alias("p"), F.explode(F.array_distinct("x.synonyms")).alias("o"), F.lit(False).alias("iri")).where("o <> ''")
    return base.unionByName(extra)


def normalise(raw: DataFrame) -> DataFrame:
    """Trimmed terms, rows with an empty one dropped, confidence 0..100 to one digit, 70 if missing."""
    trimmed = raw.withColumns({c: F.trim(c) for c in ("s", "p", "o")}).where("s <> '' and p <> '' and o <> ''")
    return trimmed.withColumn("confidence", one(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce("confidence", F.lit(DEFAULT_CONFIDENCE))))))


def link_tables(triples: DataFrame, tables: DataFrame, predicates: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Objects of some predicates become table ids; ambiguous and unknown ones go to quarantine."""
    named = F.col("p").isin(*predicates)
    told = resolve_refs(triples.where(named).select(F.col("o").alias("ref")), tables)
    joined = triples.where(named).join(told, F.col("o") == F.col("ref"))
    linked = joined.where("status = 'exact'").withColumn("o", F.concat(F.lit("table/"), F.col("table_id").cast("string"))).select(triples.columns)
    bad = joined.where("status <> 'exact'").select(*triples.columns, F.col("status").alias("reason"))
    return triples.where(~named).unionByName(linked), bad


def disambiguate(new: DataFrame, known: DataFrame, same: float = 0.85, maybe: float = 0.60) -> DataFrame:
    """(query, best, sim, decision): merge, quarantine or new by the nearest known entity; new (query, qv), known (id, vector)."""
    top = vec_topk(new, known, 1)
    decision = F.when(F.col("sim") >= same, "merge").when(F.col("sim") >= maybe, "quarantine").otherwise("new")
    return top.select("query", F.col("id").alias("best"), "sim", decision.alias("decision"))


def fuse(triples: DataFrame) -> DataFrame:
    """Equal triples become one with confidence 100 * (1 - product of (1 - c / 100)), and the number of sources."""
    doubt = F.product(1 - F.col("confidence") / 100)
    return triples.groupBy("s", "p", "o").agg(one(100 * (1 - doubt)).alias("confidence"), F.count_distinct("source").alias("sources"))


def conflicts(fused: DataFrame, functional: list[str] | None = None) -> DataFrame:
    """Adds winner: of several objects of (s, p) the one with most sources, then most confidence, then the smallest; functional limits the predicates."""
    w = Window.partitionBy("s", "p").orderBy(F.desc("sources"), F.desc("confidence"), F.asc("o"))
    first = F.first("o").over(w)
    only = F.lit(True) if functional is None else F.col("p").isin(*functional)
    return fused.withColumn("winner", F.when(only, first).otherwise(F.col("o")))


def deduplicate(triples: DataFrame, symmetric: tuple[str, ...] = ("joinableWith",)) -> DataFrame:
    """Each triple once; symmetric ones once with their ends in order."""
    swap = F.col("p").isin(*symmetric)
    return triples.withColumns({"s": F.when(swap, F.least("s", "o")).otherwise(F.col("s")), "o": F.when(swap, F.greatest("s", "o")).otherwise(F.col("o"))}).dropDuplicates(["s", "p", "o"])


def status_gate(triples: DataFrame, threshold: float = APPROVE_FROM) -> DataFrame:
    """A status for each subject by its highest confidence."""
    sure = F.max(F.coalesce("confidence", F.lit(DEFAULT_CONFIDENCE))) >= threshold
    return triples.groupBy("s").agg(F.when(sure, "approved").otherwise("draft").alias("status"))


def clean(raw: DataFrame, functional: list[str] | None = None) -> DataFrame:
    """Normalised, fused and judged triples, with stage `production` or `conflict`; all stages are in `cleaning.run`."""
    judged = conflicts(fuse(normalise(raw)), functional)
    return judged.withColumn("stage", F.when(F.col("o") == F.col("winner"), "production").otherwise("conflict"))


def quarantine_decide(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Items with their decision: approve re-enters cleaning, reject drops, pick takes the first suggestion, map takes a given table."""
    told = items.join(decisions, "item_id", "left")
    action = F.coalesce("decision", F.lit("wait"))
    fixed = F.when(action == "map", F.concat(F.lit("table/"), F.col("target"))).when(action == "pick", F.get("suggestions", F.lit(0))).when(action == "approve", F.col("o"))
    return told.select("item_id", "s", "p", fixed.alias("o"), action.alias("decision"), F.when(fixed.isNotNull(), "recheck").when(action == "reject", "dropped").otherwise("open").alias("state"))


def promote(changes: DataFrame, spark) -> DataFrame:
    """Each change of status (s, before, after) with whether it is allowed and the resulting status."""
    allowed = spark.createDataFrame(list(TRANSITIONS), "before string, after string").withColumn("ok", F.lit(True))
    told = changes.join(F.broadcast(allowed), ["before", "after"], "left")
    ok = F.coalesce("ok", F.lit(False))
    return told.select("s", "before", "after", ok.alias("ok"), F.when(ok, F.col("after")).otherwise(F.col("before")).alias("status"), F.when(~ok, "transition not allowed").alias("reason"))


def version_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(s, p, added, removed) for subjects that exist in both and predicates whose values differ."""
    side = lambda df, name: df.groupBy("s", "p").agg(F.collect_set("o").alias(name))
    both = side(old, "a").join(side(new, "b"), ["s", "p"], "full_outer")
    none = F.array().cast("array<string>")
    a, b = F.coalesce("a", none), F.coalesce("b", none)
    diff = both.select("s", "p", F.sort_array(F.array_except(b, a)).alias("added"), F.sort_array(F.array_except(a, b)).alias("removed")).where("size(added) + size(removed) > 0")
    return diff.join(old.select("s").distinct(), "s", "left_semi").join(new.select("s").distinct(), "s", "left_semi")


def cascade(kg: DataFrame, chunks: DataFrame) -> DataFrame:
    """Triples without subjects grounded on removed chunks, links to them, and links to the chunks."""
    gone = kg.where("p = 'groundedBy'").join(chunks, F.col("o") == F.col("chunk"), "left_semi").select(F.col("s").alias("x")).distinct()
    names = gone.unionByName(chunks.select(F.col("chunk").alias("x")))
    return kg.join(names, F.col("s") == F.col("x"), "left_anti").join(names, F.col("o") == F.col("x"), "left_anti")


def orphans(children: DataFrame, parents: DataFrame, on: list[str]) -> DataFrame:
    return children.join(parents, on, "left_anti")


def sync(old: DataFrame, new: DataFrame, key: str, body: str) -> DataFrame:
    """(key, action): created, updated, unchanged or deleted by the hash of the body."""
    a = old.select(key, F.sha2(body, 256).alias("ha"))
    b = new.select(key, F.sha2(body, 256).alias("hb"))
    action = F.when(F.col("ha").isNull(), "created").when(F.col("hb").isNull(), "deleted").when(F.col("ha") == F.col("hb"), "unchanged").otherwise("updated")
    return a.join(b, key, "full_outer").select(key, action.alias("action"))


def to_lines(kg: DataFrame) -> DataFrame:
    """N-Triples-like lines; quotes, backslashes and line ends in literals are escaped."""
    text = F.replace(F.replace(F.replace(F.replace("o", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    literal = F.concat(F.lit('"'), text, F.lit('"'))
    return kg.select(F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), F.when(F.col("iri"), F.concat(F.lit("<"), "o", F.lit(">"))).otherwise(literal), F.lit(" .")).alias("value"))


def from_lines(lines: DataFrame) -> DataFrame:
    pattern = r'^<([^>]*)> <([^>]*)> (?:<([^>]*)>|"((?:[^"\\]|\\.)*)") \.$'
    part = lambda i: F.regexp_extract("value", pattern, i)
    node = F.col("value").rlike(r'^<[^>]*> <[^>]*> <')
    marked = F.replace(part(4), F.lit("\\\\"), F.lit("\x00"))
    text = F.replace(F.replace(F.replace(F.replace(marked, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")), F.lit("\x00"), F.lit("\\"))
    return lines.where(F.col("value").rlike(pattern)).select(part(1).alias("s"), part(2).alias("p"), F.when(node, part(3)).otherwise(text).alias("o"), node.alias("iri"))
