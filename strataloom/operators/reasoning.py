"""Rules over triples and closures over edges.

Loops run on the driver, each round is a join whose result is written to the shared folder; only counts and
emptiness come back. Derived triples exclude what is known and pairs of a node with itself.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.functions.storage import materialise

TRANSITIVE = ("derivedFrom", "transformsFrom", "precedes")
SYMMETRIC = ("joinableWith", "exactMatch")
INVERSE = {"broader": "narrower", "narrower": "broader", "groundedBy": "asserts", "computedFrom": "usedBy"}


def transitive(edges: DataFrame) -> DataFrame:
    """All pairs (a, b), a not b, with a path from a to b.

    Rounds double the length of the paths that are known: pairs of exactly 2^n steps go before all known ones. A
    round without a new pair ends it, so there are as many as the logarithm of the longest shortest path.
    """
    exact = known = materialise(edges.select("a", "b").where("a <> b").distinct(), "edges")
    while True:
        ahead = exact.select("a", F.col("b").alias("via"))
        step = ahead.join(known.select(F.col("a").alias("via"), "b"), "via").select("a", "b").where("a <> b").distinct()
        new = materialise(step.join(known, ["a", "b"], "left_anti"), "new")
        if new.isEmpty():
            return known
        exact = materialise(ahead.join(exact.select(F.col("a").alias("via"), "b"), "via").select("a", "b").where("a <> b").distinct(), "exact")
        known = known.unionByName(new)


def reach(edges: DataFrame, hops: int) -> DataFrame:
    """Pairs reachable in 1 to `hops` steps in either direction, a not b; only new pairs are extended in each step."""
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    known = new = both
    for _ in range(hops - 1):
        step = new.select("a", F.col("b").alias("via")).join(both.select(F.col("a").alias("via"), "b"), "via").select("a", "b").where("a <> b").distinct()
        new = materialise(step.join(known, ["a", "b"], "left_anti"), "new")
        if new.isEmpty():
            break
        known = known.unionByName(new)
    return known


def _pairs(kg: DataFrame, p: str) -> DataFrame:
    return kg.where(F.col("p") == p).select(F.col("s").alias("a"), F.col("o").alias("b"))


def _triples(pairs: DataFrame, p: str) -> DataFrame:
    return pairs.select(F.col("a").alias("s"), F.lit(p).alias("p"), F.col("b").alias("o"))


def minus(new: DataFrame, kg: DataFrame) -> DataFrame:
    return new.distinct().join(kg.select("s", "p", "o"), ["s", "p", "o"], "left_anti")


def rule_transitive(kg: DataFrame, predicates=TRANSITIVE) -> DataFrame:
    return minus(reduce(DataFrame.unionByName, [_triples(transitive(_pairs(kg, p)), p) for p in predicates]), kg)


def rule_symmetric(kg: DataFrame, predicates=SYMMETRIC) -> DataFrame:
    return minus(kg.where(F.col("p").isin(*predicates) & (F.col("s") != F.col("o"))).select(F.col("o").alias("s"), "p", F.col("s").alias("o")), kg)


def rule_inverse(kg: DataFrame, inverse=None) -> DataFrame:
    inverse = inverse or INVERSE
    other = F.create_map(*(F.lit(x) for pair in inverse.items() for x in pair))
    return minus(kg.where(F.col("p").isin(*inverse)).select(F.col("o").alias("s"), other[F.col("p")].alias("p"), F.col("s").alias("o")), kg)


def rule_subclass(kg: DataFrame, schema: DataFrame) -> DataFrame:
    """Types follow the closure of subclasses; schema (a below b) is a small table."""
    up = transitive(schema)
    types = kg.where("p = 'type'").join(up, F.col("o") == F.col("a")).select("s", F.lit("type").alias("p"), F.col("b").alias("o"))
    return minus(types, kg)


def rule_subproperty(kg: DataFrame, schema: DataFrame) -> DataFrame:
    up = transitive(schema)
    return minus(kg.join(up, F.col("p") == F.col("a")).select("s", F.col("b").alias("p"), "o"), kg)


def rule_equivalent(kg: DataFrame, equal: DataFrame) -> DataFrame:
    both = equal.select("a", "b").unionByName(equal.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    types = kg.where("p = 'type'").join(both, F.col("o") == F.col("a")).select("s", F.lit("type").alias("p"), F.col("b").alias("o"))
    return minus(types.unionByName(_triples(both, "subClassOf")), kg)


def rule_bgp(kg: DataFrame, body: list[tuple[str, str, str]], head: tuple[str, str, str]) -> DataFrame:
    """Patterns with shared variables (?x) imply the head; patterns are joined on what they share."""
    table = None
    for s, p, o in body:
        rows = kg
        names = []
        for column, term in (("s", s), ("p", p), ("o", o)):
            if term.startswith("?"):
                names.append(F.col(column).alias(term[1:]))
            else:
                rows = rows.where(F.col(column) == term)
        if s == o and s.startswith("?"):
            rows, names = rows.where("s = o"), names[:-1]
        part = rows.select(*names).distinct()
        if table is None:
            table = part
            continue
        shared = [c for c in part.columns if c in table.columns]
        if not shared:
            raise ValueError("a pattern shares no variable with those before it")
        table = table.join(part, shared)
    term = lambda x: F.col(x[1:]) if x.startswith("?") else F.lit(x)
    made = table.select(*(term(x).alias(c) for x, c in zip(head, "spo", strict=True))).where("s <> o")
    return minus(made, kg)


#: Business rules: name, body, head.
RULES = {
    "metric_depends": ([("?m", "derivedFrom", "?n"), ("?n", "computedFrom", "?t")], ("?m", "dependsOn", "?t")),
    "metric_inherits": ([("?m", "derivedFrom", "?n"), ("?n", "formula", "?f")], ("?m", "inheritsFormula", "?f")),
    "metric_dim_column": ([("?m", "computedFrom", "?t"), ("?t", "joinableWith", "?u")], ("?m", "canGroupBy", "?u")),
    "grounding_inherit": ([("?x", "broader", "?y"), ("?x", "groundedBy", "?c")], ("?y", "groundedBy", "?c")),
}


#: Rounds after which what is known is written as one table.
COMPACT = 16


def fixpoint(kg: DataFrame, rules: list, rounds: int | None = None) -> DataFrame:
    """All triples that functions of a graph derive, (s, p, o, round): each round applies them all to the whole graph.

    For rules that are no functions see `semi_naive`. If `rounds` are not enough for that, it raises.
    """
    base = materialise(kg.select("s", "p", "o").distinct(), "base")
    work, found = base, None
    for n in count(1):
        new = materialise(reduce(DataFrame.unionByName, [r(work) for r in rules]).distinct().withColumn("round", F.lit(n)), "derived")
        if new.isEmpty():
            break
        if rounds is not None and n > rounds:
            raise RuntimeError(f"the rules still derive after {rounds} rounds")
        found = new if found is None else found.unionByName(new)
        work = work.unionByName(new.select("s", "p", "o"))
    return found if found is not None else base.limit(0).withColumn("round", F.lit(0))


@dataclass(frozen=True)
class Rule:
    """Patterns of variables (?x) and constants that imply a head, under a name."""

    name: str
    body: tuple[tuple[str, str, str], ...]
    head: tuple[str, str, str]


def rules_of(symmetric=(), inverse=None, transitive_over=(), subclass=(), subproperty=(), business=()) -> list[Rule]:
    """Rules in one form: symmetric and transitive predicates, inverse ones by name, pairs (below, above), names of RULES."""
    flip = lambda p, q, name: Rule(name, (("?x", p, "?y"),), ("?y", q, "?x"))
    out = [flip(p, p, "symmetric") for p in symmetric] + [flip(p, q, "inverse") for p, q in (inverse or {}).items()]
    out += [Rule("transitive", (("?x", p, "?y"), ("?y", p, "?z")), ("?x", p, "?z")) for p in transitive_over]
    out += [Rule("subclass", (("?x", "type", a),), ("?x", "type", b)) for a, b in subclass]
    out += [Rule("subproperty", (("?x", a, "?y"),), ("?x", b, "?y")) for a, b in subproperty]
    return out + [Rule(n, tuple(RULES[n][0]), RULES[n][1]) for n in business]


def _matches(rows: DataFrame, pattern: tuple[str, str, str]) -> DataFrame:
    """The variables of a pattern in the rows that fit it."""
    names: dict[str, str] = {}
    for column, term in zip("spo", pattern, strict=True):
        if not term.startswith("?"):
            rows = rows.where(F.col(column) == term)
        elif term[1:] in names:
            rows = rows.where(F.col(column) == F.col(names[term[1:]]))
        else:
            names[term[1:]] = column
    return rows.select(*(F.col(c).alias(v) for v, c in names.items()))


def _derived(rule: Rule, old: DataFrame | None, delta: DataFrame) -> list[DataFrame]:
    """What a rule makes of triples of which one at least is in delta: for each atom, delta there, all triples before it and old ones after it."""
    out = []
    for i in range(len(rule.body)):
        if old is None and i < len(rule.body) - 1:
            continue  # without old triples only the last one has something after it: nothing
        order = sorted(range(len(rule.body)), key=lambda k: k != i)
        table, left = None, order
        while left:
            # the atom with delta first, then any that shares a variable
            k = next((k for k in left if table is None or {x[1:] for x in rule.body[k] if x.startswith("?")} & set(table.columns)), None)
            if k is None:
                raise ValueError("a pattern shares no variable with those before it")
            left = [x for x in left if x != k]
            side = delta if k == i else old.unionByName(delta) if k < i and old is not None else delta if old is None else old
            part = _matches(side, rule.body[k])
            table = part if table is None else table.join(part, [c for c in part.columns if c in table.columns])
        term = lambda x: F.col(x[1:]) if x.startswith("?") else F.lit(x)
        out.append(table.select(*(term(x).alias(c) for x, c in zip(rule.head, "spo", strict=True))).where("s <> o").withColumn("rule", F.lit(rule.name)))
    return out


def semi_naive(kg: DataFrame, rules: list[Rule], rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(s, p, o, round) that the rules derive, and (round, rule, n): how many new triples each derived, one of several rules counting for each.

    Rules see what earlier rounds derived. A round joins each atom of a body with the triples that the round
    before made, so no combination of triples is looked at twice, and a closure is carried on, not begun anew.
    If `rounds` are not enough for that nothing is new, it raises.
    """
    delta = materialise(kg.select("s", "p", "o").distinct(), "base")
    every, old, found, counts = delta, None, None, None
    for n in count(1):
        made = reduce(DataFrame.unionByName, [x for r in rules for x in _derived(r, old, delta)]).distinct()
        new = materialise(made.join(every, ["s", "p", "o"], "left_anti"), "derived")
        if new.isEmpty():
            break
        if rounds is not None and n > rounds:
            raise RuntimeError(f"the rules still derive after {rounds} rounds")
        told = new.groupBy("rule").agg(F.count("*").alias("n")).select(F.lit(n).alias("round"), "rule", "n")
        once = materialise(new.select("s", "p", "o").distinct(), "delta")
        part = once.withColumn("round", F.lit(n))
        found, counts = (part, told) if found is None else (found.unionByName(part), counts.unionByName(told))
        old, delta, every = every, once, every.unionByName(once)
        if n % COMPACT == 0:
            every = materialise(every, "every")
    if found is None:
        found = every.limit(0).withColumn("round", F.lit(0))
        counts = kg.sparkSession.createDataFrame([], "round int, rule string, n bigint")
    return found, counts


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of edges (a, b) is linked with, either way.

    Each round hangs the larger neighbours of a node below the smallest one, then all smaller ones; nodes of a long
    chain come together in a logarithm of rounds. What goes round is edges only, and a hub's are spread by their other end.
    """
    pairs = edges.where("a <> b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct()
    pairs, before = materialise(pairs, "pairs"), None
    while True:
        both = pairs.select(F.col("low").alias("u"), F.col("high").alias("v")).unionByName(pairs.select(F.col("high").alias("u"), F.col("low").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("low"), F.col("v").alias("high")).where("low <> high").distinct()
        large = materialise(large, "large")
        least = large.groupBy("high").agg(F.min("low").alias("m"))
        joined = large.join(least, "high").select("high", "low", "m")
        small = joined.select(F.col("m").alias("low"), F.col("low").alias("high")).unionByName(joined.select(F.col("m").alias("low"), "high"))
        pairs = materialise(small.where("low <> high").distinct(), "pairs")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = pairs.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct()
    return pairs.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(roots)


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """(node, first): nodes on a cycle and the smallest node of theirs; edges (child, parent), the smallest parent counts.

    Pointers are doubled until all paths are longer than the number of nodes: what a path then points to lies
    on a cycle, and paths that end at a root have dropped out. Depth costs only its logarithm.
    """
    up = materialise(edges.where("child <> parent").groupBy("child").agg(F.min("parent").alias("parent")), "parents")
    jump = up.select(F.col("child").alias("node"), F.col("parent").alias("to"), F.least("child", "parent").alias("low"))
    steps, nodes = 1, up.count()
    while steps <= nodes:
        far = jump.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("low").alias("far_low"))
        jump = materialise(jump.join(far, "to").select("node", F.col("next").alias("to"), F.least("low", "far_low").alias("low")), "jump")
        steps *= 2
        if jump.isEmpty():
            break
    on = jump.select(F.col("to").alias("node")).distinct()
    return jump.join(on, "node").select("node", F.col("low").alias("first"))


def without_cycles(edges: DataFrame) -> DataFrame:
    """Edges without self loops, and without the edge out of the smallest node of each cycle."""
    cut = cycle_nodes(edges).select(F.col("first").alias("child")).distinct()
    plain = edges.where("child <> parent").groupBy("child").agg(F.min("parent").alias("parent"))
    return plain.join(cut, "child", "left_anti")


def _anchors(single: DataFrame) -> DataFrame:
    """(node, anchor, hops): where the only-parent links (node, to) of each node end; nodes that run into a cycle are left out.

    Pointers are doubled: a chain costs the logarithm of its length.
    """
    jump = materialise(single.select("node", "to", F.lit(1).cast("bigint").alias("hops")), "jump")
    steps, nodes = 1, jump.count()
    done = None
    while steps <= 2 * nodes:
        ahead = jump.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("hops").alias("more"))
        told = materialise(jump.join(ahead, "to", "left"), "jump")
        ended = told.where("next is null").select("node", F.col("to").alias("anchor"), "hops")
        done = ended if done is None else done.unionByName(ended)
        # those whose pointer leads to a node that has ended go on from it
        jump = told.where("next is not null").select("node", F.col("next").alias("to"), (F.col("hops") + F.col("more")).alias("hops"))
        known = done.select(F.col("node").alias("to"), "anchor", F.col("hops").alias("more"))
        jump = materialise(jump.join(known, "to", "left").select("node", F.coalesce("anchor", "to").alias("to"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops")), "jump")
        steps *= 2
        if jump.isEmpty():
            break
    return done if done is not None else jump.select("node", F.col("to").alias("anchor"), "hops")


def depths(edges: DataFrame, warn: int = 6) -> DataFrame:
    """(node, depth, deep): the fewest steps from a root; 0 for nodes that no root reaches.

    A node with one parent is as deep as that and one more, so chains of such nodes are contracted first, by doubling pointers.
    What is left are nodes with several parents: for these the shortest way is relaxed, in as many rounds as lie on one
    way at most; a tree needs none.
    """
    e = materialise(edges.where("child <> parent").select("child", "parent").distinct(), "edges")
    nodes = e.select(F.col("child").alias("node")).unionByName(e.select(F.col("parent").alias("node"))).distinct()
    up = e.groupBy("child").agg(F.count("*").alias("n"), F.min("parent").alias("to"))
    anchors = materialise(_anchors(up.where("n = 1").select(F.col("child").alias("node"), "to")), "anchors")
    roots = nodes.join(up.select(F.col("child").alias("node")), "node", "left_anti")
    # a way from an anchor to a node with several parents: over one parent, and the chain above that
    many = e.join(up.where("n > 1").select("child"), "child")
    ways = many.join(anchors.select(F.col("node").alias("parent"), "anchor", "hops"), "parent", "left")
    ways = ways.select(F.coalesce("anchor", "parent").alias("start"), "child", (F.coalesce("hops", F.lit(0)) + 1).alias("hops"))
    ways = materialise(ways.groupBy("start", "child").agg(F.min("hops").alias("hops")), "ways")
    known = fresh = materialise(roots.withColumn("depth", F.lit(0).cast("bigint")), "known")
    while not ways.isEmpty() and not fresh.isEmpty():
        step = fresh.join(ways, F.col("node") == F.col("start")).groupBy(F.col("child").alias("node")).agg(F.min(F.col("depth") + F.col("hops")).alias("depth"))
        better = step.join(known.select("node", F.col("depth").alias("before")), "node", "left").where("before is null or depth < before").select("node", "depth")
        fresh = materialise(better, "fresh")
        known = materialise(known.unionByName(fresh).groupBy("node").agg(F.min("depth").alias("depth")), "known")
    below = anchors.join(known.select(F.col("node").alias("anchor"), "depth"), "anchor").select("node", (F.col("depth") + F.col("hops")).alias("depth"))
    out = nodes.join(known.unionByName(below), "node", "left").select("node", F.coalesce("depth", F.lit(0)).cast("int").alias("depth"))
    return out.withColumn("deep", F.col("depth") > warn)
