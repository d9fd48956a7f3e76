"""Personal data by weak-supervision aggregation (operator 3); DataFrame functions only.

Base spans (email, ip, card, phone) come from fixed patterns with their checks and always stay. Broader
patterns propose further candidates that touch no base span: spelled-out addresses, phone numbers without a
country code, card-like and address-like numbers that fail a check. Four labelers vote on each candidate,
for, against or not at all: its format (pattern and checksum), a gazetteer (top-level domains, dialling
codes, issuer prefixes, reserved ranges), the words before it, and its neighbouring characters.
Expectation-maximisation over the counts of vote patterns estimates each labeler's reliability without
labels; its posteriors train the final classifier, a logistic regression over votes, kind and length, which
becomes a Spark expression and decides on the candidates. Only counts of vote patterns reach the driver;
there are at most kinds x 3^4 x lengths of them.

Defined results: null and empty texts have no spans. Offsets are code points, ends exclusive. Repeated rows
give repeated results. Without candidates nothing is added. Other columns pass unchanged.

Patterns are written with possessive quantifiers, and start only at the beginning of a run or at the end of
the match before, which finds the same matches in linear time. Places, neighbours and overlaps come from scans
whose cost grows with the matches of a text to the power of one and a half at most.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import let, materialise, scan

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
#: Base patterns.
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Broader patterns for further candidates.
MORE = {
    "email": r"(?<![A-Za-z0-9._-])[A-Za-z0-9][A-Za-z0-9._-]{0,40}\x20?(?:\(at\)|\[at\]|\{at\})\x20?[A-Za-z0-9-]{1,40}(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|\.)\x20?[A-Za-z0-9-]{2,20}){1,4}",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{2,4}\)|[0-9]{3,4})[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
}
#: Cheap conditions without which a text can have no match.
NEEDS = {"email": lambda t: F.contains(t, F.lit("@")) | t.rlike(r"[(\[{]at[)\]}]"), "ip": lambda t: t.rlike("[0-9]\\.[0-9]"), "card": lambda t: t.rlike("[0-9][\\x20-]?[0-9]"), "phone": lambda t: F.contains(t, F.lit("+")) | t.rlike("[0-9][\\x20.-][0-9]{3}|[0-9]\\)[\\x20.-]")}
_BYTE = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP_CHECK = rf"^(?:{_BYTE}|0++)(?:\.(?:{_BYTE}|0++)){{3}}$"
#: Gazetteers, fixed values.
DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|uk|it|nl|eu|us"
ISSUERS = "^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
RESERVED = r"^(?:0|127|255|22[4-9]|2[34][0-9])\."
DIALLING = r"^(?:\+?(?:1|33|34|44|49|39|31)\b|\(|0)"
CUES = {
    "email": ("mail|contact|write|reach|address|kontakt|correo|courriel", "example|sample"),
    "ip": ("\\bip\\b|host|server|client|login|from", "version|release|section|chapter"),
    "card": ("card|visa|master|credit|payment|karte|tarjeta|carte", "isbn|order|invoice|serial|article"),
    "phone": ("phone|call|tel|mobile|fax|contact|numero|anruf", "isbn|order|invoice|serial|version"),
}
LABELERS = ("format", "gazetteer", "context", "neighbours")
CONTEXT = 40
#: Characters in a block of a text that is being replaced.
BLOCK = 65_536


_FOUND = "struct<start:int,end:int,value:string,before:string,edges:string>"
_CANDIDATE = "struct<kind:int,start:int,end:int,base:boolean,v0:int,v1:int,v2:int,v3:int,long:boolean>"


def _matches(text: Column, pattern: str, wanted: Callable[[Column], Column]) -> Column:
    """The leftmost non-overlapping matches whose value is wanted: place, value, what stands before, and both neighbours.

    What surrounds a match is taken from the gaps between matches, so that its cost does not grow with its place.
    """

    def rows(values: Column, gaps: Column) -> Column:
        later = lambda x: F.slice(x, 2, F.size(x))
        return F.arrays_zip(values.alias("value"), gaps.alias("gap"), later(gaps).alias("gap_after"), later(values).alias("value_after"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        after = F.substring(F.coalesce(F.nullif(x["gap_after"], F.lit("")), x["value_after"], F.lit("")), 1, 1)

        def told(before: Column) -> Column:
            end = start + F.length(x["value"])
            hit = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"), before.alias("before"), F.concat(F.right(before, F.lit(1)), F.lit("\n"), after).alias("edges"))
            return F.struct(F.struct(end.alias("at"), F.right(F.concat(before, x["value"]), F.lit(CONTEXT)).alias("tail")).alias("state"), F.when(wanted(x["value"]), F.array(hit)).otherwise(F.array().cast(f"array<{_FOUND}>")).alias("made"))

        return let(F.right(F.concat(state["tail"], x["gap"]), F.lit(CONTEXT)), told)

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"))
    # the last gap has no match after it
    run = lambda v: scan(let(F.split(text, pattern, -1), lambda g: F.slice(rows(v, g), 1, F.size(v))), begin, _FOUND, step)
    return let(found, lambda v: F.when(F.size(v) > 0, run(v)).otherwise(F.array().cast(f"array<{_FOUND}>")))


def _passes(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(IP_CHECK)
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _near_miss(kind: str, value: Column) -> Column:
    """Base matches that fail their check but are still candidates."""
    if kind == "card":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(13, 19)
    return F.lit(kind == "ip")


def _vote(good: Column, bad: Column) -> Column:
    return F.when(F.coalesce(good, F.lit(False)), 1).when(F.coalesce(bad, F.lit(False)), -1).otherwise(0)


def _votes(kind: str, x: Column) -> list[Column]:
    value = x["value"]
    gazetteer = {
        "email": _vote(value.rlike(rf"(?i)(?:{DOMAINS})$"), F.lit(False)),
        "ip": _vote(F.lit(False), value.rlike(RESERVED)),
        "card": _vote(value.rlike(ISSUERS), ~value.rlike(ISSUERS)),
        "phone": _vote(value.rlike(DIALLING), F.lit(False)),
    }[kind]
    before, edges = x["before"], x["edges"]
    good, bad = CUES[kind]
    return [
        _vote(_passes(kind, value), F.lit(kind != "email")),
        gazetteer,
        _vote(before.rlike(f"(?i){good}"), before.rlike(f"(?i){bad}")),
        _vote(~edges.rlike(r"[\p{L}0-9_]"), edges.rlike(r"[\p{L}0-9_]")),
    ]


def with_candidates(docs: DataFrame, text_col: str = "text", out_col: str = "candidates") -> DataFrame:
    """docs with out_col: array<struct<kind, start, end, base, v0..v3, long>> in order of kind and start; a column of that name is replaced."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast(f"array<{_CANDIDATE}>")

    def judged(k: int, found: Column, base: Column | None) -> Column:
        kind = KINDS[k]

        def one(x: Column) -> Column:
            isbase = _passes(kind, x["value"]) if base is None else base
            return F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), isbase.alias("base"), *(v.cast("int").alias(f"v{i}") for i, v in enumerate(_votes(kind, x))), (x["end"] - x["start"] > 14).alias("long"))

        return F.transform(found, one)

    parts, more = [], []
    for k, kind in enumerate(KINDS):
        usable = lambda value, kind=kind: _passes(kind, value) | _near_miss(kind, value)
        parts.append(F.when(NEEDS[kind](text), judged(k, _matches(text, BASE[kind], usable), None)).otherwise(none))
        if kind in MORE:
            more.append(F.when(NEEDS[kind](text), judged(k, _matches(text, MORE[kind], lambda value: F.lit(True)), F.lit(False))).otherwise(none))
    return docs.withColumn(out_col, let(F.concat(*parts, *more), _untouched))


def _untouched(cands: Column) -> Column:
    """Base spans, and once each the others that touch none of them, in order of kind and start.

    Two scans by place: one knows how far the base spans before reach, the other where the next one starts.
    """
    placed = F.sort_array(F.transform(cands, lambda x: F.struct(x["start"].alias("start"), (~x["base"]).alias("more"), x["kind"].alias("kind"), x["end"].alias("end"), x.alias("x"))))
    kind = f"struct<start:int,more:boolean,kind:int,end:int,x:{_CANDIDATE}>"
    none = F.array().cast(f"array<{kind}>")

    def forward(state: Column, p: Column) -> Column:
        again = (p["start"] == state["start"]) & (p["kind"] == state["kind"]) & (p["end"] == state["end"])
        reach = F.when(p["more"], state["reach"]).otherwise(F.greatest(state["reach"], p["end"]))
        after = F.struct(reach.alias("reach"), p["start"].alias("start"), p["kind"].alias("kind"), p["end"].alias("end"))
        return F.struct(after.alias("state"), F.when(p["more"] & ((p["start"] < state["reach"]) | again), none).otherwise(F.array(p)).alias("made"))

    def back(following: Column, p: Column) -> Column:
        after = F.when(p["more"], following).otherwise(p["start"])
        return F.struct(after.alias("state"), F.when(p["more"] & (p["end"] > following), none).otherwise(F.array(p)).alias("made"))

    begin = F.struct(*(F.lit(x).alias(n) for n, x in (("reach", 0), ("start", -1), ("kind", -1), ("end", -1))))
    kept = scan(F.reverse(scan(placed, begin, kind, forward)), F.lit(2**31 - 1), kind, back)
    return F.array_sort(F.when(F.exists(cands, lambda x: ~x["base"]), F.transform(kept, lambda p: p["x"])).otherwise(cands))


@dataclass
class SpanModel:
    """Weights of the final classifier over votes, kind and length; none if there was nothing to learn from."""

    bias: float
    votes: dict[tuple[int, int], float]
    kinds: list[float]
    long: float

    def accepts(self, x: Column) -> Column:
        z = F.lit(self.bias) + F.when(x["long"], self.long).otherwise(0.0)
        for (i, vote), w in self.votes.items():
            z = z + F.when(x[f"v{i}"] == vote, w).otherwise(0.0)
        for k, w in enumerate(self.kinds):
            z = z + F.when(x["kind"] == k, w).otherwise(0.0)
        return z > 0


def aggregate_votes(rows: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[float, list[dict[int, tuple[float, float]]], dict[tuple[int, ...], float]]:
    """Expectation-maximisation over (votes, count): prior, and for each labeler P(vote | true), P(vote | false), and posteriors.

    It starts from a majority, so that agreeing labelers define what true means.
    """
    post = {v: min(0.95, max(0.05, 0.5 + 0.3 * sum(v))) for v, _ in rows}
    total = sum(n for _, n in rows)
    prior, tables = 0.5, []
    for _ in range(rounds):
        true = sum(post[v] * n for v, n in rows)
        prior = min(0.99, max(0.01, true / max(total, 1)))
        tables = []
        for i in range(len(LABELERS)):
            table = {}
            for vote in (-1, 0, 1):
                p = sum(post[v] * n for v, n in rows if v[i] == vote)
                q = sum((1 - post[v]) * n for v, n in rows if v[i] == vote)
                table[vote] = (p + 1 + (vote > 0)) / (true + 4), (q + 1 + (vote < 0)) / (total - true + 4)
            tables.append(table)
        for v, _ in rows:
            z = math.log(prior / (1 - prior)) + sum(math.log(tables[i][x][0] / tables[i][x][1]) for i, x in enumerate(v))
            post[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
    return prior, tables, post


def train_spans(rows: list[tuple[int, tuple[int, ...], bool, int]], steps: int = 300, rate: float = 0.5) -> SpanModel:
    """Logistic regression on the posteriors; rows: (kind, votes, long, count)."""
    by: dict[tuple[int, ...], int] = {}
    for _, v, _, n in rows:
        by[v] = by.get(v, 0) + n
    _, _, post = aggregate_votes(list(by.items()))
    model = SpanModel(0.0, {(i, s): 0.0 for i in range(len(LABELERS)) for s in (-1, 1)}, [0.0] * len(KINDS), 0.0)
    total = sum(n for *_, n in rows)
    for _ in range(steps if total else 0):
        g = SpanModel(0.0, dict.fromkeys(model.votes, 0.0), [0.0] * len(KINDS), 0.0)
        for kind, v, long, n in rows:
            z = model.bias + model.kinds[kind] + model.long * long + sum(model.votes.get((i, s), 0.0) for i, s in enumerate(v))
            e = n / total * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - post[v])
            g.bias += e
            g.kinds[kind] += e
            g.long += e * long
            for i, s in enumerate(v):
                if s:
                    g.votes[i, s] += e
        model.bias -= rate * g.bias
        model.long -= rate * (g.long + 1e-3 * model.long)
        model.kinds = [w - rate * (d + 1e-3 * w) for w, d in zip(model.kinds, g.kinds, strict=True)]
        model.votes = {k: w - rate * (g.votes[k] + 1e-3 * w) for k, w in model.votes.items()}
    return model if total else SpanModel(-1.0, {}, [0.0] * len(KINDS), 0.0)


def fit(candidates: DataFrame, cands: str = "candidates") -> SpanModel:
    """From the counts of vote patterns of all candidates."""
    votes = [F.col(f"x.v{i}").alias(f"v{i}") for i in range(len(LABELERS))]
    counts = candidates.select(F.explode(cands).alias("x")).groupBy(F.col("x.kind").alias("kind"), *votes, F.col("x.long").alias("long")).agg(F.count("*").alias("n")).collect()
    return train_spans(sorted((r["kind"], tuple(r[f"v{i}"] for i in range(len(LABELERS))), r["long"], r["n"]) for r in counts))


def spans(model: SpanModel, cands: str = "candidates") -> Column:
    """The candidates that are base or accepted."""
    return F.filter(cands, lambda x: x["base"] | model.accepts(x))


def _written(found: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def _replaced(text: Column, found: Column) -> Column:
    """text with each of its spans as its kind in brackets; of spans that overlap the first.

    The text is cut into blocks once, since a place in a string is found by reading up to it.
    """
    labels = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    by_start = F.array_sort(F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))

    def cut(blocks: Column, a: Column, b: Column) -> Column:
        i, j = F.floor(a / BLOCK).cast("int"), F.floor(b / BLOCK).cast("int")
        first, last = F.get(blocks, i), F.coalesce(F.get(blocks, j), F.lit(""))
        across = F.concat(F.substring(first, a % BLOCK + 1, F.lit(BLOCK)), F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(last, F.lit(1), b % BLOCK))
        return F.when(a >= b, "").when(i == j, F.substring(first, a % BLOCK + 1, b - a)).otherwise(across)

    def clean(blocks: Column) -> Column:
        def step(at: Column, x: Column) -> Column:
            piece = F.concat(cut(blocks, at, x["start"]), F.get(labels, x["kind"]))
            return F.struct(F.greatest(at, x["end"]).alias("state"), F.when(x["start"] < at, F.array().cast("array<string>")).otherwise(F.array(piece)).alias("made"))

        pieces = scan(by_start, F.lit(0), "string", step)
        return F.array_join(F.concat(pieces, F.array(cut(blocks, F.array_max(F.transform(found, lambda x: x["end"])), F.length(text)))), "")

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / BLOCK).cast("int")), lambda i: F.substring(text, i * BLOCK + 1, F.lit(BLOCK)))
    return F.when(F.size(found) == 0, text).otherwise(let(blocks, clean))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """documents with every span replaced by its kind in brackets; null texts stay null, texts without spans unchanged."""
    names = docs.columns
    # written, since the candidates are read twice: to learn from, and to decide on
    told = materialise(with_candidates(docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col(f"`{text_col}`").alias("text"))).drop("text"), "candidates")
    model = fit(told)
    text = F.col("row").getField(text_col)
    return told.select("row", spans(model).alias("found")).select(*((_replaced(text, F.col("found")) if c == text_col else F.col("row").getField(c)).alias(c) for c in names))


def op3_pii(docs: DataFrame) -> DataFrame:
    found = materialise(with_candidates(docs.select("doc_id", "text")).drop("text"), "candidates")
    base = F.filter("candidates", lambda x: x["base"])
    number = lambda k: F.size(F.filter("candidates", lambda x: x["base"] & (x["kind"] == k))).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *(number(k) for k in range(len(KINDS))), F.sha2(_written(base), 256).alias("base_sha256"), _written(spans(fit(found))).alias("spans"))
