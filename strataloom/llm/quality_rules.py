"""Quality rules as a learned decision list (operator 7); DataFrame functions only.

Statistics of each whole text are native expressions. From labelled rows a decision list is learned by
sequential covering: a rule, a conjunction of thresholds, is grown on two thirds of the rows still uncovered
by information gain, pruned on the last third, and kept while it is precise there; the rows it covers are
set aside and the next rule is grown. The list becomes an ordered Spark conditional expression.

The list is fitted on the statistics of at most SAMPLE_ROWS labelled rows that pass the base rules; all
statistics and verdicts cover every row and whole texts.

Defined results: null, empty and blank texts have no words and fail the base rules. Without labels of both
kinds the list is empty and keeps what passes the base rules. Of rows that share an id one is learned from. Repeated rows give repeated results. Windows
are compared by a 64-bit hash within their text. Columns named like a statistic are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import fresh, let, lowest_hashes, materialise, one_for_each

SAMPLE_ROWS = 4000
SPACE = "[\\x20\\x09-\\x0D]+"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Share of rejected rows among those that a rule covers, on the rows it was pruned on.
MIN_PRECISION = 0.95
MIN_COVERED = 3
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_distinct")
FEATURES = ("symbol_rate", "upper_rate", "mark_rate", "repeat_rate", "dup_lines", "distinct_rate", "word_length")


def repeat_words(words: Column) -> Column:
    """Words that lie in a window of three words which occurs twice or more."""
    n = F.size(words)
    keyed = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    twice = let(F.sort_array(keyed), lambda s: F.filter(s, lambda x, j: F.coalesce((F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]), F.get(s, j - 1)["h"] == x["h"], F.get(s, j + 1)["h"] == x["h"], F.lit(False))))
    at = F.transform(twice, lambda x: x["i"])
    covered = let(at, lambda p: F.size(F.array_distinct(F.concat(p, F.transform(p, lambda i: i + 1), F.transform(p, lambda i: i + 2)))))
    return F.when(n < 4, 0).otherwise(covered).cast("long")


def with_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the columns STATS, of bigint.

    All that needs the words is one expression in which they are bound once: if the optimizer copies it
    into a filter, the filter repeats it once, not for every word.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = [c for c in docs.columns if c not in STATS]
    whole, bound = fresh("__text", kept), fresh("__counts", kept)

    def counts(w: Column) -> Column:
        return F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), repeat_words(w).alias("n_repeat_words"), F.size(F.array_distinct(w)).alias("n_distinct"))

    counted = docs.select(*kept, text.alias(whole), let(F.array_remove(F.split(text, SPACE, -1), ""), counts).alias(bound))
    t = F.col(whole)
    lines = let(F.filter(F.split(t, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    made = {
        "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")),
        "n_dup_lines": F.when(F.contains(t, F.lit("\n")), lines).otherwise(0),
        "n_upper": F.regexp_count(t, F.lit("[A-Z]")),
        "n_marks": F.regexp_count(t, F.lit("[!?]")),
    }
    return counted.select(*kept, *(made.get(c, F.col(f"{bound}.{c}")).cast("long").alias(c) for c in STATS))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def features() -> dict[str, Column]:
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "symbol_rate": F.col("n_symbols") / words,
        "upper_rate": F.col("n_upper") / chars,
        "mark_rate": F.col("n_marks") / words,
        "repeat_rate": F.col("n_repeat_words") / words,
        "dup_lines": F.col("n_dup_lines").cast("double"),
        "distinct_rate": F.col("n_distinct") / words,
        "word_length": F.col("word_chars") / words,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] >= self.threshold if self.above else row[self.feature] <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, row: dict) -> bool:
    return all(c.holds(row) for c in rule)


def _split(rule: Rule, rows: list[dict]) -> tuple[int, int]:
    """(rejected, kept) rows that a rule covers."""
    inside = [r["reject"] for r in rows if covers(rule, r)]
    return sum(inside), len(inside) - sum(inside)


def _cuts(rows: list[dict], feature: str, above: bool) -> Iterator[tuple[float, int, int]]:
    """(threshold, rejected rows, rows) for each value of a feature: what lies at or beyond it."""
    q = m = 0
    for value, group in groupby(sorted(rows, key=lambda r: r[feature], reverse=above), key=lambda r: r[feature]):
        hit = [r["reject"] for r in group]
        q, m = q + sum(hit), m + len(hit)
        yield value, q, m


def _grow(rows: list[dict]) -> Rule:
    """Add the condition of the largest information gain until no kept row is covered."""
    rule: Rule = ()
    inside = rows
    while True:
        p = sum(r["reject"] for r in inside)
        n = len(inside) - p
        if not p or not n:
            return rule
        best, gain = None, 1e-9
        for f in FEATURES:
            for above in (True, False):
                for cut, q, m in _cuts(inside, f, above):
                    g = q * (math.log2(q / m) - math.log2(p / (p + n))) if q else 0.0
                    if g > gain:
                        best, gain = Condition(f, above, cut), g
        if best is None:
            return rule
        rule += (best,)
        inside = [r for r in inside if best.holds(r)]


def _prune(rule: Rule, rows: list[dict]) -> Rule:
    """The shortest beginning of a rule that does best on rows it was not grown on."""
    def worth(r: Rule) -> float:
        p, n = _split(r, rows)
        return (p - n) / max(1, p + n)

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)), default=())


def learn(rows: list[dict]) -> list[Rule]:
    """Sequential covering; rows hold FEATURES, `reject` and `fold` (0, 1 grow, 2 prunes)."""
    found: list[Rule] = []
    left = rows
    while True:
        grow, prune = [r for r in left if r["fold"] != 2], [r for r in left if r["fold"] == 2]
        rule = _prune(_grow(grow), prune)
        p, n = _split(rule, left)
        held_p, held_n = _split(rule, prune)
        if not rule or p < MIN_COVERED or p < MIN_PRECISION * (p + n) or held_p < MIN_PRECISION * (held_p + held_n):
            return found
        found.append(rule)
        left = [r for r in left if not covers(rule, r)]


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The decision list from at most `rows` labelled documents (quality 0 is rejected)."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    wanted = lowest_hashes(usable.select("doc_id", (1 - F.col("quality")).cast("int").alias("reject")), "doc_id", rows).distinct()
    # joined first, so that only the wanted texts are read; the second join then gives one row for each
    told = with_stats(docs.select("doc_id", "text").join(F.broadcast(wanted.select("doc_id").distinct()), "doc_id"))
    got = one_for_each(materialise(told.drop("text"), "statistics"), ["doc_id", "reject"], wanted)
    got = got.where(~base_failed()).select("reject", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)).alias("fold"), *(c.alias(f) for f, c in features().items()))
    return learn(sorted((r.asDict() for r in got.collect()), key=lambda r: tuple(r.values())))


def verdict(rules: list[Rule]) -> Column:
    """The list as an ordered conditional over the columns STATS: true keeps."""
    made = features()
    out = None
    for rule in rules:
        hit = F.lit(True)
        for c in rule:
            hit = hit & (made[c.feature] >= c.threshold if c.above else made[c.feature] <= c.threshold)
        out = F.when(hit, False) if out is None else out.when(hit, False)
    return F.lit(True) if out is None else out.otherwise(True)


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """docs with STATS, base_failed and kept."""
    told = with_stats(docs, text_col).withColumn("base_failed", base_failed())
    return told.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """documents that the rules keep."""
    names = docs.columns
    told = judge(docs.select(F.struct(*names).alias("__row"), F.col("text")), fit(docs, labels))
    # a generator, not a filter, which would be pushed below the statistics and repeat them
    return told.select(F.explode(F.when(F.col("kept"), F.array("__row"))).alias("__row")).select("__row.*")


def op7_quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    told = judge(docs.select("doc_id", "text"), fit(docs, labels))
    return told.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
