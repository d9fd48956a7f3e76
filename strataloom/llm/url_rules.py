"""URL filter by association rules (operator 10); DataFrame functions and Spark's FP-growth only.

Listed rules (host, path) decide the urls they fit. All others are judged by mined rules: a url becomes a
set of tokens (labels of its host, segments of its path, names of its parameters) plus a label; FP-growth
mines which combinations of tokens urls labelled `block` share; combinations are pruned by
support relative to those urls, by confidence over all urls, and if a part of them blocks as surely. Labels
do not come from the url: a page is bad by its text, out of which its host and the labels of that are taken:
by the density of advert terms, by repeated blocks, or by the share of links.
Pages of the held-out fold (HELD_OUT of crc32 of the id) are not mined. Matching goes through an inverted
index: each mined rule stands under its rarest token, and is verified where that token occurs. It runs once for
each distinct set of tokens.

FP-growth has no bound on the size of a set, and a run of tokens that always stand together has a number of
parts exponential in its length; so tokens that the same urls bear are mined as one, the first of them by name.

Defined results: null urls and urls without `://` have an empty host and path, no listed rule and the verdict
allow. A null or empty html is not bad. Null ids are not held out. Repeated rows and ids give repeated results.
An empty table mines nothing. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import in_fold, let, materialise

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with its own.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Words of a page's text that mark it as bad for learning; fixed values.
TERMS = ("casino", "bets", "poker", "pills", "viagra", "adult", "porn", "xxx", "spam", "ads")
MIN_SUPPORT = 0.001
MIN_COUNT = 5
MIN_CONFIDENCE = 0.9
#: Words of a page for each of which one term makes it bad.
WORDS_PER_TERM = 4000
#: Share of repeated blocks of text, and of letters in links, that makes a page bad; characters of a block.
REPEATED = 0.3
LINKED = 0.5
BLOCK_CHARS = 20
#: (parts, which): the fold of pages that is not learned from.
HELD_OUT = (5, 0)
BLOCK = "=block"
_HIDDEN = r"(?is)<(?:script|style)\b.*?(?:</(?:script|style)\s*+>|\z)|<!--.*?(?:-->|\z)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*+)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*+([^?#]*+)", 1), F.lit(""))


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a url in order; numbers in paths are no tokens."""
    labels = F.transform(F.split(host, r"[.\-:]"), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(path, "[/.]"), lambda x: F.concat(F.lit("p:"), x))
    query = F.coalesce(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit(""))
    names = F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("q:"), F.split(x, "=")[0]))
    every = F.concat(labels, segments, names)
    return F.array_sort(F.array_distinct(F.filter(every, lambda x: (F.length(x) > 2) & ~x.rlike("^p:[0-9]+$"))))


def listed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest listed rule that fits, null if none does."""
    rule = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if rule is None else (rule, verdict)


def visible_words(html: Column) -> Column:
    """The text of a page without scripts, styles and tags; what a script leaves open is dropped with it."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), _HIDDEN, " ")
    return F.regexp_replace(bare, r"<[^>]*+>?", " ")


def without_host(text: Column, host: Column) -> Column:
    """A text in lower case (A-Z) without the host, nor any of its labels as a word."""
    low = F.translate(text, _UPPER, _LOWER)
    bare = F.when(host == "", low).otherwise(F.replace(low, host, F.lit(" ")))
    labels = F.filter(F.split(host, r"[.\-:]"), lambda x: x.rlike(r"^\w+$"))
    names = F.array_join(labels, "|")
    return F.when(names == "", bare).otherwise(F.regexp_replace(bare, F.concat(F.lit("\\b(?:"), names, F.lit(")\\b")), F.lit(" ")))


def bad_page(html: Column, host: Column, terms=TERMS, words_per_term: int = WORDS_PER_TERM, repeated: float = REPEATED, linked: float = LINKED) -> Column:
    """Whether a page is bad for learning, by its text without its host.

    It is if it names one of the terms for each words_per_term words, or any in a shorter text; if `repeated` of its
    blocks of text (between tags, BLOCK_CHARS characters or more) equal an earlier one; or if `linked` of its letters stand in links.
    """
    named = F.lit("\\b(?:" + "|".join(terms) + ")\\b")
    words = lambda t: F.regexp_count(t, F.lit("[^\\x20\\x09-\\x0D]++"))
    said = let(without_host(visible_words(html), host), lambda t: let(F.regexp_count(t, named), lambda n: (n > 0) & (n * words_per_term >= words(t))))
    hidden = F.regexp_replace(F.coalesce(html, F.lit("")), _HIDDEN, " ")

    def shape(h: Column) -> Column:
        blocks = F.filter(F.split(h, r"<[^>]*+>?"), lambda x: F.length(F.trim(x)) >= BLOCK_CHARS)
        again = let(F.transform(blocks, lambda x: F.trim(x)), lambda b: F.size(b) - F.size(F.array_distinct(b)) >= F.greatest(F.lit(1), F.size(b) * repeated))
        letters = F.aggregate(F.regexp_extract_all(h, F.lit(r"(?i)<a\b[^<>]*+>([^<]*+)"), 1), F.lit(0), lambda n, x: n + F.length(F.regexp_replace(x, r"\s++", "")))
        shown = F.length(F.regexp_replace(h, r"<[^>]*+>?|\s++", ""))
        return again | ((letters > 0) & (letters >= linked * shown))

    return said | let(hidden, shape)


def _counts(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """(tokens, rows): how many rows of sets (tokens, rows) hold each wanted set of tokens, and (anchor) its rarest token.

    A wanted set stands under its rarest token and is verified where that token occurs.
    """
    rarity = materialise(sets.select(F.explode("tokens").alias("token"), "rows").groupBy("token").agg(F.sum("rows").alias("freq")), "rarity")
    each = wanted.select("tokens", F.explode("tokens").alias("token")).join(rarity, "token")
    anchored = materialise(each.groupBy("tokens").agg(F.min(F.struct("freq", "token")).alias("x")).select("tokens", F.col("x.freq").alias("freq"), F.col("x.token").alias("anchor")), "anchored")
    one = anchored.where(F.size("tokens") == 1).select("tokens", "anchor", F.col("freq").alias("rows"))
    index = anchored.where(F.size("tokens") > 1).select(F.col("anchor").alias("token"), F.col("tokens").alias("needed"))
    hits = sets.select("tokens", "rows", F.explode("tokens").alias("token")).join(index, "token").where(F.size(F.array_except("needed", "tokens")) == 0)
    return one.unionByName(hits.groupBy(F.col("needed").alias("tokens"), F.col("token").alias("anchor")).agg(F.sum("rows").alias("rows")))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE, max_tokens: int | None = None) -> DataFrame:
    """Rules (number, tokens, confidence, support, anchor) from rows of tokens and bad (boolean).

    Sets of tokens are mined on the bad rows, with a support relative to these; their confidence is counted
    over all rows. max_tokens bounds the tokens of a rule; None doesn't.
    """
    spark = labelled.sparkSession
    rows = labelled.where(F.size("tokens") > 0).groupBy("tokens").agg(F.count("*").alias("rows"), F.count_if("bad").alias("bad"))
    rows = materialise(rows, "sets")
    n, bad = rows.agg(F.sum("rows"), F.sum("bad")).first()
    shape = "number bigint, tokens array<string>, confidence double, support double, anchor string"
    if not bad:
        return spark.createDataFrame([], shape)
    least = math.ceil(max(min_count, min_support * bad))
    single = rows.select(F.explode("tokens").alias("token"), "rows", "bad").groupBy("token").agg(F.sum("rows").alias("rows"), F.sum("bad").alias("bad"))
    single = materialise(single.where(F.col("bad") >= least), "singles")
    # tokens that the same sets bear are one item
    where = rows.select(F.xxhash64("tokens").cast("decimal(20,0)").alias("h"), F.explode("tokens").alias("token")).join(single.select("token"), "token")
    mixed = where.groupBy("token").agg(F.count("*").alias("n"), F.sum("h").alias("h")).groupBy("n", "h").agg(F.min("token").alias("token"))
    mixed = materialise(mixed.select("token"), "mixed")
    numbered = rows.where("bad > 0").select(F.monotonically_increasing_id().alias("set"), "tokens", "bad")
    numbered = materialise(numbered, "bad_sets")
    left = numbered.select("set", "bad", F.explode("tokens").alias("token")).join(mixed, "token").groupBy("set", "bad").agg(F.collect_set("token").alias("items"))
    # each set as often as it occurs in bad rows
    items = left.select("items", F.explode(F.sequence(F.lit(1), F.col("bad").cast("int")))).select("items")
    items = materialise(items, "items")
    total = items.count()
    if not total:
        return spark.createDataFrame([], shape)
    sets = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / total), minConfidence=min_confidence).fit(items).freqItemsets
    if max_tokens is not None:
        sets = sets.where(F.size("items") <= max_tokens)
    wanted = materialise(sets.select(F.array_sort("items").alias("tokens"), "freq"), "mined")
    counted = wanted.join(_counts(rows.select("tokens", "rows"), wanted), "tokens")
    confidence = F.col("freq") / F.col("rows")
    found = materialise(counted.where(confidence >= min_confidence).select("tokens", confidence.alias("confidence"), (F.col("freq") / n).alias("support"), "anchor"), "confident")
    # a rule is needless if a part of its tokens blocks as surely
    each = found.select("tokens", "confidence", F.explode("tokens").alias("token"))
    parts = found.select(F.col("tokens").alias("part"), F.col("confidence").alias("sure"), F.col("anchor").alias("token"))
    needless = each.join(parts, "token").where((F.size("part") < F.size("tokens")) & (F.size(F.array_except("part", "tokens")) == 0) & (F.col("sure") >= F.col("confidence"))).select("tokens").distinct()
    kept = found.join(needless, "tokens", "left_anti")
    return materialise(kept.select(F.xxhash64("tokens").alias("number"), "tokens", "confidence", "support", "anchor"), "rules")


def match(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, confidence, support) of the surest mined rule for each distinct set of tokens that has one."""
    index = rules.select(F.col("anchor").alias("token"), F.col("tokens").alias("needed"), "confidence", "support")
    hits = sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token")
    hits = hits.where(F.size(F.array_except("needed", "tokens")) == 0)
    return hits.groupBy("tokens").agg(F.max(F.struct("confidence", "support")).alias("best")).select("tokens", "best.confidence", "best.support")


def judge(pages: DataFrame, rules=RULES, terms=TERMS, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, host, path, rule, verdict, confidence, bad, held_out): verdict from the listed rules, else from the mined ones."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    slim = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), bad_page(F.col(html_col), host_of(F.col(url_col)), terms).alias("bad"))
    split = slim.select("id", "url", "bad", in_fold(F.col("id"), *HELD_OUT).alias("held_out"), host.alias("host"), path.alias("path"))
    rule, listed = listed_rule(F.col("host"), F.col("path"), rules)
    split = materialise(split.select("id", "host", "path", "bad", "held_out", rule.alias("rule"), listed.alias("listed"), tokens_of(F.col("url"), F.col("host"), F.col("path")).alias("tokens")), "urls")
    mined = mine(split.where("not held_out").select("tokens", "bad"))
    # written, so that Spark can split the other side of the join where very many urls have the same tokens
    found = materialise(match(split.where(F.col("listed").isNull()).select("tokens").distinct(), mined), "matched")
    judged = split.join(found, "tokens", "left")
    verdict = F.coalesce(F.col("listed"), F.when(F.col("confidence").isNotNull(), "block").otherwise("allow"))
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "confidence", "bad", "held_out")


def op10_url_rules(pages: DataFrame) -> DataFrame:
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")
