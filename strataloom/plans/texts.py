"""Document operators over documents, pages and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.operators import text as X
from strataloom.plans.metrics import _r
from strataloom.registry import query

WS = "chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def strip_sql(x):
    return f"trim({x}, {WS})"


def windows_sql(table, key, text, size, overlap, extra=""):
    """Rows (key, chunk_index, content) in DuckDB."""
    stride = max(64, size - overlap)
    return f"""SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY k) - 1 AS INTEGER) AS chunk_index, content{extra} FROM (
      SELECT {key}{extra}, k, {strip_sql(f'substr(b, CAST(k * {stride} + 1 AS BIGINT), {size})')} AS content FROM (
        SELECT {key}{extra}, b, unnest(generate_series(0, CAST(greatest(ceil((length(b) - {size}) / {float(stride)}), 0) AS BIGINT))) AS k FROM (SELECT *, {strip_sql(f"coalesce({text}, '')")} AS b FROM {table}))) WHERE content <> ''"""


def score_sql(x):
    n = f"length({strip_sql(x)})"
    letters = f"(CAST(length(regexp_replace({x}, '[^\\pL]+', '', 'g')) AS DOUBLE) / {n})"
    by = f"(CASE WHEN {n} BETWEEN 500 AND 2000 THEN 1.0::DOUBLE WHEN {n} < 500 THEN CAST({n} AS DOUBLE) / 500 ELSE greatest(0.5::DOUBLE, 1 - CAST({n} - 2000 AS DOUBLE) / 4000) END)"
    return f"CASE WHEN {n} = 0 THEN 0.0::DOUBLE WHEN {n} < 20 THEN 0.1::DOUBLE WHEN {letters} < 0.1 THEN 0.2::DOUBLE ELSE {_r(f'least(1.0::DOUBLE, {letters} * 0.4::DOUBLE + {by} * 0.6::DOUBLE)', 3)} END"


_NOISY = "'Page 1 of 9' || chr(10) || text || chr(10) || chr(10) || chr(10) || chr(10) || 'All rights reserved.' || chr(10) || 'end，ok。'"


def _noisy():
    return F.concat(F.lit("Page 1 of 9\n"), "text", F.lit("\n\n\n\nAll rights reserved.\nend，ok。"))


@query(f"""SELECT doc_id, {strip_sql(r"regexp_replace(regexp_replace(translate(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(" + _NOISY + r"), '(?m)^\s*Page\s+\d+\s+of\s+\d+\s*$', '', 'g'), '(?m)^\s*All\s+rights\s+reserved\.?\s*$', '', 'g'), '(?m)^\s*Copyright\s+©.*$', '', 'g'), '，。！？；：（）【】《》', ',.!?;:()[]<>'), '\n{3,}', chr(10) || chr(10), 'g'), '(?m)[ \t\x0b\f\r]+$', '', 'g')")} AS text FROM documents""")
def doc_clean(t):
    return t.documents.select("doc_id", X.clean(_noisy()).alias("text"))


@query(windows_sql("documents", "doc_id", "text", 1500, 200))
def chunk_fixed(t):
    return X.chunk_fixed(t.documents)


_MARKED = "'preamble' || chr(10) || '# ' || replace(text, chr(10), chr(10) || '## ')"
_HEADING = "(?m)^(#{1,6}[ \\t]+\\S)"
#: Sections in order, and how each is cut: whole (0), as windows under its heading (1), or as plain windows (2).
_SECTIONS = f"""(SELECT doc_id, n, s, head, CASE WHEN NOT has THEN 2 WHEN length(s) <= 700 THEN 0 WHEN 2 * length(head) > 700 THEN 2 ELSE 1 END AS how FROM (
    SELECT doc_id, n, has, s, string_split(s, chr(10))[1] AS head FROM (
      SELECT doc_id, has, {strip_sql('s')} AS s, n FROM (SELECT doc_id, regexp_matches(b, '{_HEADING}') AS has, unnest(parts) AS s, unnest(generate_series(1, len(parts))) AS n FROM (SELECT doc_id, b, string_split(regexp_replace(b, '{_HEADING}', chr(1) || '\\1', 'g'), chr(1)) AS parts FROM (SELECT doc_id, {_MARKED} AS b FROM documents)))) WHERE s <> ''))"""
_CUT = f"""(SELECT doc_id, n, head, how, CASE how WHEN 1 THEN {strip_sql("substr(s, length(head) + 1)")} ELSE s END AS b, CASE how WHEN 1 THEN 700 - length(head) - 5 ELSE 700 END AS size FROM {_SECTIONS})"""


@query(f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n, k) - 1 AS INTEGER) AS chunk_index, CASE how WHEN 1 THEN head || CASE WHEN k = 0 THEN chr(10) ELSE '（续）' || chr(10) END || content ELSE content END AS content FROM (
  SELECT doc_id, n, how, head, CASE WHEN how = 1 THEN row_number() OVER (PARTITION BY doc_id, n ORDER BY k) - 1 ELSE k END AS k, content FROM (
    SELECT doc_id, n, how, head, k, {strip_sql('substr(b, CAST(k * greatest(least(64, size), size - 100) + 1 AS BIGINT), size)')} AS content FROM (
      SELECT *, unnest(generate_series(0, CASE how WHEN 0 THEN 0 ELSE CAST(greatest(ceil((length(b) - size) / CAST(greatest(least(64, size), size - 100) AS DOUBLE)), 0) AS BIGINT) END)) AS k FROM {_CUT})) WHERE content <> '')""")
def chunk_heading(t):
    marked = F.concat(F.lit("preamble\n# "), F.regexp_replace("text", "\n", "\n## "))
    return X.chunk_heading(t.documents.select("doc_id", marked.alias("text")), 700, 100)


_PARENTS = windows_sql("documents", "doc_id", "text", 1500, 200)


@query(f"""WITH p AS (SELECT doc_id, chunk_index AS parent_index, content, doc_id * 100000 + chunk_index AS pk FROM ({_PARENTS}))
  SELECT doc_id, parent_index, -1 AS child_index, content FROM p UNION ALL SELECT pk // 100000, CAST(pk % 100000 AS INTEGER), chunk_index, content FROM ({windows_sql('p', 'pk', 'content', 375, 100)})""")
def chunk_hierarchical(t):
    return X.chunk_hierarchical(t.documents)


@query(f"""WITH c AS ({windows_sql('documents', 'doc_id', 'text', 1700, 220, ', source, lang')}), n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY 1)
  SELECT doc_id, chunk_index, 'title: ' || source || chr(10) || 'summary: ' || lang || CASE WHEN n > 1 THEN chr(10) || 'part ' || (chunk_index + 1) || '/' || n || chr(10) ELSE chr(10) END || content AS content FROM c JOIN n USING (doc_id)
  UNION ALL SELECT doc_id, 0, 'title: ' || source || chr(10) || 'summary: ' || lang FROM documents WHERE {strip_sql("coalesce(text, '')")} = ''""")
def chunk_entry_embed(t):
    return X.chunk_entry(t.documents, "doc_id", "source", "lang", "text")


@query(f"SELECT doc_id, chunk_index, {score_sql('content')} AS score FROM ({windows_sql('documents', 'doc_id', 'text', 1500, 200)})")
def chunk_score(t):
    return X.chunk_fixed(t.documents).select("doc_id", "chunk_index", X.score(F.col("content")).alias("score"))


@query(f"SELECT * FROM (SELECT doc_id, chunk_index, content, {score_sql('content')} AS score FROM ({windows_sql('documents', 'doc_id', 'text', 700, 80)}) WHERE length(content) >= 20) WHERE score >= 0.15")
def chunk_filter(t):
    return X.filter_chunks(X.chunk_fixed(t.documents, 700, 80))


@query("""WITH s AS (SELECT doc_id, sha256(text) AS h FROM documents) SELECT doc_id, [CAST(CAST('0x' || substr(h, CAST(2 * (i % 32) + 1 AS BIGINT), 2) AS INTEGER) AS DOUBLE) / 255.0::DOUBLE * 2.0::DOUBLE - 1.0::DOUBLE FOR i IN generate_series(0, 63)] AS embedding FROM s""")
def embed_hash(t):
    return t.documents.select("doc_id", X.embed_hash(F.col("text")).alias("embedding"))


_LINE = f"trim(regexp_replace(regexp_replace({strip_sql('text')}, '[\\n\\r\\t]+', ' ', 'g'), ' +', ' ', 'g'), ' ')"


@query(f"SELECT doc_id, sha256(source || chr(10) || text) AS content_hash, CASE WHEN length({_LINE}) <= 420 THEN {_LINE} ELSE rtrim(substr({_LINE}, 1, 419), ' ') || '…' END AS excerpt FROM documents")
def content_hash(t):
    return t.documents.select("doc_id", X.content_hash(F.col("source"), F.col("text")).alias("content_hash"), X.excerpt(F.col("text")).alias("excerpt"))


@query(f"SELECT doc_id, CASE WHEN length(b) <= 800 THEN b ELSE substr(b, 1, 400) || chr(10) || chr(10) || '[...]' || chr(10) || chr(10) || right(b, 400) END AS text FROM (SELECT doc_id, {strip_sql('text')} AS b FROM documents)")
def head_tail_truncate(t):
    return t.documents.select("doc_id", X.head_and_tail(F.col("text"), 800).alias("text"))


_ROLE = "CASE user_id % 4 WHEN 0 THEN 'join_guide' WHEN 1 THEN 'business_metric' WHEN 2 THEN 'odd' ELSE 'column_glossary' END"


def _metas(t):
    role = F.expr(_ROLE)
    meta = F.to_json(F.struct(role.alias("semantic_role"), F.struct(F.array(F.lit(" orders "), F.lit(""), "event_type").alias("table_refs")).alias("grounding"), F.array(F.struct(F.col("event_type").alias("left"), F.when(F.col("event_id") % 3 == 0, "").otherwise("users").alias("right"), F.lit("a = b").alias("on"))).alias("join_edges"), (F.col("event_id") % 200).alias("confidence")))
    return t.events.select("event_id", (F.col("user_id") % 50).alias("doc"), meta.alias("meta"))


@query(f"""SELECT event_id, CASE WHEN user_id % 4 = 2 THEN 'general_reference' ELSE {_ROLE} END AS role, ['orders', event_type] AS table_refs, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS joins, CAST(least(event_id % 200, 100) AS DOUBLE) AS confidence FROM events""")
def chunk_meta_normalise(t):
    made = _metas(t).select("event_id", X.normalise_meta(F.col("meta")).alias("m"))
    return made.select("event_id", "m.role", "m.table_refs", F.size("m.join_edges").alias("joins"), "m.confidence")


@query(f"""WITH m AS (SELECT user_id % 50 AS doc, CASE WHEN user_id % 4 = 2 THEN 'general_reference' ELSE {_ROLE} END AS role, greatest(1.0::DOUBLE, CAST(least(event_id % 200, 100) AS DOUBLE)) AS c FROM events), s AS (SELECT doc, role, sum(c) AS weight FROM m GROUP BY 1, 2)
  SELECT doc, role, weight FROM s QUALIFY row_number() OVER (PARTITION BY doc ORDER BY weight DESC, role) = 1""")
def doc_dominant_role(t):
    made = _metas(t).select("doc", X.normalise_meta(F.col("meta")).alias("m")).select("doc", "m.role", "m.confidence")
    return X.dominant_role(made, "doc")


@query(f"""WITH c AS (SELECT *, {score_sql('content')} AS score FROM ({windows_sql('documents', 'doc_id', 'text', 1500, 200)})) SELECT doc_id, chunk_index, score FROM c WHERE doc_id % 3 <> 0 AND score >= 0.4 ORDER BY score DESC, doc_id, chunk_index LIMIT 20""")
def chunk_eligible(t):
    chunks = X.chunk_fixed(t.documents).withColumn("score", X.score(F.col("content")))
    docs = t.documents.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "failed").otherwise("indexed").alias("status"))
    return X.eligible(chunks, docs).select("doc_id", "chunk_index", "score")


@query("""SELECT source, count(*) AS total, count(*) FILTER (doc_id % 4 > 1) AS indexed, count(*) FILTER (doc_id % 4 = 0) AS failed, count(*) FILTER (doc_id % 4 = 1) AS pending, count(*) FILTER (doc_id % 4 > 1) = count(*) AS complete,
  count(*) FILTER (doc_id % 4 = 0 AND doc_id % 5 < 3 AND length(trim(text)) > 0) AS can_retry FROM documents GROUP BY 1""")
def doc_index_status(t):
    status = F.when(F.col("doc_id") % 4 == 0, "failed").when(F.col("doc_id") % 4 == 1, "pending").otherwise("indexed")
    return X.index_status(t.documents.select("source", "text", status.alias("status"), (F.col("doc_id") % 5).alias("attempts")), "source")


_CLEAN = strip_sql(r"regexp_replace(regexp_replace(translate(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(coalesce(text, '')), '(?m)^\s*Page\s+\d+\s+of\s+\d+\s*$', '', 'g'), '(?m)^\s*All\s+rights\s+reserved\.?\s*$', '', 'g'), '(?m)^\s*Copyright\s+©.*$', '', 'g'), '，。！？；：（）【】《》', ',.!?;:()[]<>'), '\n{3,}', chr(10) || chr(10), 'g'), '(?m)[ \t\x0b\f\r]+$', '', 'g')")


@query(f"""WITH cleaned AS (SELECT doc_id, {_CLEAN} AS text FROM documents), c AS ({windows_sql('cleaned', 'doc_id', 'text', 1500, 200)}), good AS (SELECT doc_id, chunk_index, content, {score_sql('content')} AS score FROM c WHERE length(content) >= 20)
  SELECT doc_id, chunk_index, content, score, sha256(content) AS digest, CASE WHEN content IS NULL THEN 'failed' ELSE 'indexed' END AS status FROM cleaned LEFT JOIN (SELECT * FROM good WHERE score >= 0.15) USING (doc_id)""")
def docs_pipeline(t):
    """The embedding is checked by what it is made of: its first byte scaled must be the digest's."""
    made = X.pipeline(t.documents)
    first = F.conv(F.substring(F.sha2("content", 256), 1, 2), 16, 10).cast("int") / 255.0 * 2.0 - 1.0
    digest = F.when((F.size("embedding") == 64) & (F.get("embedding", F.lit(0)) == first), F.sha2("content", 256))
    return made.select("doc_id", "chunk_index", "content", "score", digest.alias("digest"), "status")


def _chain(x, steps):
    """The same steps in DuckDB, whose patterns have no possessive quantifiers."""
    for pattern, new in steps:
        plain = pattern.replace("++", "+").replace("*+", "*").replace("'", "''")
        x = f"regexp_replace({x}, '{plain}', '{new}', 'g')"
    return x


_TAG_END = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
#: The operator's steps as patterns, (pattern, replacement) in order: what has no visible text, line breaks of the source, blocks, all other tags.
_HTML_STEPS = (
    ("(?is)" + "|".join([r"<!--.*?(?:-->|\z)", *(rf"<{e}\b[^>]*>.*?(?:</{e}\s*>|\z)" for e in X.RAW)]), " "),
    ("(?is)" + "|".join(rf"<{e}\b[^>]*>.*?</{e}\s*>" for e in X.HIDDEN), " "),
    (r"[ \t\r\n\f\x0b]+", " "),
    (rf"(?i)</?(?:{X.BLOCKS})\b{_TAG_END}", "\n"),
    (rf"<[a-zA-Z/!?]{_TAG_END}", ""),
)
#: The same after character references are resolved: blanks, blank lines.
_TEXT_STEPS = ((r"[ \t\r\f\x0b]+", " "), (r" ?\n ?", "\n"), (r"\n{2,}", "\n"))


def html_sql(x):
    out = _chain(f"coalesce({x}, '')", _HTML_STEPS)
    for name, sign in (("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", "\xa0"), ("amp", "&")):
        out = f"replace({out}, '&{name};', '{sign}')"
    return strip_sql(_chain(out, _TEXT_STEPS))


@query(f"SELECT page_id, {html_sql('html')} AS text FROM pages")
def src_html_pages(t):
    return t.pages.select("page_id", X.html_text(F.col("html")).alias("text"))


@query(rf"""SELECT page_id, CASE WHEN s = '' THEN v ELSE v || CASE WHEN v = '' THEN '' ELSE chr(10) || chr(10) END || s END AS text FROM (SELECT page_id, substr(visible, 1, 100) AS v, CASE WHEN length(s) >= 40 AND regexp_matches(s, '\pL') AND NOT regexp_matches(s, '^(https?:)?//|^data:') AND (length(s) - length(replace(s, '/', '')) <= 12 OR contains(s, ' ')) THEN s ELSE '' END AS s
  FROM (SELECT page_id, visible, {strip_sql('substr(visible, 1, 60)')} AS s FROM (SELECT page_id, {html_sql('html')} AS visible FROM pages)))""")
def html_embedded_json_text(t):
    told = t.pages.select("page_id", "html", X.html_text(F.col("html")).alias("visible"))
    long = F.substring("visible", 1, 60)
    state = F.struct(F.array(long, long).alias("props"), F.lit("https://example.org/a/very/long/path/that/is/no/text").alias("u"), F.concat(F.lit("a setting that is no text of the page "), "visible").alias("buildId"))
    page = F.concat("html", F.lit('<script id="__NEXT_DATA__" type="application/json">'), F.to_json(state), F.lit("</script>"))
    return told.select("page_id", X.embedded_json_text(page, F.substring("visible", 1, 100)).alias("text"))
