"""Tables, lineage and joins found in SQL and code, one row for each finding; files have path and body."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_NAME = r"[`\"'\[]?(?:\w+\.)*(\w+)[`\"'\]]?"
#: Words that are no table names, fixed values.
NO_TABLE = ("select", "where", "from", "join", "on", "as", "and", "or", "set", "values")
#: Keys of configuration whose value is a table, fixed values.
TABLE_KEYS = ("table", "source_table", "target_table", "table_name", "tablename")
REFERENCES = (
    rf"(?i)\b(?:FROM|JOIN|INTO|UPDATE|TABLE)\s+{_NAME}",
    rf"(?i)\b(?:{'|'.join(TABLE_KEYS)})\s*:\s*['\"]?(\w+)",
    r"(?i)\bref\s*\(\s*['\"](\w+)['\"]",
    r"(?i)\bsource\s*\(\s*['\"]\w+['\"]\s*,\s*['\"](\w+)['\"]",
    r"(?i)__tablename__\s*=\s*['\"](\w+)['\"]",
)
#: What a statement writes to, and the first table that it reads.
WRITES = rf"(?i)^\s*(?:WITH\b(?s:.*?)\)\s*)?(?:INSERT\s+(?:INTO|OVERWRITE)(?:\s+TABLE)?|CREATE\s+(?:OR\s+REPLACE\s+)?(?:TABLE|VIEW)(?:\s+IF\s+NOT\s+EXISTS)?)\s+{_NAME}"
READS = rf"(?i)\bFROM\s+{_NAME}"
SELECTS = r"(?i)\bSELECT\b"
#: Names that a statement gives to its own queries.
NAMED = r"(?i)\b(\w+)\s+AS\s*\(\s*SELECT\b"
JOIN = rf"(?i)\b((?:INNER|LEFT|RIGHT|FULL)?(?:\s+OUTER)?\s*JOIN)\s+{_NAME}(?:\s+(?:AS\s+)?(?!ON\b)\w+)?\s+ON\s+([^;\n]+)"


def every(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def valid(name: Column) -> Column:
    return (F.length(name) >= 2) & ~name.rlike("^[0-9]+$") & ~F.lower(name).isin(*NO_TABLE)


def table_refs(files: DataFrame) -> DataFrame:
    """(path, name) of every table a file names, once."""
    found = F.flatten(F.array(*(every(F.col("body"), p, 1) for p in REFERENCES)))
    names = F.array_distinct(F.transform(found, F.lower))
    return files.select("path", F.explode(names).alias("name")).where(valid(F.col("name")))


def without_comments(sql: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(sql, r"(?s)/\*.*?\*/", " "), r"--[^\n]*", " ")


def lineage(files: DataFrame) -> DataFrame:
    """(path, source, target) of statements that insert or create from a SELECT, also after WITH: its first table that is none of its own queries; each pair once a file.

    Comments are taken out, and a body is cut into statements first, so that no pair spans two of them.
    """
    told = files.select("path", F.explode(F.split(without_comments(F.col("body")), ";")).alias("statement")).where(F.col("statement").rlike(SELECTS))
    name = lambda pattern: F.lower(F.regexp_extract("statement", pattern, 1))
    read, own = (F.transform(every(F.col("statement"), p, 1), F.lower) for p in (READS, NAMED))
    rows = told.select("path", F.get(F.array_except(read, own), F.lit(0)).alias("source"), name(WRITES).alias("target"))
    return rows.where(valid(F.col("source")) & valid(F.col("target")) & (F.col("source") != F.col("target"))).distinct()


_ALIASED = rf"(?i)\b(?:FROM|JOIN)\s+{_NAME}\s+(?:AS\s+)?(?!(?:ON|JOIN|INNER|LEFT|RIGHT|FULL|CROSS|OUTER|WHERE|GROUP|ORDER|UNION|USING|LIMIT|HAVING)\b)(\w+)"
_SIDES = r"(\w+)\.\w+\s*=\s*(\w+)\.\w+"


def joins(files: DataFrame) -> DataFrame:
    """(path, kind, left, right, on_text): the left side is the other table of the first `a.x = b.y` in the ON text, by its alias or, if it
    has more than two letters, by its name; else the first table after FROM. A body is cut into statements first."""
    b = F.col("statement")
    told = files.select("path", F.explode(F.split(without_comments(F.col("body")), ";")).alias("statement"))
    low = lambda i: F.transform(every(b, _ALIASED, i), F.lower)
    pairs = F.arrays_zip(low(2), low(1))
    found = F.arrays_zip(every(b, JOIN, 1), every(b, JOIN, 2), every(b, JOIN, 3))
    first = F.lower(F.regexp_extract(b, rf"(?i)\bFROM\s+{_NAME}", 1))
    rows = told.select("path", first.alias("first"), pairs.alias("aliases"), F.explode(found).alias("x"))
    word, on = F.upper(F.col("x")["0"]), F.substring(F.trim(F.col("x")["2"]), 1, 200)
    kind = F.when(F.contains(word, F.lit("LEFT")), "left").when(F.contains(word, F.lit("RIGHT")), "right").when(F.contains(word, F.lit("FULL")), "full").otherwise("inner")
    rows = rows.select("path", "first", "aliases", kind.alias("kind"), F.lower(F.col("x")["1"]).alias("right"), on.alias("on_text"))
    meant = lambda side: F.coalesce(F.get(F.filter("aliases", lambda a: a["0"] == side), F.lit(0))["1"], F.when((F.length(side) > 2) & valid(side), side))
    one, two = (meant(F.lower(F.regexp_extract("on_text", _SIDES, i))) for i in (1, 2))
    left = F.coalesce(F.when(one != F.col("right"), one), F.when(two != F.col("right"), two), F.col("first"))
    return rows.select("path", "kind", left.alias("left"), "right", "on_text").where((F.col("left") != "") & (F.col("left") != F.col("right"))).distinct()


def embedded(files: DataFrame) -> DataFrame:
    """SQL inside triple quotes, quoted strings of @Select and backticks, as files of their own."""
    b = F.col("body")
    found = F.flatten(F.array(every(b, r'(?s)"""(.*?)"""', 1), every(b, r"(?s)'''(.*?)'''", 1), every(b, r'(?s)@(?:Select|Insert|Update)\s*\(\s*"([^"]*)"', 1), every(b, r"(?s)`([^`\n]*\s[^`]*)`", 1), every(b, r'(?s)\.sql\(\s*"([^"]*)"', 1)))
    rows = files.select("path", F.posexplode(found).alias("n", "body"))
    return rows.where(F.col("body").rlike(r"(?i)\b(SELECT|INSERT|CREATE|MERGE|UPDATE)\b")).select("path", "body")


def spark_edges(files: DataFrame) -> DataFrame:
    """(path, kind, source, target, key) of Spark code: statements of sql(), joins of data frames, and temporary views.

    A data frame is named by the table it was read from where its file says so, else by its variable.
    """
    b = F.col("body")
    sql = lineage(embedded(files.where(F.contains(b, F.lit(".sql("))))).select("path", F.lit("sql").alias("kind"), "source", "target", F.lit("").alias("key"))
    read = r"(\w+)\s*=\s*\w+\.(?:read\.)?table\(\s*['\"](?:\w+\.)*(\w+)['\"]"
    join = r"(\w+)\.join\(\s*(\w+)\s*,\s*(?:on\s*=\s*)?\[?\s*['\"]?([\w.]+)['\"]?"
    view = r"(\w+)\.createOrReplaceTempView\(\s*['\"](\w+)['\"]"
    groups = lambda p, n: F.arrays_zip(*(every(b, p, i + 1).alias(f"g{i}") for i in range(n)))
    tables = F.map_from_entries(F.array_distinct(F.transform(every(b, read, 1), lambda v, i: F.struct(v, F.element_at(F.filter(groups(read, 2), lambda x: x["g0"] == v), -1)["g1"]))))
    told = files.select("path", tables.alias("tables"), groups(join, 3).alias("joins"), groups(view, 2).alias("views"))
    named = lambda v: F.lower(F.coalesce(F.try_element_at("tables", v), v))
    joined = told.select("path", "tables", F.explode("joins").alias("x")).select("path", F.lit("join").alias("kind"), named(F.col("x.g0")).alias("source"), named(F.col("x.g1")).alias("target"), F.element_at(F.split("x.g2", r"\."), -1).alias("key"))
    viewed = told.select("path", "tables", F.explode("views").alias("x")).select("path", F.lit("view").alias("kind"), named(F.col("x.g0")).alias("source"), F.lower("x.g1").alias("target"), F.lit("").alias("key"))
    return sql.unionByName(joined.where(valid(F.col("target")))).unionByName(viewed).distinct()


def pandas_edges(files: DataFrame) -> DataFrame:
    """(path, source, target): every table read by read_sql into every table written by to_sql of a file."""
    b = F.col("body")
    reads = F.array_distinct(F.transform(F.flatten(F.array(every(b, r"read_sql(?:_table)?\(\s*['\"](\w+)['\"]", 1), every(b, rf"(?is)read_sql(?:_query)?\(\s*[frub]*['\"]+[^'\"]*?\bFROM\s+{_NAME}", 1))), F.lower))
    writes = F.array_distinct(F.transform(every(b, r"\.to_sql\(\s*(?:name\s*=\s*)?['\"](\w+)['\"]", 1), F.lower))
    return files.select("path", F.explode(reads).alias("source"), writes.alias("w")).select("path", "source", F.explode("w").alias("target")).where("source <> target and source <> 'select'").distinct()


def pandas_joins(files: DataFrame) -> DataFrame:
    """(path, left, right, key) of pd.merge(a, b, ...) and a.merge(b, ...): tables by the read that a variable was given last, else variables; key is on=, or left_on= with right_on=."""
    b = F.col("body")
    reads = rf"(?s)(\w+)\s*=\s*\w+\.read_(?:sql|sql_query|sql_table|table)\(\s*[frub]*[\"']+(?:[^\"']*?(?i:\bFROM)\s+)?{_NAME}"
    named = F.arrays_zip(every(b, reads, 1).alias("variable"), every(b, reads, 2).alias("name"))
    value = r"(\[[^\]]*\]|['\"][^'\"]*['\"])"
    key = rf"(?:[^()]*?\b(?:on|left_on)\s*=\s*{value})?(?:[^()]*?\bright_on\s*=\s*{value})?"
    merges = [rf"\b(?:pd|pandas)\.merge\(\s*(?:left\s*=\s*)?(\w+)\s*,\s*(?:right\s*=\s*)?(\w+){key}", rf"\b(?!pd\b|pandas\b)(\w+)\.merge\(\s*(?:right\s*=\s*)?(\w+){key}"]
    found = F.concat(*(F.arrays_zip(*(every(b, p, i).alias(c) for i, c in enumerate(("a", "b", "key", "other"), 1))) for p in merges))
    rows = files.select("path", named.alias("named"), F.explode(found).alias("x"))
    table = lambda v: F.lower(F.coalesce(F.try_element_at(F.filter("named", lambda n: n["variable"] == v), F.lit(-1))["name"], v))
    bare = lambda c: F.regexp_replace(c, r"[\[\]'\"\s]", "")
    keys = F.when(F.col("x.other") != "", F.concat(bare("x.key"), F.lit("="), bare("x.other"))).otherwise(bare("x.key"))
    out = rows.select("path", table(F.col("x.a")).alias("left"), table(F.col("x.b")).alias("right"), keys.alias("key"))
    return out.where(valid(F.col("left")) & valid(F.col("right")) & (F.col("left") != F.col("right"))).distinct()


def orm_edges(files: DataFrame) -> DataFrame:
    """(path, left, right) of query(A).join(B), by the table names of the classes where a file gives them."""
    b = F.col("body")
    names = F.map_from_entries(F.array_distinct(F.transform(F.arrays_zip(every(b, r"(?s)class\s+(\w+)\([^)]*\):(?:(?!class\s).)*?__tablename__\s*=\s*['\"](\w+)['\"]", 1), every(b, r"(?s)class\s+(\w+)\([^)]*\):(?:(?!class\s).)*?__tablename__\s*=\s*['\"](\w+)['\"]", 2)), lambda x: F.struct(x["0"], x["1"]))))
    pairs = F.arrays_zip(every(b, r"query\(\s*(\w+)[^)]*\)\s*\.join\(\s*(\w+)", 1), every(b, r"query\(\s*(\w+)[^)]*\)\s*\.join\(\s*(\w+)", 2))
    rows = files.select("path", names.alias("m"), F.explode(pairs).alias("x"))
    named = lambda c: F.coalesce(F.try_element_at("m", c), F.lower(c))
    return rows.select("path", named(F.col("x")["0"]).alias("left"), named(F.col("x")["1"]).alias("right")).distinct()


def dbt_edges(files: DataFrame) -> DataFrame:
    """(path, source, target): a model depends on what it refers to, and on the items of depends_on; it is named by its file, or by the
    `- name:` above depends_on."""
    file = F.regexp_extract("path", r"([^/]+)\.\w+$", 1)
    refs = files.select("path", F.explode(F.concat(every(F.col("body"), REFERENCES[2], 1), every(F.col("body"), REFERENCES[3], 1))).alias("source"), file.alias("target"))
    parts = F.split("body", r"(?m)^\s*-\s+name\s*:\s*")
    cut = files.select("path", file.alias("file"), F.posexplode(parts).alias("at", "part"))
    block = F.regexp_extract("part", r"(?m)^\s*depends_on\s*:[ \t]*(\[[^\]]*\]|(?:\r?\n[ \t]*-[^\n]*)+)", 1)
    items = F.split(F.regexp_replace(block, r"^\[|\]$", ""), r"\n\s*-|,(?![^(]*\))")
    # of ref('x'), source('s', 'x') and a.b.x the last name counts
    last = lambda x: F.element_at(F.regexp_extract_all(x, F.lit(r"(\w+)"), F.lit(1)), -1)
    model = F.when(F.col("at") > 0, F.regexp_extract("part", r"^['\"]?(\w+)", 1)).otherwise(F.col("file"))
    listed = cut.where(block != "").select("path", F.explode(F.filter(items, lambda x: x.rlike(r"\w"))).alias("item"), model.alias("target")).select("path", last(F.col("item")).alias("source"), "target")
    return refs.unionByName(listed).where(valid(F.col("source")) & (F.col("source") != F.col("target"))).distinct()


def all_edges(files: DataFrame) -> DataFrame:
    """Lineage of each file by its extension, each pair once."""
    ext = F.lower(F.regexp_extract("path", r"(\.\w+)$", 1))
    typed = files.withColumn("ext", ext)
    sql, python, other = typed.where(F.col("ext").isin(".sql", ".hql")), typed.where("ext = '.py'"), typed.where(~F.col("ext").isin(".sql", ".hql", ".py"))
    out = lineage(sql).unionByName(lineage(embedded(python))).unionByName(pandas_edges(python)).unionByName(lineage(embedded(other))).unionByName(dbt_edges(typed.where(F.col("ext").isin(".sql", ".yml", ".yaml"))))
    return out.dropDuplicates(["path", "source", "target"])


def edge_triples(edges: DataFrame) -> DataFrame:
    """(s, p, o) of numbered lineage assertions and of target transformsFrom source; the layer is the target's prefix, else DWD."""
    pairs = edges.select("source", "target").distinct()
    layer = F.upper(F.regexp_extract("target", r"^(ods|dwd|dws|ads|dm)_", 1))
    name = F.concat(F.lit("lineage/"), F.substring(F.sha2(F.concat_ws(">", "source", "target"), 256), 1, 16))
    made = F.array(*(F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o")) for s, p, o in ((F.concat(F.lit("table/"), "target"), "transformsFrom", F.concat(F.lit("table/"), "source")), (name, "sourceTable", F.col("source")), (name, "targetTable", F.col("target")), (name, "layer", F.when(layer == "", "DWD").otherwise(layer)))))
    return pairs.select(F.explode(made).alias("x")).select("x.*")


def select_entries(files: DataFrame, skip: tuple[str, ...], most: int) -> DataFrame:
    """Files without skipped extensions, SQL first, then Python and YAML, then by path."""
    ext = F.lower(F.regexp_extract("path", r"(\.\w+)$", 1))
    first = F.when(ext == ".sql", 0).when(ext == ".hql", 1).when(ext == ".py", 2).when(ext.isin(".yml", ".yaml"), 3).otherwise(4)
    return files.where(~ext.isin(*skip)).select("path", first.alias("priority")).orderBy("priority", "path").limit(most)


def _terms(frames):
    for f in frames:
        rows = []
        for path, body in zip(f["path"], f["body"], strict=True):
            try:
                nodes = ast.walk(ast.parse(body or ""))
            except (SyntaxError, ValueError):
                continue
            for node in nodes:
                if not isinstance(node, ast.ClassDef):
                    continue
                bases = {ast.unparse(b).split(".")[-1] for b in node.bases}
                marks = {ast.unparse(d).split("(")[0].split(".")[-1] for d in node.decorator_list}
                kind = "enum" if any(b.endswith("Enum") for b in bases) else "dataclass" if "dataclass" in marks else None
                if kind:
                    fields = [t.id for x in node.body if isinstance(x, ast.Assign) for t in x.targets if isinstance(t, ast.Name)] + [x.target.id for x in node.body if isinstance(x, ast.AnnAssign) and isinstance(x.target, ast.Name)]
                    label = (ast.get_docstring(node) or node.name).split("\n")[0]
                    rows.append((path, kind, node.name, label, fields))
        yield pd.DataFrame(rows, columns=["path", "kind", "name", "label", "fields"])


def code_terms(files: DataFrame) -> DataFrame:
    """Enums and dataclasses of Python files with label and fields; files that don't parse give none."""
    return files.select("path", "body").mapInPandas(_terms, "path string, kind string, name string, label string, fields array<string>")


def diagnostics(files: DataFrame, short: int = 20) -> DataFrame:
    """Files and findings by extension."""
    ext = F.lower(F.regexp_extract("path", r"(\.\w+)$", 1)).alias("ext")
    counts = files.groupBy(ext).agg(F.count("*").alias("files"), F.count_if(F.length("body") < short).alias("short"))
    hits = all_edges(files).groupBy(ext).agg(F.count("*").alias("edges"))
    return counts.join(hits, "ext", "left").fillna(0, ["edges"])


# logged questions and statements

#: Cues of each pattern, fixed values.
PATTERNS = {
    "comparison": ("环比", "同比", "对比", "比较", "变化", "增长", "下降", "增减", "上升", "下跌", "提高", "降低", "变动", "变化率", "vs", "相比", "之差", "差值", "差异"),
    "ranking": ("排名", "top", "前", "最高", "最低", "最大", "最小", "前10", "前5", "哪个最", "谁最"),
    "trend": ("趋势", "走势", "变化趋势", "逐月", "逐日", "走向", "波动"),
    "aggregation": ("汇总", "合计", "总计", "求和", "平均值", "平均"),
    "proportion": ("占比", "比例", "百分比", "份额", "贡献", "构成"),
}
#: The same in English.
ENGLISH = {"comparison": ("compare", "versus"), "ranking": ("highest", "lowest", "rank"), "trend": ("trend", "over time"), "aggregation": ("total", "average", "sum of"), "proportion": ("share", "percent")}
#: What an identifier looks like, a fixed value.
IDENTIFIER = r"\b([A-Za-z]{1,4}[-_]?\d{3,})\b|\b(\d{6,})\b"
#: Family names that a person's name begins with, fixed values.
SURNAMES = "王李张刘陈杨黄赵周吴徐孙马胡朱郭何罗高林郑梁谢唐许冯宋韩邓彭曹曾田萧潘袁蔡蒋余于杜叶程魏苏吕丁任卢姚钟姜崔谭陆范汪廖石金韦贾夏付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤温康施沈洪章阮颜樊齐易乔文严关纪包鲁董成倪崔"
#: Words of business that are no values, fixed values.
NO_VALUE = ("用电", "售电", "电量", "电费", "销售", "金额", "业绩", "利润", "环比", "同比", "对比", "比较", "变化", "增长", "下降", "增减", "多少", "怎样", "如何", "查询", "统计", "分析", "汇总", "合计", "平均", "最大", "最小", "排名", "趋势", "占比", "比例", "份额", "最近", "本月", "上月", "本年", "去年", "今天", "昨天", "本周", "上周", "这个", "哪个", "哪些", "什么", "请问", "帮我", "我想", "显示", "列出", "找出", "筛选", "导出")
#: Words that no person's name holds, fixed values.
NO_PERSON = ("环比", "同比", "用电", "售电", "销售", "查询", "统计")
#: Ends of the names of places, fixed values.
PLACES = "省|市|区|县|镇|村|街道|路|园区|基地|工厂|门店|分公司"


def question_patterns(q: Column) -> Column:
    """All patterns that a question's words call for, in order."""
    low = F.lower(q)
    holds = lambda words: low.rlike("|".join(words))
    return F.array_compact(F.array(*(F.when(holds(PATTERNS[p] + ENGLISH[p]), p) for p in PATTERNS)))


def question_pattern(q: Column) -> Column:
    """The first pattern that a question's words call for, null if none."""
    return F.get(question_patterns(q), 0)


def question_intent(q: Column) -> Column:
    low = F.lower(F.trim(q))
    return F.when(low == "", "empty").when(low.rlike("delete|drop|truncate|删除|清空"), "guarded").when(low.rlike("how many|多少|统计|sum|count|average|top|list|查询"), "sql_query").otherwise("general_qa")


def question_values(q: Column) -> Column:
    """Quoted values, identifiers such as AB-123, long numbers, names of persons and places, each once in order."""
    quoted = every(q, "[\"'“‘「『]([^\"'”’」』]{2,40})[\"'”’」』]", 1)
    ids = every(q, IDENTIFIER, 0)
    words = F.filter(every(q, "[\\u4e00-\\u9fff]{2,4}", 0), lambda w: ~w.isin(*NO_VALUE))
    named = F.filter(words, lambda w: (w.rlike(f"^[{SURNAMES}]") & ~w.rlike("|".join(NO_PERSON))) | w.rlike(f"(?:{PLACES})$"))
    return F.array_sort(F.array_distinct(F.concat(quoted, ids, named)))


def question_range(q: Column, as_of: str) -> Column:
    """struct(first, last, compare): the days a question speaks of, relative to a date; null first if it names none.

    A whole date comes before a month of a year, this before counted days and months, named spans, and months without
    a year, which lie in the year that the question names, or in that of the date. Of several months the first and the
    last bound the span. Months that are counted end with the date's month; spans that run on end with their last day.
    """
    day = F.lit(as_of).cast("date")
    month, week, year, quarter = (F.trunc(day, unit) for unit in ("month", "week", "year", "quarter"))
    number = lambda pattern: F.regexp_extract(q, pattern, 1).try_cast("int")
    back = "(?:last|past|最近|近|过去)"
    days, weeks, months = (number(rf"(?i){back}\s*(\d+)\s*{unit}") for unit in ("(?:days?|天|日)", "(?:weeks?|个?周)", "(?:months?|个?月)"))
    dates = F.transform(every(q, r"(\d{4}[-./]\d{1,2}[-./]\d{1,2}|\d{4}年\d{1,2}月\d{1,2}日)", 1), lambda x: F.try_to_date(F.rtrim(F.regexp_replace(x, "[^0-9]+", "-"), F.lit("-")), "y-M-d"))
    firsts = F.transform(every(q, r"(\d{4}\s*[-./年]\s*\d{1,2})(?!\d|\s*[-./月]\d)", 1), lambda x: F.try_to_date(F.concat(F.regexp_replace(x, "[^0-9]+", "-"), F.lit("-1")), "y-M-d"))
    dates, firsts = (F.array_sort(F.array_compact(x)) for x in (dates, firsts))
    named_year = F.coalesce(number(r"(\d{4})\s*年"), F.year(day) + F.when(q.rlike("(?i)last year|去年"), -1).when(q.rlike("(?i)next year|明年"), 1).otherwise(0))
    bare = F.array_sort(F.array_compact(F.transform(every(q, r"(?<![\d个])(\d{1,2})\s*月", 1), lambda x: F.try_to_date(F.concat_ws("-", named_year, x, F.lit("1")), "y-M-d"))))
    bare = F.when(months.isNull(), bare).otherwise(F.slice(bare, 1, 0))
    end = lambda a: F.get(a, F.size(a) - 1)
    before = lambda d, n: F.add_months(d, -n)
    spans = [
        (F.size(dates) > 0, F.get(dates, 0), end(dates)),
        (F.size(firsts) > 0, F.get(firsts, 0), F.last_day(end(firsts))),
        (days.isNotNull(), F.date_sub(day, days), day),
        (weeks.isNotNull(), F.date_sub(day, 7 * weeks), day),
        (months.isNotNull(), before(month, months), F.last_day(day)),
        (F.size(bare) > 0, F.get(bare, 0), F.last_day(end(bare))),
        (q.rlike("(?i)last month|上月|上个月"), before(month, 1), F.date_sub(month, 1)),
        (q.rlike("(?i)this month|本月"), month, F.last_day(day)),
        (q.rlike("(?i)last week|上周"), F.date_sub(week, 7), F.date_sub(week, 1)),
        (q.rlike("(?i)this week|本周"), week, F.date_add(week, 6)),
        (q.rlike("(?i)last quarter|上季度|上个季度"), before(quarter, 3), F.date_sub(quarter, 1)),
        (q.rlike("(?i)this quarter|本季度"), quarter, F.date_sub(F.add_months(quarter, 3), 1)),
        (q.rlike("(?i)last year|去年"), before(year, 12), F.date_sub(year, 1)),
        (q.rlike("(?i)this year|今年"), year, F.date_sub(F.add_months(year, 12), 1)),
    ]
    # two months that follow one another are compared
    next_to = F.coalesce((F.size(bare) == 2) & (F.months_between(F.get(bare, 1), F.get(bare, 0)) == 1), F.lit(False))
    first = last = None
    for when, a, b in spans:
        first = F.when(when, a) if first is None else first.when(when, a)
        last = F.when(when, b) if last is None else last.when(when, b)
    return F.struct(first.cast("string").alias("first"), last.cast("string").alias("last"), (q.rlike("(?i)compare|环比|同比|对比|versus") | next_to | (F.size(firsts) == 2)).alias("compare"))


def audit(statements: DataFrame, most_joins: int = 16) -> DataFrame:
    """Per statement: verdict, joins and tables; comments and strings are taken out first. An approximation of parsing."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("sql", r"(?s)/\*.*?\*/", " "), r"--[^\n]*", " "), r"'(?:[^']|'')*'", "''")
    text = F.btrim(F.regexp_replace(F.regexp_replace(bare, r"(?i)^\s*```(?:sql)?|```\s*$", ""), r"[;\s]+$", ""), F.lit(" \t\r\n"))
    told = statements.withColumn("__t", text)
    t = F.col("__t")
    n = F.size(every(t, r"(?i)\bJOIN\b", 0))
    verdict = F.when(t == "", "empty").when(F.contains(t, F.lit(";")), "multiple").when(t.rlike(r"(?i)\b(INSERT|UPDATE|DELETE|DROP|ALTER|TRUNCATE|CREATE|GRANT|MERGE)\b"), "write").when(~t.rlike(r"(?i)^(SELECT|WITH|SHOW|DESC|DESCRIBE|EXPLAIN)\b"), "not_allowed").when(n > most_joins, "too_many_joins").otherwise("ok")
    ctes = F.transform(every(t, r"(?i)(?:\bWITH|,)\s+(\w+)\s+AS\s*\(", 1), F.lower)
    tables = F.array_sort(F.array_except(F.array_distinct(F.transform(every(t, rf"(?i)\b(?:FROM|JOIN)\s+{_NAME}", 1), F.lower)), ctes))
    return told.select(*statements.columns, verdict.alias("verdict"), n.alias("joins"), tables.alias("tables"))
