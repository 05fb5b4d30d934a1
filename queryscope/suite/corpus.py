"""Token facts, sources, findings, fixes, comparison and catalog checks on logs made of the given tables."""

from pyspark.sql import functions as F

from queryscope.functions import scalars as S
from queryscope.functions.text import TAGGED_DOLLARS, canonical_sql, strip_jinja, token_rx
from queryscope.functions.words import DIALECTS, FIXABLE, SEVERITY_WEIGHT, TITLES
from queryscope.operators import compare as C, findings as FI, fixes as X, lineage as L, rules as R, usage as U
from queryscope.operators.results import full_results
from queryscope.plans import tokens as T
from queryscope.plans.fixtures import query_log
from queryscope.sources import catalog as K, corpus as SRC, reports as RP
from queryscope.streaming.service import scratch
from queryscope.suite.registry import query
from queryscope.suite.sqltext import lit, log_sql, values_sql

# ---- tokens and facts -------------------------------------------------------

_JINJA = [
    ("SELECT * FROM {{ ref('orders') }} WHERE x = {n}", "SELECT * FROM dbt_ref__orders WHERE x = {n}"),
    ("SELECT {{ var('a') }} FROM {{ source('raw', 'ev') }} {# note #}WHERE k = {n}", "SELECT 'DBT_VAR' FROM dbt_src__raw_ev WHERE k = {n}"),
    ("{% if x %}SELECT {{ cols }} FROM t{% endif %} WHERE k = {n}", "SELECT dbt_expr FROM t WHERE k = {n}"),
    ("SELECT a FROM {{\nref('p', 'm') }} WHERE k = {n}", "SELECT a FROM dbt_ref__p_m\n WHERE k = {n}"),
]


@query("t01_strip_jinja", f"SELECT query_id, sql FROM {log_sql([b for _, b in _JINJA])}")
def _(t):
    return query_log(t.orders, [a for a, _ in _JINJA]).select("query_id", strip_jinja(F.col("sql")).alias("sql"))


_RX = {d: token_rx(d, possessive=False).replace("'", "''") for d in DIALECTS}
#: what the dialects read differently, put before each text
_MARKS = "# it's $$a'b$$ 'c\\\\' 1e5 0x1F @v $1 ${x} a == b 'd''e' r'f\\\\' E'g\\\\'h' q'[i's]' $t$ it's $$ $t$ "


def _plain(dialect: str) -> str:
    """The marks for an engine without back-references: a tagged quote becomes a plain one."""
    return _MARKS.replace("$t$ it's $$ $t$", "'its'") if dialect in TAGGED_DOLLARS else _MARKS


@query(
    "t02_tokens",
    " UNION ALL ".join(
        f"""SELECT doc_id AS query_id, '{d}' AS dialect, CAST(len(regexp_extract_all({lit(_plain(d))} || chr(10) || text, '{_RX[d]}')) AS BIGINT) AS tokens FROM documents WHERE doc_id % {len(DIALECTS)} = {i}"""
        for i, d in enumerate(DIALECTS)
    ),
)
def _(t):
    names = F.array(*[F.lit(d) for d in DIALECTS])
    docs = t.documents.select(
        F.col("doc_id").alias("tid"),
        F.concat(F.lit(_MARKS + "\n"), F.col("text")).alias("sql"),
        F.get(names, F.pmod("doc_id", F.lit(len(DIALECTS))).cast("int")).alias("dialect"),
    )
    return T.token_table(docs.repartition("tid")).groupBy(F.col("tid").alias("query_id"), "dialect").agg(F.count("*").alias("tokens"))


_NEST = [
    "SELECT a, (SELECT MAX(b) FROM s WHERE s.k = (t.k + {n})) AS m FROM t",
    "WITH x AS (SELECT a FROM t) SELECT a FROM x WHERE a IN (SELECT b FROM u WHERE c IN (1, {n})) UNION ALL SELECT d FROM v",
    "SELECT a.x, EXTRACT(YEAR FROM d) AS y FROM a LEFT JOIN b bb ON a.id = bb.id AND bb.q BETWEEN 1 AND {n} WHERE a.p > 1 AND (b.x IS NULL OR b.y = 2) ORDER BY 1 DESC, y LIMIT 5",
    "UPDATE t SET a = {n} WHERE b = 2; SELECT CASE WHEN a = 1 THEN CASE WHEN b THEN 2 END ELSE 3 END FROM t",
]


def _keyed(t, templates, dialect="bigquery"):
    keyed = T.normalise_log(query_log(t.orders, templates, dialect))
    return keyed.select("query_id", "tid"), T.distinct_texts(keyed)


def _facts(name, expected, cols, build, only=None, tokens=lambda texts, only: T.scoped_tokens(texts, only)):
    @query(name, values_sql([(i, *r) for i, rows in enumerate(expected) for r in rows], cols, len(expected)))
    def _(t):
        ids, texts = _keyed(t, _NEST)
        return ids.join(build(tokens(texts, only)), "tid").select("query_id", *cols)


def _whole(texts, only):
    return T.whole(texts)


_one = lambda *v: [tuple(v)]
_facts(
    "t03_depth_frames",
    [_one(2, 3), _one(2, 3), _one(1, 2), _one(0, 0)],
    ["max_depth", "frames"],
    lambda k: k.groupBy("tid").agg(F.max("depth").cast("int").alias("max_depth"), F.expr("CAST(count(DISTINCT CASE WHEN depth > 0 THEN frame END) AS INT) AS frames")),
    ["depth", "frame"],
)
_facts(
    "t04_scopes",
    [[(0, 2)], [(0, 4)], [(0, 1)], [(0, 0), (1, 1)]],
    ["stmt", "selects"],
    lambda k: k.groupBy("tid", F.col("stmt").cast("int").alias("stmt")).agg(F.expr("CAST(count_if(ckw = 'SELECT') AS INT) AS selects")),
    ["stmt", "ckw"],
)
_facts(
    "t05_clauses",
    [
        _one("SELECT,FROM"), _one("WITH,SELECT,FROM,WHERE,SETOP,SELECT,FROM"),
        _one("SELECT,FROM,JOIN,ON,WHERE,ORDER,LIMIT"), _one("UPDATE,SET,WHERE,SELECT,FROM"),
    ],
    ["clauses"],
    lambda k: k.where("scope < 0 AND ckw IS NOT NULL").groupBy("tid").agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(pos, ckw))), x -> x.ckw), ',') AS clauses")
    ),
    ["pos", "scope", "ckw"],
)
_facts(
    "t06_selects",
    [_one(2, 1, 0, 0), _one(4, 2, 0, 0), _one(1, 1, 1, 1), _one(1, 0, 0, 0)],
    ["arms", "with_where", "with_order", "with_limit"],
    lambda k: _per_text(T.statements(k, (), ["sels"]), [
        f"size({R.SELECTS}) AS arms", *[f"size(filter({R.SELECTS}, s -> {R._has('s', c)})) AS {n}" for c, n in (("WHERE", "with_where"), ("ORDER", "with_order"), ("LIMIT", "with_limit"))],
    ], ["arms", "with_where", "with_order", "with_limit"]),
    tokens=_whole,
)


def _per_text(st, exprs, names):
    d = st.selectExpr("tid", *exprs)
    return d.groupBy("tid").agg(*[F.sum(n).cast("int").alias(n) for n in names])


_facts(
    "t07_items",
    [_one("a|m"), _one("a|a|b|d"), _one("a . x|y"), _one("-")],
    ["items"],
    lambda k: T.segments(k).where("clause = 'SELECT'").groupBy("tid").agg(
        F.expr("array_join(transform(array_sort(collect_list(CASE WHEN alias IS NOT NULL OR bare THEN struct(s, coalesce(alias, txt) AS x) END)), x -> x.x), '|') AS i")
    ).selectExpr("tid", "if(i = '', '-', i) AS items"),
)
_facts(
    "t08_sources",
    [
        [("s", "s", "FROM"), ("t", "t", "FROM")],
        [("t", "t", "FROM"), ("x", "x", "FROM"), ("u", "u", "FROM"), ("v", "v", "FROM")],
        [("a", "a", "FROM"), ("b", "bb", "JOIN")],
        [("t", "t", "UPDATE"), ("t", "t", "FROM")],
    ],
    ["table_name", "alias", "via"],
    lambda k: T.statements(k).selectExpr("tid", "inline(tabs)").selectExpr("tid", "name AS table_name", "alias", "clause AS via"),
)
_facts(
    "t09_columns",
    [
        _one("a,b,s.k,t.k"), _one("a,a,a,b,c,d"), _one("a.id,a.p,a.x,b.x,b.y,bb.id,bb.q,d,y"), _one("a,a,b,b"),
    ],
    ["columns"],
    lambda k: k.where("is_col").groupBy("tid").agg(F.expr("array_join(array_sort(collect_list(concat_ws('.', qual, name))), ',') AS columns")),
)
_facts(
    "t10_conditions",
    [
        [("WHERE", "s . k = ( t . k + # )")],
        [("WHERE", "a IN ( )"), ("WHERE", "c IN ( 1 , # )")],
        [("ON", "a . id = bb . id"), ("ON", "bb . q BETWEEN 1 AND #"), ("WHERE", "a . p > 1"), ("WHERE", "( b . x IS NULL OR b . y = 2 )")],
        [("WHERE", "b = 2")],
    ],
    ["clause", "cond"],
    lambda k: T.segments(k).where("clause IN ('WHERE', 'ON', 'HAVING')").selectExpr("tid", "clause", r"regexp_replace(txt, r'\b(?!1\b|2\b)\d+\b|(?<=AND )[12]\b$|(?<=, )[12](?= \))|(?<=\+ )[12]\b', '#') AS cond"),
)
_facts(
    "t11_ctes",
    [[], _one("x", True), [], []],
    ["cte", "used"],
    lambda k: T.statements(k, (), ["ctes", "tabs"]).selectExpr("tid", "tabs", "explode(ctes) AS cte").selectExpr("tid", "cte", "exists(tabs, t -> lower(t.name) = cte) AS used"),
    tokens=_whole,
)
_facts(
    "t12_case_spans",
    [[], [], [], [(False,), (True,)]],
    ["has_else"],
    lambda k: X.case_spans(k).select("tid", "has_else"),
)

_MESSY = ['SELECT  a AS "x",\n  `b` FROM "t" WHERE k = {n} ;', "select a, b from t where k = {n}", "SELECT a,\tb\nFROM t  WHERE k = {n};;"]


@query(
    "t13_canonical_sql",
    f"""SELECT canon, count(*) AS queries FROM (SELECT lower(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(sql,
 '(?i)\\s+AS\\s+"[^"]*"', '', 'g'), '["`]', '', 'g'), '\\s+', ' ', 'g')), ';+$', '')) AS canon FROM {log_sql(_MESSY)}) GROUP BY 1""",
)
def _(t):
    return query_log(t.orders, _MESSY).groupBy(canonical_sql(F.col("sql")).alias("canon")).agg(F.count("*").alias("queries"))


# ---- sources and sinks ------------------------------------------------------


@query("s01_read_sql_files", "SELECT s_suppkey AS file_key, 'SELECT * FROM s' || s_suppkey AS sql FROM supplier")
def _(t):
    folder = scratch(t.spark, "sql")
    body = F.concat(F.lit("SELECT * FROM s"), F.col("s_suppkey").cast("string"))
    # a folder per supplier: many tasks write them, and each task moves its own into place
    rows = t.supplier.select("s_suppkey", body.alias("value")).repartition("s_suppkey")
    rows.write.partitionBy("s_suppkey").option("lineSep", "\n").option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(folder)
    d = SRC.read_sql_files(t.spark, [folder])
    return d.select(F.regexp_extract("path", r"s_suppkey=(\d+)/", 1).cast("bigint").alias("file_key"), F.trim("sql", F.lit("\n ")).alias("sql"))


_GLOBS = ["**/fr/*", "de/**", "en/1?"]
_PATH = r"regexp_extract(url, '^[a-z]+://[^/]*/([^?#]*)', 1)"


@query(
    "s02_filter_paths",
    f"SELECT page_id FROM pages WHERE regexp_matches({_PATH}, '^(?:.*/)?fr/[^/]*$') OR regexp_matches({_PATH}, '^de/.*$') OR regexp_matches({_PATH}, '^en/1[^/]$')",
)
def _(t):
    p = t.pages.select("page_id", F.regexp_extract("url", r"^[a-z]+://[^/]*/([^?#]*)", 1).alias("path"))
    return SRC.filter_paths(p, _GLOBS).select("page_id")


_DOC_PATH = "concat(lang, '/', source, '/', CAST(doc_id AS {}), '.sql')"


@query(
    "s03_select_changed",
    f"SELECT path FROM (SELECT doc_id, {_DOC_PATH.format('VARCHAR')} AS path FROM documents) WHERE doc_id % 5 <> 0 AND doc_id % 2 = 0 AND path LIKE 'en/%'",
)
def _(t):
    d = t.documents.selectExpr("doc_id", f"{_DOC_PATH.format('STRING')} AS path", "text AS sql")
    manifest = d.where("doc_id % 2 = 0").selectExpr("path", "CASE WHEN doc_id % 5 = 0 THEN 'removed' ELSE 'modified' END AS status")
    return SRC.select_changed(manifest, d, ["en/**/*.sql"]).select("path")


_NATION_JSON = """SELECT n_name AS table_name, c_mktsegment AS column_name, row_number() OVER (PARTITION BY n_name ORDER BY c_mktsegment) AS ordinal
 FROM (SELECT DISTINCT n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def _nation_catalog(t):
    segs = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "n_name").agg(
        F.array_sort(F.collect_set("c_mktsegment")).alias("cols")
    )
    js = segs.select("n_regionkey", F.to_json(F.create_map("n_name", "cols")).alias("js"))
    return K.catalog_from_json(js, "js").withColumn("ordinal", F.col("ordinal").cast("bigint"))


@query("s04_catalog_json", _NATION_JSON)
def _(t):
    return _nation_catalog(t)


_DDL = [
    "CREATE TABLE a{n} (id INT, amt DECIMAL(10,2), CONSTRAINT pk PRIMARY KEY (id)); CREATE TABLE BROKEN SYNTAX HERE (((; CREATE TABLE IF NOT EXISTS db.b{n} (x INT)",
    "CREATE VIEW v{n} AS SELECT 1; CREATE TABLE c{n} AS SELECT 1",
    "CREATE TABLE `d{n}` (k STRING, v ARRAY<INT>, PRIMARY KEY (k))",
]


@query(
    "s05_catalog_ddl",
    "SELECT query_id AS ddl_id, tab || (SELECT o_custkey FROM orders WHERE o_orderkey = query_id) AS table_name, columns, skipped FROM ("
    + values_sql([(0, "a", "id,amt", 1), (0, "b", "x", 1), (1, None, None, 2), (2, "d", "k,v", 0)], ["tab", "columns", "skipped"], 3, {"skipped": "BIGINT"})
    + ")",
)
def _(t):
    ddl = query_log(t.orders, _DDL).select(F.col("query_id").alias("ddl_id"), "sql")
    cat, skipped = K.catalog_from_ddl(ddl)
    cols = cat.groupBy("ddl_id", "table_name").agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(ordinal, column_name))), x -> x.column_name), ',') AS columns")
    )
    return skipped.join(cols, "ddl_id", "left").select("ddl_id", "table_name", "columns", "skipped")


@query(
    "s06_merge_catalogs",
    f"""WITH d AS ({_NATION_JSON}) SELECT table_name, column_name, ordinal FROM d WHERE table_name NOT IN (SELECT n_name FROM nation WHERE n_nationkey % 3 = 0)
 UNION ALL SELECT n_name, 'explicit_' || n_nationkey, CAST(1 AS BIGINT) FROM nation WHERE n_nationkey % 3 = 0""",
)
def _(t):
    explicit = t.nation.where("n_nationkey % 3 = 0").selectExpr("n_name AS table_name", "concat('explicit_', n_nationkey) AS column_name", "1L AS ordinal")
    return K.merge_catalogs(explicit, _nation_catalog(t))


@query(
    "s07_guards",
    f"""SELECT 'catalog' AS guard, CASE WHEN count(DISTINCT table_name) <= 200 AND count(*) <= 5000 THEN 'accepted' ELSE 'refused' END AS outcome, count(*) AS n FROM ({_NATION_JSON})
 UNION ALL SELECT 'customers as tables', CASE WHEN count(*) <= 200 THEN 'accepted' ELSE 'refused' END, count(*) FROM customer
 UNION ALL SELECT 'text', CASE WHEN trim(text) = '' THEN 'empty' WHEN length(text) > 100000 THEN 'too long' ELSE 'accepted' END, count(*) FROM documents GROUP BY 2""",
)
def _(t):
    state = F.when(F.col("accepted"), "accepted").otherwise("refused").alias("outcome")
    shape = lambda d, n: K.catalog_size(d).select(F.lit(n).alias("guard"), state, F.col("columns").alias("n"))
    wide = t.customer.selectExpr("c_name AS table_name", "'c' AS column_name")
    texts = t.documents.select(T.size_class(F.col("text")).alias("outcome"))
    texts = texts.groupBy(F.lit("text").alias("guard"), "outcome").agg(F.count("*").alias("n"))
    return shape(_nation_catalog(t), "catalog").unionByName(shape(wide, "customers as tables")).unionByName(texts)


#: text, complete finding titles, suppressed titles
_FULL = [
    ("SELECT id, total FROM orders WHERE id = {n}", [], []),
    ("SELECT * FROM orders o JOIN customers c WHERE c.name LIKE '%x{n}' LIMIT 10",
     ["JOIN without ON condition", "SELECT * used", "LIMIT without ORDER BY", "LIKE starts with %"], []),
    ("SELECT * FROM t WHERE k = {n} LIMIT 5 -- noqa: select * USED", ["LIMIT without ORDER BY"], ["SELECT * used"]),
    ("SELECT * FROM t WHERE x = NULL AND k = {n} /* NOQA */", [], ["`= NULL` never matches", "SELECT * used"]),
    ("SELECT * FROM t WHERE a = '-- noqa' AND k = {n}", ["SELECT * used"], []),
    ("SELCT a FROM t WHERE k = {n} -- noqa", None, None),
    ("DELETE FROM t{n}; UPDATE t{n} SET a = 1; SELECT a FROM x CROSS JOIN y CROSS JOIN z", ["DELETE without WHERE", "UPDATE without WHERE", "CROSS JOIN found", "Joined table never used", "Unqualified column with multiple tables joined"], []),
    ("SELECT a FROM t WHERE x <> NULL AND k = {n}", ["`!= NULL` never matches"], []),
    ("SELECT a.x FROM a JOIN b ON a.id = b.id WHERE a.k = {n} -- noqa: Joined tabel never used", ["Joined table never used"], []),
]
_SEV = {title: s for _, title, s in TITLES}


def _score(ts):
    return None if ts is None else max(0, 100 - sum(SEVERITY_WEIGHT[_SEV[x]] for x in ts))


def _results(t):
    return FI.lint_corpus(query_log(t.orders, [s for s, _, _ in _FULL]))


_NF = len(_FULL)
_rank = {"high": 2, "medium": 1, "low": 0}
_order = [title for _, title, _ in TITLES]


def _sorted(ts):
    return sorted(ts, key=lambda x: (-_rank[_SEV[x]], _order.index(x)))


@query("s08_write_results", values_sql([(i, ts is not None, _score(ts)) for i, (_, ts, _) in enumerate(_FULL)], ["valid", "score"], _NF))
def _(t):
    folder = scratch(t.spark, "results")
    SRC.write_results(_results(t).select("query_id", "valid", "score", "findings"), folder)
    return t.spark.read.schema("query_id long, valid boolean, score int").json(folder)


_REVIEW_SQL = values_sql([(i, ts is None, len(ts or [])) for i, (_, ts, _) in enumerate(_FULL)], ["bad", "n"], _NF)


@query(
    "s09_review_report",
    f"""WITH f AS (SELECT q.*, o_custkey AS review FROM ({_REVIEW_SQL}) q JOIN orders ON o_orderkey = query_id)
 SELECT review, 0 AS part, count(*) AS rows, CASE WHEN sum(n) = 0 AND count(*) FILTER (WHERE bad) = 0 THEN 'Nothing to report in ' || count(*) || ' reviewed file(s).'
 ELSE 'Files: ' || count(*) || ', unreadable: ' || count(*) FILTER (WHERE bad) || ', findings: ' || CAST(sum(n) AS BIGINT) || '.' END AS last_line FROM f GROUP BY 1
 UNION ALL SELECT review, 1, count(*), 'sections' FROM f WHERE bad OR n > 0 GROUP BY 1 UNION ALL SELECT review, 2, 1, 'footer' FROM f GROUP BY 1""",
)
def _(t):
    r = _results(t).withColumn("path", F.concat(F.col("query_id").cast("string"), F.lit(".sql"))).withColumnRenamed("author", "review")
    rep = RP.review_report(r, "review", "path")
    size = F.when(F.col("part") == 0, F.regexp_extract("body", r"(\d+)", 1).cast("bigint"))
    lines = rep.groupBy("review", "part").agg(
        F.coalesce(F.max(size), F.count("*")).alias("rows"),
        F.max(F.when(F.col("part") == 0, F.substring_index("body", "\n", -1)).when(F.col("part") == 1, "sections").otherwise("footer")).alias("last_line"),
    )
    return lines


@query(
    "s10_text_report",
    "SELECT query_id || '.sql' AS path, head FROM ("
    + values_sql([(i, "  SYNTAX ERROR (line 1): unknown statement" if ts is None else f"  score: {_score(ts)}/100") for i, (_, ts, _) in enumerate(_FULL)], ["head"], _NF) + ")",
)
def _(t):
    r = _results(t).withColumn("path", F.concat(F.col("query_id").cast("string"), F.lit(".sql")))
    return RP.text_report(r, "path").select("path", F.get(F.split("report", "\n"), F.lit(1)).alias("head"))


_FIX = [
    ("x01", "SELECT ship FROM ships WHERE flag = NULL AND dock = {n}", "SELECT ship FROM ships WHERE flag IS NULL AND dock = {n}", "`= NULL` never matches"),
    ("x01", "SELECT ship FROM ships WHERE NULL <> f(dock, {n})", "SELECT ship FROM ships WHERE f(dock, {n}) IS NOT NULL", "`!= NULL` never matches"),
    ("x01", "select  ship /*+ hint */ from ships -- all of them\nwhere rate=1e5 AND code = 0x1F and flag==NULL and dock = {n}",
     "select  ship /*+ hint */ from ships -- all of them\nwhere rate=1e5 AND code = 0x1F and flag IS NULL and dock = {n}", "`= NULL` never matches"),
    ("x01", "SELECT ship FROM ships WHERE a = @v AND b=$1 AND c = ${x} AND (NULL = flag) AND dock = {n}",
     "SELECT ship FROM ships WHERE a = @v AND b=$1 AND c = ${x} AND ( flag IS NULL) AND dock = {n}", "`= NULL` never matches"),
    ("x01", "SELECT ship FROM ships WHERE flag = NULL::int AND dock = {n}", None, None),
    ("x02", "SELECT DISTINCT dock, pilot FROM visits WHERE ship = {n} GROUP BY dock, pilot", "SELECT dock, pilot FROM visits WHERE ship = {n} GROUP BY dock, pilot", "Redundant DISTINCT with GROUP BY"),
    ("x02", "SELECT DISTINCT MAX(day) FROM visits WHERE ship = {n} GROUP BY dock", None, None),
    ("x03", "SELECT CASE WHEN tons = {n} THEN 'full' END AS c FROM ships", "SELECT CASE WHEN tons = {n} THEN 'full' ELSE NULL END AS c FROM ships", "CASE without ELSE"),
    ("x03", "SELECT ship,\n       CASE WHEN tons>{n} THEN 1e5 /* heavy */ END c\nFROM ships", "SELECT ship,\n       CASE WHEN tons>{n} THEN 1e5 /* heavy */ ELSE NULL END c\nFROM ships", "CASE without ELSE"),
    ("x04", "SELECT s.ship, (SELECT MAX(s.v.day) FROM visits v WHERE v.ship = s.ship) AS seen FROM ships s WHERE s.tons = {n}",
     "SELECT s.ship, (SELECT MAX(v.day) FROM visits v WHERE v.ship = s.ship) AS seen FROM ships s WHERE s.tons = {n}", "Table alias leaked into a column qualifier"),
    ("x05", "SELECT DISTINCT dock, CASE WHEN flag <> NULL THEN {n} END AS d FROM ships GROUP BY dock, d",
     "SELECT dock, CASE WHEN flag IS NOT NULL THEN {n} ELSE NULL END AS d FROM ships GROUP BY dock, d", "CASE without ELSE,Redundant DISTINCT with GROUP BY,`!= NULL` never matches"),
    ("x05", "SELECT ship FROM ships WHERE dock = {n}", None, None),
]


def _fixed_sql(pairs):
    """Original texts with a fix -> query_id, fixed_sql."""
    done = [(a, b) for a, b in pairs]
    texts = log_sql([b or "" for _, b in done])
    return f"SELECT query_id, sql AS fixed_sql FROM {texts} WHERE sql <> ''"


def _fix_query(name, which):
    pairs = [(a, b) for x, a, b, _ in _FIX if x == which] + [("SELECT a FROM t WHERE k = {n}", None)]

    @query(name, _fixed_sql(pairs))
    def _(t):
        ids, texts = _keyed(t, [a for a, _ in pairs])
        return ids.join(X.fix_texts(texts, (which,)), "tid").select("query_id", "fixed_sql")


_fix_query("x01_fix_null_compare", "x01")
_fix_query("x02_fix_distinct", "x02")
_fix_query("x03_fix_case_else", "x03")
_fix_query("x04_fix_leaked_alias", "x04")


@query(
    "x05_verified_fixes",
    values_sql([(i, tt) for i, (_, _, b, tt) in enumerate(_FIX) if b], ["titles"], len(_FIX)),
)
def _(t):
    d = X.apply_auto_fixes(query_log(t.orders, [a for _, a, _, _ in _FIX]))
    return d.select("query_id", F.array_join("fixed_titles", ",").alias("titles"))


@query("s11_write_fixed", _fixed_sql([(a, b) for x, a, b, _ in _FIX if x == "x03" and "\n" not in a] + [("SELECT a FROM t WHERE k = {n}", None)]))
def _(t):
    pairs = [a for x, a, _, _ in _FIX if x == "x03" and "\n" not in a] + ["SELECT a FROM t WHERE k = {n}"]
    ids, texts = _keyed(t, pairs)
    folder = scratch(t.spark, "fixed")
    done = ids.join(X.fix_texts(texts, ("x03",)), "tid").withColumn("bucket", F.col("query_id") % 8)
    SRC.write_fixed(done.withColumn("fixed_sql", F.concat_ws("\t", F.col("query_id").cast("string"), "fixed_sql")), folder, "bucket")
    back = t.spark.read.text(folder)
    return back.select(F.substring_index("value", "\t", 1).cast("bigint").alias("query_id"), F.substring_index("value", "\t", -1).alias("fixed_sql"))


#: the given tables and their columns
_LIVE_COLS = {
    t: cols.split()
    for t, cols in {
        "region": "r_regionkey r_name",
        "nation": "n_nationkey n_name n_regionkey",
        "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
        "supplier": "s_suppkey s_name s_nationkey s_acctbal",
        "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
        "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
        "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
        "events": "event_id ts user_id event_type value props",
        "documents": "doc_id text lang source n_chars",
        "embeddings": "vec_id embedding label",
        "pages": "page_id url html",
        "benchmark": "item_id text",
        "labels": "doc_id quality toxic",
        "conversations": "conv_id turn role text",
    }.items()
}


def _live(t):
    return {n: getattr(t, n) for n in _LIVE_COLS}


@query(
    "s12_live_catalog",
    " UNION ALL ".join(
        f"SELECT '{tb}' AS table_name, '{c}' AS column_name, {i} AS ordinal, count({c}) AS filled_rows FROM {tb}"
        for tb, cs in _LIVE_COLS.items() for i, c in enumerate(cs, 1)
    ),
)
def _(t):
    return K.catalog_profile(t.spark, _live(t))


# ---- findings ---------------------------------------------------------------


@query(
    "f01_dedupe_findings",
    """SELECT l_orderkey AS query_id, l_returnflag AS title, min(CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 10000 + l_suppkey) AS first_hit FROM lineitem GROUP BY 1, 2""",
)
def _(t):
    raw = t.lineitem.selectExpr(
        "l_orderkey AS query_id", "l_returnflag AS title", "l_linenumber AS rule_no", "l_partkey * 10000 + l_suppkey AS pos"
    )
    return FI.dedupe_findings(raw).selectExpr("query_id", "title", "rule_no * 1000000000L + pos AS first_hit")


@query("f02_noqa", values_sql([(i, ",".join(_order[k] for k in sorted(_order.index(x) for x in sup))) for i, (_, _, sup) in enumerate(_FULL) if sup is not None], ["suppressed"], _NF))
def _(t):
    return _results(t).where("valid").select("query_id", F.array_join("suppressed", ",").alias("suppressed"))


@query("f03_score", values_sql([(i, ts is not None, _score(ts)) for i, (_, ts, _) in enumerate(_FULL)], ["valid", "score"], _NF))
def _(t):
    return _results(t).select("query_id", "valid", "score")


_LONG = "SELECT '" + "x" * 100_001 + "' AS a, * FROM ships WHERE dock = {n}"


@query(
    "f03_score_any_length",
    """SELECT o_orderkey AS query_id, o_orderkey % 4 >= 2 AS valid, CASE WHEN o_orderkey % 400 = 2 THEN 88 WHEN o_orderkey % 4 = 2 THEN 100 WHEN o_orderkey % 4 = 3 THEN 76 END AS score,
 CASE WHEN o_orderkey % 4 < 2 THEN 'empty statement' END AS error FROM orders""",
)
def _(t):
    """Every order is a log row: empty, null, a short text without or with two findings, and now and then one of 100 000 characters."""
    n = F.col("o_orderkey")
    own = lambda text: F.replace(F.lit(text), F.lit("{n}"), F.col("o_custkey").cast("string"))
    sql = (
        F.when(n % 4 == 0, F.lit("")).when(n % 4 == 1, F.lit(None).cast("string")).when(n % 400 == 2, own(_LONG))
        .when(n % 4 == 2, own("SELECT tide FROM harbour WHERE berth = {n}")).otherwise(own("SELECT * FROM harbour WHERE berth = {n} LIMIT 3"))
    )
    log = t.orders.select(n.alias("query_id"), F.lit("bigquery").alias("dialect"), sql.alias("sql"))
    return FI.lint_corpus(log, ["SELECT * used", "LIMIT without ORDER BY"]).select("query_id", "valid", "score", "error")


@query("f04_ordered_findings", values_sql([(i, "|".join(_sorted(ts))) for i, (_, ts, _) in enumerate(_FULL) if ts is not None], ["titles"], _NF))
def _(t):
    return _results(t).where("valid").select("query_id", F.array_join(F.transform("findings", lambda x: x["title"]), "|").alias("titles"))


def _blocked(ts, threshold):
    if ts is None:
        return True
    return threshold != "never" and any(_rank[_SEV[x]] >= _rank[threshold] for x in ts)


@query("f05_gate", values_sql([(i, *[_blocked(ts, th) for th in ("never", "high", "medium", "low")]) for i, (_, ts, _) in enumerate(_FULL)], ["never", "high", "medium", "low"], _NF))
def _(t):
    r = _results(t)
    for th in ("never", "high", "medium", "low"):
        r = FI.gate(r, th).withColumnRenamed("blocked", th)
    return r.select("query_id", "never", "high", "medium", "low")


def _worst(ts):
    return -1 if not ts else max(_rank[_SEV[x]] for x in ts)


@query(
    "f06_review_totals",
    "SELECT o_custkey AS author, count(*) AS files, count(*) FILTER (WHERE bad) AS syntax_errors, CAST(sum(n) AS BIGINT) AS finding_count, "
    "CASE max(w) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' WHEN 0 THEN 'low' ELSE 'none' END AS worst FROM ("
    + values_sql([(i, ts is None, len(ts or []), _worst(ts)) for i, (_, ts, _) in enumerate(_FULL)], ["bad", "n", "w"], _NF)
    + ") JOIN orders ON o_orderkey = query_id GROUP BY 1",
)
def _(t):
    return FI.review_totals(_results(t), "author")


def _band(ts):
    s = _score(ts)
    return "bad" if s is None else "good" if s >= 80 else "mid" if s >= 50 else "bad"


@query("f07_score_band", values_sql([(i, _band(ts)) for i, (_, ts, _) in enumerate(_FULL)], ["band"], _NF))
def _(t):
    return FI.with_band(_results(t)).select("query_id", "band")


_HITS = values_sql([(i, x, _SEV[x]) for i, (_, ts, _) in enumerate(_FULL) for x in ts or []], ["title", "severity"], _NF)


@query(
    "f08_finding_rollup",
    f"SELECT severity, title, count(*) AS findings, CAST(grouping(severity) * 2 + grouping(title) AS BIGINT) AS grouping FROM ({_HITS}) GROUP BY ROLLUP (severity, title)",
)
def _(t):
    return FI.finding_rollup(_results(t), "severity", "title")


@query(
    "f08_finding_cube",
    f"SELECT severity, title, count(*) AS findings, CAST(grouping(severity) * 2 + grouping(title) AS BIGINT) AS grouping FROM ({_HITS}) GROUP BY CUBE (severity, title)",
)
def _(t):
    return FI.finding_cube(_results(t), "severity", "title").select("severity", "title", "findings", "grouping")


_VALID_N = sum(ts is not None for _, ts, _ in _FULL)


@query(
    "f08_title_shares",
    f"""SELECT title, severity, count(*) AS queries, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM orders WHERE o_orderkey % {_NF} <> 5), 4) AS share_pct FROM ({_HITS}) GROUP BY 1, 2""",
)
def _(t):
    return FI.title_shares(_results(t))


@query("f09_fixable", f"SELECT query_id, title FROM ({_HITS}) WHERE title IN ({', '.join(lit(x) for x in FIXABLE)})" .replace("SELECT query_id", "SELECT query_id", 1))
def _(t):
    return FI.fixable(_results(t), "query_id")


_WHOLE = [
    ("SELECT ship FROM ships WHERE flag = NULL AND dock = {n}", True, 70, None, "`= NULL` never matches", 2),
    ("SELECT ship FROM ships WHERE dock = {n}", True, 100, None, None, None),
    ("SELEC ship FROM ships WHERE dock = {n}", False, None, "No statement starts with 'SELEC'. The nearest keyword is SELECT.", None, None),
    ("SELECT MAX(tons FROM ships WHERE dock = {n}", False, None, "The text opens 1 and closes 0 parentheses; check for a lost closing one.", None, None),
]


@query(
    "f10_full_result",
    values_sql(
        [(i, *row) for i, (_, *row) in enumerate(_WHOLE)], ["valid", "score", "hint", "fixed", "changes"], len(_WHOLE),
        {"score": "INTEGER", "hint": "VARCHAR", "fixed": "VARCHAR", "changes": "INTEGER"},
    ),
)
def _(t):
    r = full_results(query_log(t.orders, [s for s, *_ in _WHOLE]))
    changes = F.when(F.col("fix_diff").isNotNull(), F.size("fix_diff")).cast("int").alias("changes")
    return r.select("query_id", "valid", "score", "hint", F.array_join("fixed_titles", ",").alias("fixed"), changes)


#: bits of the order key decide which clauses a text has; DuckDB derives the expected titles from the same bits
_BITS = {"star": 0, "like": 1, "null": 2, "order": 3, "limit": 4, "inner": 5, "case": 6, "lower": 7, "union": 8}


def _bit(name: str) -> str:
    return f"(o_orderkey // 7) % {2 << _BITS[name]} >= {1 << _BITS[name]}"


@query(
    "l00_composed_texts",
    " UNION ALL ".join(
        f"SELECT o_orderkey AS query_id, {lit(title)} AS title FROM orders WHERE {cond}"
        for title, cond in {
            "SELECT * used": _bit("star"),
            "LIKE starts with %": _bit("like"),
            "`= NULL` never matches": _bit("null"),
            "LIMIT without ORDER BY": f"{_bit('limit')} AND NOT {_bit('order')} AND NOT {_bit('union')}",
            "ORDER BY in a subquery without LIMIT": f"{_bit('inner')} AND {_bit('order')} AND NOT {_bit('limit')} AND NOT {_bit('union')}",
            "CASE without ELSE": _bit("case"),
            "UNION (not UNION ALL)": _bit("union"),
        }.items()
    ),
)
def _(t):
    bit = lambda name: F.expr(_bit(name).replace("(o_orderkey // 7)", "floor(o_orderkey / 7)"))
    part = lambda name, yes, no="": F.when(bit(name), yes).otherwise(no)
    inner = F.concat(
        F.lit("SELECT "), part("star", "*", "o_orderkey"), part("case", ", CASE WHEN o_orderstatus = 'F' THEN 1 END AS done"),
        F.lit(" FROM orders WHERE o_custkey = "), F.col("o_custkey").cast("string"),
        part("like", " AND o_orderpriority LIKE '%x'"), part("null", " AND o_totalprice = NULL"),
        part("union", " UNION SELECT o_orderkey FROM orders"), part("order", " ORDER BY o_orderkey"), part("limit", " LIMIT 4"),
    )
    sql = F.when(bit("inner"), F.concat(F.lit("SELECT q.o_orderkey FROM ("), inner, F.lit(") q"))).otherwise(inner)
    sql = F.when(bit("lower"), F.lower(sql)).otherwise(sql)
    log = t.orders.select(F.col("o_orderkey").alias("query_id"), F.lit("duckdb").alias("dialect"), sql.alias("sql"))
    return FI.lint_findings(log).select("query_id", "title")


# ---- comparison -------------------------------------------------------------

#: a, b, expected (category, subject, before, after); None = no clause diff
_PAIRS = [
    ("SELECT berth, tide FROM harbour WHERE berth = {n}", "SELECT   berth ,\n tide FROM harbour   WHERE berth={n}", []),
    ("SELECT crane FROM yard WHERE berth = {n} ORDER BY crane", "SELECT crane, load_t * 2 AS twice FROM yard WHERE berth = {n} ORDER BY crane", [("column added", "load_t * 2", None, "load_t * 2 AS twice")]),
    ("SELECT upper(flag) AS colours FROM fleet LIMIT 9", "SELECT upper(flag) AS ensign FROM fleet LIMIT 9", [("column renamed", "upper(flag)", "colours", "ensign")]),
    ("SELECT f.hull FROM fleet f", "SELECT f.hull FROM fleet f LEFT JOIN log_book l ON l.hull = f.hull", [("table added", "l", None, "LEFT JOIN log_book ON l.hull = f.hull")]),
    ("SELECT f.hull, l.day FROM fleet f JOIN log_book l ON l.hull = f.hull", "SELECT f.hull, l.day FROM fleet f FULL JOIN log_book l ON l.hull = f.hull", [("join type changed", "l", "JOIN", "FULL JOIN")]),
    (
        "SELECT f.hull FROM fleet f JOIN log_book l ON l.hull = f.hull WHERE l.day > 3", "SELECT f.hull FROM fleet f JOIN log_book l ON l.hull = f.hull AND l.port <> 'x' WHERE l.day > 3",
        [("join condition changed", "l", "l.hull = f.hull", "l.hull = f.hull AND l.port <> 'x'")],
    ),
    ("SELECT tide FROM harbour ORDER BY tide", "SELECT tide FROM harbour WHERE depth >= 7 ORDER BY tide", [("WHERE added", "WHERE", None, "depth >= 7")]),
    (
        "SELECT tide FROM harbour WHERE depth >= 7 AND lit IS NULL", "SELECT tide FROM harbour WHERE lit IS NULL AND depth > 7",
        [("condition added", "depth > 7", None, "depth > 7"), ("condition removed", "depth >= 7", "depth >= 7", None)],
    ),
    ("SELECT count(*) FROM yard GROUP BY crane, shift, berth", "SELECT count(*) FROM yard GROUP BY berth, crane, shift", [("GROUP BY reordered", "GROUP BY", "crane, shift, berth", "berth, crane, shift")]),
    ("SELECT max(load_t) FROM yard GROUP BY crane", "SELECT max(load_t) FROM yard GROUP BY year(day)", [("GROUP BY changed", "GROUP BY", "crane", "year(day)")]),
    ("SELECT hull FROM fleet ORDER BY built, hull", "SELECT hull FROM fleet ORDER BY hull, built", [("ORDER BY changed", "ORDER BY", "built, hull", "hull, built")]),
    ("SELECT hull FROM fleet ORDER BY hull LIMIT 30", "SELECT hull FROM fleet ORDER BY hull", [("LIMIT removed", "LIMIT", "30", None)]),
    ("SELECT hull, built FROM fleet LIMIT 30", "SELECT hull, built FROM fleet LIMIT 4", [("LIMIT changed", "LIMIT", "30", "4")]),
    ("UPDAT fleet SET built = 3", "SELECT hull FROM fleet", None),
    ("SELECT tide FROM harbour WHERE berth = {n}", "SELECT tide FROM WHERE berth = 2", None),
    ("WITH old AS (SELECT hull FROM fleet WHERE built < 1950) SELECT hull FROM old", "WITH old AS (SELECT hull FROM fleet WHERE built<1950)\nSELECT hull FROM old", None),
    ("SELECT hull FROM fleet UNION ALL SELECT {n}", "SELECT hull FROM fleet UNION SELECT 5", None),
    ("SELECT f.hull FROM fleet f CROSS JOIN harbour h WHERE h.depth > f.draught", "SELECT f.hull FROM fleet f WHERE h.depth > f.draught", [("table removed", "h", "CROSS JOIN harbour", None)]),
]
_DCOLS = ["category", "subject", "before", "after"]
_DT = {c: "VARCHAR" for c in _DCOLS}


def _pairs(t):
    a = query_log(t.orders, [x for x, _, _ in _PAIRS], "postgres").selectExpr("query_id AS pair_id", "author", "dialect", "sql AS sql_a")
    texts = F.array(*[F.lit(b) for _, b, _ in _PAIRS])
    b = F.get(texts, F.pmod("pair_id", F.lit(len(_PAIRS))).cast("int"))
    return a.withColumn("sql_b", F.replace(b, F.lit("{n}"), F.col("author").cast("string"))).drop("author")


def _diff_query(name, prefixes):
    rows = [(i, *e) for i, (_, _, ex) in enumerate(_PAIRS) for e in ex or [] if e[0].startswith(prefixes)]

    @query(name, values_sql(rows, _DCOLS, len(_PAIRS), _DT).replace("o_orderkey AS query_id", "o_orderkey AS pair_id"))
    def _(t):
        d = C.query_diff(_pairs(t))
        keep = F.lit(False)
        for p in prefixes:
            keep = keep | F.col("category").startswith(p)
        return d.where(keep).select("pair_id", *_DCOLS)


_diff_query("d01_select_list_diff", ("column",))
_diff_query("d02_join_diff", ("table", "join"))
_diff_query("d03_where_diff", ("WHERE", "condition"))
_diff_query("d04_group_order_diff", ("GROUP BY", "ORDER BY"))
_diff_query("d05_limit_diff", ("LIMIT",))


@query(
    "d06_compare_router",
    values_sql(
        [(i, i not in (13, 14), "a_invalid" if i == 13 else "b_invalid" if i == 14 else None, ex is not None, None if i in (13, 14) else i in (0, 15)) for i, (_, _, ex) in enumerate(_PAIRS)],
        ["comparable", "reason", "detailed", "identical"], len(_PAIRS), {"reason": "VARCHAR"},
    ).replace("o_orderkey AS query_id", "o_orderkey AS pair_id"),
)
def _(t):
    return C.compare_pairs(_pairs(t)).select("pair_id", "comparable", "reason", "detailed", "identical")


_FIXED_DIFF = [
    (0, "condition added", "x IS NULL"), (0, "condition removed", "x = NULL"),
    (1, "column added", "CASE WHEN x = 1 THEN 'a' ELSE NULL END"), (1, "column removed", "CASE WHEN x = 1 THEN 'a' END"),
]


@query("d07_fix_diff", values_sql(_FIXED_DIFF, ["category", "subject"], 3))
def _(t):
    log = query_log(t.orders, ["SELECT a FROM t{n} WHERE k = 1 AND x = NULL", "SELECT CASE WHEN x = 1 THEN 'a' END AS c FROM t{n}", "SELECT a FROM t{n}"])
    fixed = X.apply_auto_fixes(log).selectExpr("query_id AS pair_id", "'bigquery' AS dialect", "sql AS sql_a", "fixed_sql AS sql_b")
    return C.query_diff(fixed).selectExpr("pair_id AS query_id", "category", "subject")


_EXPLAIN = [
    ("SELECT berth, crew FROM ship{n} WHERE tons > 9 GROUP BY berth ORDER BY berth LIMIT 7", None,
     "Reads `berth`, `crew` of `ship{n}`. Condition: `tons > 9`. Groups: `berth`. Order: berth. At most 7 rows."),
    ("SELECT * FROM ship JOIN dock ON ship.berth = dock.b{n}", None, "Reads every column of `ship`; join to `dock` where `ship.berth = dock.b{n}`."),
    ("SELECT MAX(tons) FROM ship{n}", None, "Reads `MAX(tons)` of `ship{n}`. Without groups, one row sums up the whole input."),
    ("WITH big AS (SELECT {n} AS tons) SELECT * FROM big", "too_complex", None),
    ("SELEC tons FROM ship{n}", "invalid", None),
    ("SELECT d.port AS p, SUM(s.tons) FROM dock d LEFT JOIN ship s ON s.berth = d.berth WHERE d.zone = {n} AND s.flag IN (3, 4) GROUP BY d.port", None,
     "Reads `p`, `SUM(s.tons)` of `dock` under the name `d`; left join to `ship` where `s.berth = d.berth`. Conditions that all hold: `d.zone = {n}`, `s.flag IN (3, 4)`. Groups: `d.port`, with one aggregate per group."),
]


@query(
    "e01_explain",
    f"SELECT query_id, idx NOT IN (3, 4) AS explainable, CASE idx WHEN 3 THEN 'too_complex' WHEN 4 THEN 'invalid' END AS reason, NULLIF(sql, '') AS summary FROM {log_sql([s or '' for _, _, s in _EXPLAIN])}",
)
def _(t):
    return C.explain(query_log(t.orders, [a for a, _, _ in _EXPLAIN], "postgres"))


# ---- catalog and corpus -----------------------------------------------------

_USE = [
    ("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey WHERE o.o_custkey = {n}",
     [("orders", "o_custkey,o_orderkey", False), ("customer", "c_custkey,c_name", False)]),
    ("SELECT c.c_nmae, c.c_acctbal FROM customer c WHERE c.c_custkey = {n}", [("customer", "c_acctbal,c_custkey,c_nmae", False)]),
    ("SELECT o_totalprice FROM orders WHERE o_custkey = {n}", [("orders", "o_custkey,o_totalprice", False)]),
    ("SELECT l.qty FROM lineitm l WHERE l.k = {n}", [("lineitm", "k,qty", False)]),
    ("SELECT x, c.c_name FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey WHERE o.o_orderkey = {n}",
     [("customer", "c_custkey,c_name", True), ("orders", "o_custkey,o_orderkey", True)]),
]


def _use_log(t):
    return query_log(t.orders, [s for s, _ in _USE])


@query(
    "k01_ambiguous_names",
    "SELECT column_name, count(DISTINCT table_name) AS table_count, string_agg(DISTINCT table_name, ',' ORDER BY table_name) AS tables FROM "
    "(SELECT lower(n_name) AS table_name, lower(c_mktsegment) AS column_name FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY 1 HAVING count(DISTINCT table_name) > 1",
)
def _(t):
    return K.ambiguous_names(_nation_catalog(t))


@query("k02_unknown_tables", "SELECT 'lineitm' AS table_name, count(*) AS queries FROM orders WHERE o_orderkey % 5 = 3 HAVING count(*) > 0")
def _(t):
    return U.unknown_tables_ranked(_use_log(t), K.catalog_from_tables(t.spark, _live(t)))


_BIG = "SELECT concat('t', id) AS table_name, concat('c', id) AS column_name FROM range(10000)"


@query(
    "k02_unknown_tables_big_catalog",
    "SELECT 'lineitm' AS table_name, count(*) AS queries FROM orders WHERE o_orderkey % 5 = 3 HAVING count(*) > 0",
)
def _(t):
    big = t.spark.sql(_BIG).selectExpr("table_name", "column_name", "1 AS ordinal", "'int' AS data_type")
    return U.unknown_tables_ranked(_use_log(t), K.catalog_from_tables(t.spark, _live(t)).unionByName(big))


@query("k03_unknown_columns", "SELECT 'customer' AS table_name, 'c_nmae' AS column_name, count(*) AS queries, 'c_name' AS nearest FROM orders WHERE o_orderkey % 5 = 1")
def _(t):
    return U.unknown_columns_ranked(_use_log(t), K.catalog_from_tables(t.spark, _live(t)))


@query(
    "k04_unused_catalog",
    "SELECT * FROM (VALUES "
    + ", ".join(
        f"('{t}', '{c}', {t not in ('orders', 'customer')})"
        for t, cs in _LIVE_COLS.items() for c in cs if c not in ("o_orderkey", "o_custkey", "o_totalprice", "c_custkey", "c_name", "c_acctbal")
    )
    + ") v(table_name, column_name, table_unused) WHERE (SELECT count(*) FROM orders) > 0",
)
def _(t):
    return U.unused_catalog(_use_log(t), K.catalog_from_tables(t.spark, _live(t)))


@query(
    "k05_positional_check",
    """SELECT 1 AS ordinal, 'c_custkey' AS target_column, 's_suppkey' AS source_column, FALSE AS same_name, TRUE AS same_type, count(s_suppkey) AS filled_rows FROM supplier
 UNION ALL SELECT 2, 'c_name', 's_nationkey', FALSE, FALSE, count(s_nationkey) FROM supplier UNION ALL SELECT 3, 'c_nationkey', 'c_nationkey', TRUE, TRUE, count(s_nationkey) FROM supplier
 UNION ALL SELECT 4, 'c_acctbal', NULL, FALSE, FALSE, 0 FROM supplier WHERE s_suppkey = (SELECT min(s_suppkey) FROM supplier)""",
)
def _(t):
    src = t.supplier.selectExpr("s_suppkey", "s_nationkey", "s_nationkey AS c_nationkey")
    return K.positional_check(t.customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal"), src)


@query("k06_column_map", values_sql([(i, *m) for i, (_, ms) in enumerate(_USE) for m in ms], ["table_name", "columns", "unresolved"], len(_USE)))
def _(t):
    return U.column_map(_use_log(t))


# ---- a rewrite must not add findings ----------------------------------------


@query("v06_no_new_findings", values_sql([(0, "JOIN without ON condition"), (2, "SELECT * used")], ["title"], 3))
def _(t):
    a = query_log(t.orders, ["SELECT a.x, b.y FROM a JOIN b ON a.id = b.id WHERE a.k = {n}", "SELECT * FROM t WHERE k = {n}", "SELECT a FROM t WHERE k = {n}"])
    b = query_log(t.orders, ["SELECT a.x, b.y FROM a JOIN b WHERE a.k = {n}", "SELECT * FROM t WHERE k = {n} ORDER BY a", "SELECT * FROM t WHERE k = {n}"])
    return X.no_new_findings(a, b)


# ---- names through sub-selects -------------------------------------------------

_LEVELS = {"cte": 0, "derived": 1, "star": 2, "rename": 3, "exists": 4, "wrong": 5}


def _level(name: str) -> str:
    return f"(o_orderkey // 7) % {2 << _LEVELS[name]} >= {1 << _LEVELS[name]}"


def _nested_log(t, wrong: bool):
    """One text per order: bits of its key say how the orders are wrapped, and whether an outer name exists below."""
    bit = lambda name: F.expr(_level(name).replace("(o_orderkey // 7)", "floor(o_orderkey / 7)"))
    renamed = bit("rename") & ~bit("star")
    key = F.when(renamed, "k").otherwise("o_orderkey")
    inner = F.when(bit("star"), "SELECT * FROM orders o").when(renamed, "SELECT o.o_orderkey AS k, o.o_custkey, o.o_totalprice + 1 AS p FROM orders o")
    inner = inner.otherwise("SELECT o_orderkey, o_custkey, o_totalprice * 2 AS p FROM orders")
    name = F.when(bit("wrong"), "nothing").otherwise(key) if wrong else key
    head = F.when(bit("cte"), F.concat(F.lit("WITH c AS ("), inner, F.lit(") "))).otherwise("")
    source = (
        F.when(bit("cte") & bit("derived"), "(SELECT * FROM c) d").when(bit("cte"), "c d").otherwise(F.concat(F.lit("("), inner, F.lit(") d")))
    )
    test = F.when(bit("exists"), " AND EXISTS (SELECT 1 FROM customer cu WHERE cu.c_custkey = d.o_custkey)").otherwise("")
    sql = F.concat(head, F.lit("SELECT d."), name, F.lit(" AS x FROM "), source, F.lit(" WHERE d.o_custkey = "), F.col("o_custkey").cast("string"), test, F.lit(" ORDER BY x"))
    return t.orders.select(F.col("o_orderkey").alias("query_id"), F.lit("duckdb").alias("dialect"), sql.alias("sql"))


_SHOP = [("orders", c) for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")] + [("customer", "c_custkey"), ("customer", "c_name")]
_ALL = ",".join(sorted(c for n, c in _SHOP if n == "orders"))


@query(
    "k06_lineage",
    f"""SELECT o_orderkey AS query_id, 'orders' AS table_name, CASE WHEN {_level("star")} THEN '{_ALL}' ELSE 'o_custkey,o_orderkey,o_totalprice' END AS columns FROM orders
 UNION ALL SELECT o_orderkey, 'customer', 'c_custkey' FROM orders WHERE {_level("exists")}""",
)
def _(t):
    return L.lineage(_nested_log(t, False), t.spark.createDataFrame(_SHOP, "table_name string, column_name string"))


@query("l37_nested_columns", f"SELECT o_orderkey AS query_id, 'd.nothing' AS name FROM orders WHERE {_level('wrong')}")
def _(t):
    return L.unknown_names(_nested_log(t, True), t.spark.createDataFrame(_SHOP, "table_name string, column_name string"))
