"""What is made of whole texts is what the aggregates over token rows give, without token rows."""

from pyspark.sql import functions as F

from queryscope.operators import findings as FI, rules as R
from queryscope.plans import tokens as T

TEXTS = [
    "SELECT a.x, COUNT(*) AS n, ROW_NUMBER() OVER (PARTITION BY b.k, n ORDER BY y) rn FROM a LEFT JOIN s.b bb ON a.id = bb.id AND bb.q BETWEEN '2020-01-01' AND '2020-02-01' WHERE a.p > 1 AND (b.x IS NULL OR UPPER(b.y) = 'Q') GROUP BY 1, a.x ORDER BY 1 DESC, y LIMIT 5",
    "WITH x AS (SELECT a FROM t), ÑİX (p) AS (SELECT 1) SELECT DISTINCT a b c FROM x WHERE a NOT IN (SELECT b FROM u WHERE c LIKE '%q' AND d = NULL) UNION SELECT d FROM v UNION ALL SELECT e FROM w ORDER BY 1",
    "UPDATE t SET a = 7 FROM o WHERE b = 2; SELECT CASE WHEN a = 1 THEN CASE WHEN b THEN 2 END ELSE 3 END FROM t; ;DELETE FROM z",
    "INSERT INTO t SELECT TOP 3 a::int, SUM(q) FILTER (WHERE r > 1) + SUM(SUM(v) OVER (ORDER BY w)) FROM s.t.u JOIN LATERAL (SELECT * FROM y) l USING (k), z WHERE COALESCE(a, 0) = 1 AND NULL <> b",
    "SELECT (((a FROM t WHERE ) AND , ; ) SELECT SELECT FROM GROUP ORDER", "-- noqa\n", "", "SELECT a -- noqa: select * used\nFROM t\nWHERE x == 'it''s' AND y = @v OR \"w\".z <> 1e5",
    "SELECT MAX((SELECT b.c FROM b WHERE EXISTS (SELECT 1 FROM c WHERE c.i = b.i)); SELECT 2) FROM a",
]


def _texts(spark):
    rows = [(10 * i + j, d, s) for i, d in enumerate(("postgres", "bigquery", "tsql")) for j, s in enumerate(TEXTS)]
    log = spark.createDataFrame([*rows, (None, "duckdb", None), (7, None, TEXTS[0])], "query_id long, dialect string, sql string")
    return log, T.distinct_texts(T.normalise_log(log))


def _plain(x, ordered=False):
    if isinstance(x, dict):
        return {k: _plain(v, k in ("sels", "segs", "tabs")) for k, v in x.items()}
    if isinstance(x, list):  # aggregates collect in any order
        return [_plain(v) for v in x] if ordered else sorted(map(str, x))
    return bytes(x) if isinstance(x, bytearray) else x


def _rows(df):
    return sorted(str(sorted(_plain(r.asDict(True)).items())) for r in df.collect())


def test_whole_texts_give_the_rows_of_the_aggregates_over_tokens(spark):
    texts = _texts(spark)[1].cache()
    for make in (T.segments, T.statements, T.root_items):
        by_token, whole = make(T.scoped_tokens(texts)), make(T.whole(texts))
        assert set(by_token.columns) <= set(whole.columns) | {"tid"}
        assert _rows(by_token) == _rows(whole.select(*by_token.columns)), make.__name__
    texts.unpersist()


def test_a_lint_walks_each_text_once_and_shuffles_no_token(spark):
    log, texts = _texts(spark)
    plan = FI.check_texts(texts)._jdf.queryExecution().executedPlan().toString()
    # the texts are shuffled to find the distinct ones; nothing after that
    assert plan.count("ArrowEvalPython") == 1 and plan.count("Exchange") == 1 and "explode" not in plan and "Window" not in plan
    plan = FI.lint_findings(log)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_names_of_facts_in_literals_and_variables_stay(spark):
    log = spark.createDataFrame([(1, "postgres", "SELECT a, b FROM t"), (2, "postgres", "SELECT a FROM t; SELECT b, c FROM u")], "query_id long, dialect string, sql string")
    R.register_rule("own literal", "low", "%s", "if(size(cols) > 1, concat('cols', cols[0].name), NULL)")
    R.register_rule("own variable", "low", "%s", "get(filter(transform(cols, cols -> cols.name), x -> x > 'a'), 0)")
    try:
        got = {r["query_id"]: {f["title"]: f["message"] for f in r["findings"]} for r in FI.lint_corpus(log, ["own literal", "own variable"]).select("query_id", "findings").collect()}
    finally:
        R.unregister_rule("own literal")
        R.unregister_rule("own variable")
    assert got == {1: {"own literal": "colsa", "own variable": "b"}, 2: {"own literal": "colsb", "own variable": "b"}}


def test_directives_of_a_text_are_those_of_its_comments(spark):
    texts = _texts(spark)[1].union(spark.createDataFrame([(bytearray(b"x"), "SELECT 1 /* NoQA : A, b ,, */ -- noqa:\n# noqa\n", "mysql", 1)], "tid binary, sql string, dialect string, copies long"))
    own = texts.select("tid", FI.noqa_of(F.col("sql"), F.col("dialect")).alias("d")).select("tid", "d.*").where("suppress_all OR size(titles) > 0")
    assert _rows(own) == _rows(FI.noqa_directives(texts)) != []
