"""Plans and results of the steps that must not grow faster than their input."""

from queryscope.sources import catalog as K

DDL = [
    (1, "CREATE TABLE a (id INT, amt DECIMAL(10,2), CONSTRAINT pk PRIMARY KEY (id)); CREATE TABLE BROKEN (((; CREATE TABLE IF NOT EXISTS db.b (x INT)"),
    (2, "CREATE VIEW v AS SELECT 1; CREATE TABLE c AS SELECT 1"), (3, ""), (4, None), (5, "-- x"), (7, ";;"),
    (8, "INDEX; ) CREATE TABLE t (a INT); CREATE TABLE u (a)"), (9, "CREATE /* c */ TABLE t -- d\n(a INT, b /* , */ INT)"), (None, "CREATE TABLE q (z INT)"),
]


def test_ddl_is_read_without_sorting_tokens(spark):
    ddl = spark.createDataFrame(DDL, "ddl_id long, sql string")
    plan = K._ddl_statements(ddl, "bigquery")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort " not in plan and plan.count("Exchange hashpartitioning") == 1
    catalog, skipped = K.catalog_from_ddl(ddl)
    assert sorted(map(str, (tuple(r) for r in catalog.select("ddl_id", "table_name", "column_name", "ordinal").collect()))) == sorted(map(str, [
        (1, "a", "id", 1), (1, "a", "amt", 2), (1, "b", "x", 1), (9, "t", "a", 1), (9, "t", "b", 2), (None, "q", "z", 1),
    ]))
    assert {r["ddl_id"]: r["skipped"] for r in skipped.collect()} == {1: 1, 2: 2, 8: 3, 9: 0, None: 0}


def test_fixes_keep_edits_and_no_tokens(spark, monkeypatch):
    from queryscope.operators import fixes as X
    from queryscope.plans import tokens as T

    kept, walked, real_cut, real_tokens = [], [], X.cut, T.scoped_tokens
    monkeypatch.setattr(X, "cut", lambda df: kept.append(df.columns) or real_cut(df))
    monkeypatch.setattr(T, "scoped_tokens", lambda texts, only=None: walked.append(only) or real_tokens(texts, only))
    log = spark.createDataFrame([
        (1, "postgres", "SELECT a FROM t WHERE x = NULL AND NULL <> y"), (2, "postgres", "SELECT CASE WHEN a = 1 THEN 2 END FROM t -- noqa: case without ELSE"),
        (3, "postgres", "SELECT DISTINCT a FROM t WHERE b = NULL GROUP BY a"), (4, "postgres", "SELECT t.u.a FROM t"), (None, "postgres", "SELECT a FROM t WHERE x = NULL"), (5, "postgres", None),
    ], "query_id long, dialect string, sql string")
    keyed = T.normalise_log(log)
    assert X.fix_texts(T.distinct_texts(keyed), ("x01",)).count() == 3
    assert [set(c) for c in kept] == [{"tid", "pos", "new", "before", "after", "drop_ws", "gap"}] and None not in walked
    got = {r["query_id"]: (r["fixed_sql"], r["fixed_titles"]) for r in X.apply_auto_fixes(log).collect()}
    assert got == {
        1: ("SELECT a FROM t WHERE x IS NULL AND y IS NOT NULL", ["`!= NULL` never matches", "`= NULL` never matches"]),
        3: ("SELECT a FROM t WHERE b IS NULL GROUP BY a", ["Redundant DISTINCT with GROUP BY", "`= NULL` never matches"]),
        4: ("SELECT u.a FROM t", ["Table alias leaked into a column qualifier"]),
        None: ("SELECT a FROM t WHERE x IS NULL", ["`= NULL` never matches"]),
    }
    assert not any({"u", "clause"} <= set(c) for c in kept)


def test_walk_is_handed_what_it_reads(spark):
    from queryscope.plans import tokens as T

    odd = "SELECT É, ñ, E'a', \"q.r\", 0x1F, $1, 'x' -- c\nFROM t WHERE _a == 1"
    keyed = T.normalise_log(spark.createDataFrame([(1, "postgres", odd)], "query_id long, dialect string, sql string"))
    few = T.fact_table(T.distinct_texts(keyed), ["pos", "scope", "ckw"])
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("substring_index", "breaks", "inner,", "lead", "width"))
    assert [r["ckw"] for r in few.where("ckw IS NOT NULL").orderBy("pos").collect()] == ["SELECT", "FROM", "WHERE"]
    got = T.fact_table(T.distinct_texts(keyed), ["pos", "u", "kind", "name", "line"]).orderBy("pos").collect()
    assert [(r["u"], r["kind"], r["name"], r["line"]) for r in got if r["u"] != ","] == [
        ("SELECT", "kw", None, 1), ("É", "word", "É", 1), ("Ñ", "word", "ñ", 1), ("E'A'", "str", None, 1), ('"Q.R"', "quoted", "r", 1), ("0X1F", "num", None, 1),
        ("$1", "str", None, 1), ("'X'", "str", None, 1), ("FROM", "kw", None, 2), ("T", "word", "t", 2), ("WHERE", "kw", None, 2), ("_A", "word", "_a", 2),
        ("=", "op", None, 2), ("1", "num", None, 2),
    ]
