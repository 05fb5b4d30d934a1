"""NULL and empty edges, hot groups and brute-force checks on hand-made frames."""

import random
from collections import Counter, deque

import pytest
from pyspark.sql import functions as F

from queryscope.operators import audits as A, correct as C, verify as V
from queryscope.plans.skew import frame_buckets, numbered, range_blocks, running
from queryscope.sources import catalog as K, corpus as S
from queryscope.streaming import service as R


def _hot(spark, n=4000):
    """A third of the rows share one group; groups and values contain NULLs."""
    rnd = random.Random(7)
    rows = []
    for i in range(n):
        g = 1 if i % 3 == 0 else None if i % 17 == 0 else rnd.randrange(2, 40)
        v = None if i % 13 == 0 else rnd.randrange(0, 400)
        rows.append((i, g, v, rnd.randrange(100)))
    return rows, spark.createDataFrame(rows, "id long, g long, v int, x int").repartition(8)


@pytest.mark.parametrize("agg,op", [("COUNT", ">"), ("COUNT", "<"), ("COUNT", "!="), ("SUM", ">"), ("AVG", ">"), ("MIN", ">"), ("MAX", "!=")])
def test_correlated_agg_brute_force(spark, agg, op):
    rows, df = _hot(spark, 1500)
    cmp = {">": lambda a, b: a > b, "<": lambda a, b: a < b, "!=": lambda a, b: a != b}[op]
    fold = {"COUNT": len, "SUM": sum, "AVG": lambda s: sum(s) / len(s), "MIN": min, "MAX": max}[agg]
    got = {r["id"]: r["result"] for r in C.correlated_agg(df, "g", "v", op, agg, None if agg == "COUNT" else "x").collect()}
    for i, g, v, _ in rows:
        hits = [x for _, g2, v2, x in rows if g is not None and v is not None and g2 == g and v2 is not None and cmp(v2, v)]
        want = fold(hits) if hits else (0 if agg == "COUNT" else None)
        assert got[i] == (pytest.approx(want) if want is not None else None)


def test_numbering_survives_a_hot_group(spark):
    rows, df = _hot(spark)
    assert df.select("g").groupBy("g").count().where("g = 1").first()["count"] > 1000
    blocks = range_blocks(df, ["g", "v", "id"])
    assert blocks.where("g = 1").select("_blk").distinct().count() > 1
    got = {r["id"]: r["rn"] for r in numbered(df, ["g"], [F.col("v").asc(), F.col("id").asc()]).collect()}
    by = {}
    for i, g, v, _ in rows:
        by.setdefault(g, []).append((v is not None, v or 0, i))
    for g, items in by.items():
        for k, (_, _, i) in enumerate(sorted(items), 1):
            assert got[i] == k


def test_window_and_moving_sum_across_buckets(spark, monkeypatch):
    import queryscope.operators.correct as mod

    monkeypatch.setattr(mod, "frame_buckets", lambda d, rn, b, a: frame_buckets(d, rn, b, a, 50))
    rows, df = _hot(spark, 1200)
    got = {r["id"]: r["m"] for r in C.moving_sum(df, ["g"], [F.col("id")], "x", 6, "m").collect()}
    w = {r["id"]: (r["prev_value"], r["next_value"]) for r in C.ordered_window(df, ["g"], [("v", True)], ["id"], "x").collect()}
    by = {}
    for i, g, v, x in rows:
        by.setdefault(g, []).append((i, v, x))
    for items in by.values():
        for k, (i, _, _) in enumerate(items):
            assert got[i] == sum(x for _, _, x in items[max(0, k - 6): k + 1])
        o = sorted(items, key=lambda t: (t[1] is not None, t[1] or 0, t[0]))
        for k, (i, _, _) in enumerate(o):
            assert w[i] == (o[k - 1][2] if k else None, o[k + 1][2] if k + 1 < len(o) else None)


@pytest.mark.parametrize("block_rows", [10_000, 60])
def test_throttle_equals_sequential_walk(spark, block_rows):
    rnd = random.Random(3)
    rows, t = [], 0
    for i in range(1500):
        t += rnd.choice([1, 2, 5, 40, 400 if i % 50 == 0 else 3])
        rows.append((i, "hot" if i % 3 else f"u{i % 5}", t))
    df = spark.createDataFrame(rows, "id long, k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["id"]: r["accepted"] for r in R.throttle(df, "k", "ts", "id", 5, 120, block_rows).collect()}
    state = {}
    for i, k, s in rows:
        q = state.setdefault(k, deque())
        while q and s - q[0] > 120:
            q.popleft()
        ok = len(q) < 5
        if ok:
            q.append(s)
        assert got[i] == ok, i


def test_not_in_empty_null_and_clean(spark):
    l = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    mk = lambda *xs: spark.createDataFrame([(x,) for x in xs], "k int")
    row = lambda r: A.not_in_trap(l, "k", r, "k").first()
    assert (row(mk()).not_in_rows, row(mk()).not_exists_rows) == (3, 3)
    assert (row(mk(1, None)).not_in_rows, row(mk(1, None)).not_exists_rows) == (0, 2)
    assert (row(mk(1)).not_in_rows, row(mk(1)).not_exists_rows) == (1, 2)


def test_multiset_equality(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    b = spark.createDataFrame([(2, "x"), (1, None), (1, None)], "p int, q string")
    c = spark.createDataFrame([(2, "x"), (2, "x"), (1, None)], "p int, q string")
    assert V.verify_equal(a, b).first()["verdict"] == "equivalent"
    assert V.verify_equal(a, c).first()["verdict"] == "different"
    both = a.exceptAll(c).count(), c.exceptAll(a).count()
    r = V.verify_equal(a, c).first()
    assert (r["extra_in_a"], r["extra_in_b"]) == both
    assert V.verdict(a, a.select("a")).first()["verdict"] == "inconclusive"


def test_outer_nullify_known_answer(spark):
    d = "/root/testdata/sf0.01"
    cu, o = spark.read.parquet(f"{d}/customer.parquet"), spark.read.parquet(f"{d}/orders.parquet").where("o_orderkey % 50 = 0")
    r = A.outer_nullify(cu, o, [("c_custkey", "o_custkey")], "left", F.col("o_totalprice") > 100000).first()
    assert (r["outer_rows"], r["unmatched_rows"], r["rows_in_where"], r["unmatched_kept"]) == (1526, 1226, 247, 0)
    assert r["verdict"] == "filtered_out"


def test_outer_nullify_empty_optional_side(spark):
    l, r = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([], "k int, v int")
    row = A.outer_nullify(l, r, [("k", "k")], "left", F.col("v").isNull()).first()
    assert (row["unmatched_kept"], row["verdict"]) == (2, "survives")


def test_upsert_keeps_target_rows(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    s = spark.createDataFrame([(1, "y"), (1, "x"), (3, "z"), (3, "w")], "k int, v string")
    assert sorted(map(tuple, C.upsert(t, s, ["k"]).collect())) == [(1, "x", "updated"), (2, "b", "kept"), (3, "w", "inserted")]
    assert sorted(map(tuple, C.ambiguous_keys(s, ["k"]).collect())) == [(1, 2), (3, 2)]


def test_sources(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.sql").write_text("SELECT 1;\nSELECT 2")
    (tmp_path / "c.json").write_text('{"employees": ["employee_id", "salary"]}')
    d = S.read_sql_files(spark, [str(tmp_path / "x"), str(tmp_path / "nothing" / "*.sql")]).collect()
    assert [(r["sql"], r["error"]) for r in d] == [("SELECT 1;\nSELECT 2", None), (None, "no file matches")]
    cat = K.read_catalog_json(spark, str(tmp_path / "c.json"))
    assert [tuple(r) for r in cat.orderBy("ordinal").collect()] == [("employees", "employee_id", 1), ("employees", "salary", 2)]
    p = spark.createDataFrame([("a.sql",), ("m/b.sql",), ("m/n/c.txt",)], "path string")
    assert [r[0] for r in S.filter_paths(p, ["**/*.sql"]).collect()] == ["a.sql", "m/b.sql"]
    assert [r[0] for r in S.filter_paths(p, ["*.sql"]).collect()] == ["a.sql"]


def test_in_correlated_null_rules(spark):
    rows = [(1, 10, 5), (2, 10, 9), (None, 10, 7), (1, 10, 1), (3, 20, 4), (None, 20, 4), (3, None, 2)]
    df = spark.createDataFrame(rows, "k int, g int, v int")
    df.createOrReplaceTempView("corr_t")
    for neg, kw in ((False, "IN"), (True, "NOT IN")):
        got = Counter(map(tuple, C.in_correlated(df, df, "k", "g", "v", negated=neg).collect()))
        want = Counter()
        for k, g, v in rows:
            inner = [k2 for k2, g2, v2 in rows if g is not None and g2 == g and v2 > v]
            hit = k is not None and k in inner
            keep = hit if not neg else (not inner or (k is not None and not hit and None not in inner))
            want[(k, g, v)] += keep
        assert got == +want, kw
