"""Numbering by key: exact with hot parts, ties and nulls, and without writing the payload."""

import random

from pyspark.sql import functions as F

from queryscope.operators import correct as C
from queryscope.plans import skew


def test_numbers_and_ties(spark):
    rng = random.Random(6)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, *range(40)]), i, f"payload{i % 7}") for i in range(3000)] + [(9, 1, -1, "x")]
    df = spark.createDataFrame(rows, "k long, t long, i long, p string").repartition(7)
    got = skew.numbered(df, ["k"], [("t", False)]).collect()
    assert sorted((r["k"], r["t"], r["i"], r["p"]) for r in got if r["k"] and r["t"]) == sorted(r for r in rows if r[0] and r[1])
    for k in {r[0] for r in rows}:
        own = sorted((r for r in got if r["k"] == k), key=lambda r: r["rn"])
        assert [r["rn"] for r in own] == list(range(1, len(own) + 1)) and len(own) == sum(r[0] == k for r in rows)
        times = [(r["t"] is None, -(r["t"] or 0)) for r in own]
        assert times == sorted(times)


def test_payload_is_not_written(spark, monkeypatch):
    written = []
    monkeypatch.setattr(skew, "cut", lambda df: written.append(df.columns) or df.checkpoint())
    spark.sparkContext.setCheckpointDir(spark.sparkContext.getCheckpointDir() or "/tmp/queryscope-test-ckpt")
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("t"), F.lit("wide").alias("payload"))
    out = skew.numbered(df, ["k"], [("t", True)])
    assert written and all("payload" not in names for names in written)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") + plan.count("Exchange SinglePartition") <= 3  # one more range exchange is behind the checkpoint


def test_deep_page(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(50), i, f"p{i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "a long, i long, p string").repartition(6)
    wanted = sorted(rows, key=lambda r: (-r[0], r[1]))
    for limit, offset in ((10, 1795), (300, 0), (50, 1990), (5, 5000)):
        got = [tuple(r) for r in C.page(df, [("a", False)], ["i"], limit, offset, head_rows=0).collect()]
        assert got == wanted[offset : offset + limit]
    assert C.page(df.limit(0), [("a", True)], ["i"], 5, 3, head_rows=0).count() == 0
