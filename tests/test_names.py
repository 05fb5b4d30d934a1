"""Names are resolved inside their text: nothing is written or shuffled between the levels of nesting."""

from queryscope.operators import lineage as L
from queryscope.plans import tokens as T

CATALOG = [("ships", "id"), ("ships", "name"), ("docks", "id"), ("docks", "town"), ("Crew", "Pay"), (None, "lost"), ("docks", None)]
TEXTS = [
    (1, "SELECT q.town, q.name, q.id, q.gone FROM (SELECT * FROM ships s JOIN docks d ON s.id = d.id) q"),
    (2, "WITH x AS (SELECT x.a FROM x) SELECT x.a FROM x"),  # leads back to itself: it must end
    (3, "SELECT c.pay, c.none, f.mast FROM crew c, fleet f"),
    (4, "WITH a AS (SELECT id AS k FROM docks), b AS (SELECT a.k AS m FROM a) SELECT b.m, b.n FROM b; SELECT * FROM docks"),
    (None, "SELECT s.name FROM ships s"), (1, "SELECT s.name FROM ships s"), (5, ""), (6, None),
]


def _given(spark):
    log = spark.createDataFrame([(i, "postgres", s) for i, s in TEXTS], "query_id long, dialect string, sql string")
    return log, spark.createDataFrame(CATALOG, "table_name string, column_name string")


def test_columns_and_lost_names(spark):
    log, catalog = _given(spark)
    assert sorted(map(str, (tuple(r) for r in L.lineage(log, catalog).collect()))) == sorted(map(str, [
        (1, "ships", "id,name"), (1, "docks", "id,town"), (3, "crew", "pay"), (3, "fleet", "mast"), (4, "docks", "id,town"), (None, "ships", "name"), (1, "ships", "name"),
    ]))
    assert sorted(tuple(r) for r in L.unknown_names(log, catalog).collect()) == [(2, "x.a"), (3, "c.none"), (4, "b.n")]


def test_references_are_neither_written_nor_shuffled(spark, monkeypatch):
    log, catalog = _given(spark)
    cuts = []
    monkeypatch.setattr(L, "cut", lambda df: cuts.append(df) or df)
    texts = T.distinct_texts(T.normalise_log(log))
    plan = L.resolved_columns(texts)._jdf.queryExecution().executedPlan().toString()
    assert not cuts and plan.count("Exchange") == 1 and plan.count("ArrowEvalPython") == 1 and "Join" not in plan
