"""Names resolved through CTEs, derived tables, renames, stars and correlated sub-selects."""

from queryscope.operators import lineage as L
from queryscope.plans import tokens as T

CATALOG = [("ships", "id"), ("ships", "name"), ("ships", "dock"), ("docks", "id"), ("docks", "town"), ("crew", "ship_id"), ("crew", "pay")]

#: text -> (qualifier, name as written) -> (table, column, state)
TEXTS = {
    "SELECT s.name FROM ships s": {("s", "name"): ("ships", "name", "table")},
    "SELECT a.n FROM (SELECT b.n FROM (SELECT name AS n FROM ships) b) a": {("a", "n"): ("ships", "name", "table"), ("b", "n"): ("ships", "name", "table"), (None, "name"): ("ships", "name", "table")},
    "WITH x AS (SELECT id AS k, pay * 2 AS p FROM crew), y AS (SELECT * FROM x) SELECT y.k, y.p, y.q FROM y": {
        ("y", "k"): ("crew", "id", "unknown"), ("y", "p"): (None, "p", "expression"), ("y", "q"): (None, "q", "unknown"), (None, "id"): ("crew", "id", "unknown"), (None, "pay"): ("crew", "pay", "table"),
    },
    "SELECT s.id FROM ships s WHERE EXISTS (SELECT 1 FROM crew c WHERE c.ship_id = s.id AND c.pay > (SELECT avg(d.pay) FROM crew d WHERE d.ship_id = s.dock))": {
        ("s", "id"): ("ships", "id", "table"), ("c", "ship_id"): ("crew", "ship_id", "table"), ("c", "pay"): ("crew", "pay", "table"), ("d", "pay"): ("crew", "pay", "table"),
        ("d", "ship_id"): ("crew", "ship_id", "table"), ("s", "dock"): ("ships", "dock", "table"),
    },
    "SELECT q.town, q.name FROM (SELECT * FROM ships s JOIN docks d ON s.dock = d.id) q": {
        ("q", "town"): ("docks", "town", "table"), ("q", "name"): ("ships", "name", "table"), ("s", "dock"): ("ships", "dock", "table"), ("d", "id"): ("docks", "id", "table"),
    },
    "SELECT name AS label FROM ships ORDER BY label": {(None, "name"): ("ships", "name", "table")},
    "SELECT z.a FROM ships s": {},
    "WITH RECURSIVE r AS (SELECT id AS n FROM ships UNION ALL SELECT r.n FROM r WHERE r.n < 9) SELECT r.n FROM r": {(None, "id"): ("ships", "id", "table"), ("r", "n"): ("ships", "id", "table")},
}


def test_names(spark):
    catalog = spark.createDataFrame(CATALOG, "table_name string, column_name string")
    log = spark.createDataFrame([(i, "postgres", s) for i, s in enumerate(TEXTS)], "query_id long, dialect string, sql string")
    keyed = T.normalise_log(log)
    got = keyed.join(L.resolved_columns(T.distinct_texts(keyed), catalog), "tid").collect()
    for i, (text, wanted) in enumerate(TEXTS.items()):
        own = {(r["given"], r["written"]): (r["table_name"], r["column_name"], r["state"]) for r in got if r["query_id"] == i}
        assert own == wanted, text


def test_empty_log(spark):
    catalog = spark.createDataFrame(CATALOG, "table_name string, column_name string")
    log = spark.createDataFrame([], "query_id long, dialect string, sql string")
    assert L.lineage(log, catalog).count() == 0 and L.unknown_names(log, catalog).count() == 0


def test_wide_tables_are_not_broadcast(spark, tmp_path, monkeypatch):
    """Files look small and so do estimates behind a checkpoint: no table of texts may go through the driver for that."""
    catalog = spark.createDataFrame(CATALOG, "table_name string, column_name string")
    spark.createDataFrame([(i, "postgres", s) for i, s in enumerate(TEXTS)], "query_id long, dialect string, sql string").write.parquet(str(tmp_path / "log"))
    plans, real = [], L.cut
    planned = lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString())
    monkeypatch.setattr(L, "cut", lambda df: planned(df) or real(df))
    log = spark.read.parquet(str(tmp_path / "log"))
    for job in (L.lineage, L.unknown_names):
        planned(job(log, catalog))
    assert not [p for p in plans if "BroadcastHashJoin" in p]
