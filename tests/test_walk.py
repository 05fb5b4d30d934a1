"""What the walk over a text hands to Spark, and what Spark looks up in the arrays of the text."""

import pyarrow as pa

from queryscope.plans import fold, tokens as T

TEXTS = ["SELECT a FROM t WHERE f(b) /* c */ = 1 UNION SELECT c FROM u UNION ALL SELECT d FROM v", "SELECT x", "", "-- nothing"]


def _tokens(spark):
    log = spark.createDataFrame([(i, "postgres", s) for i, s in enumerate(TEXTS)], "query_id long, dialect string, sql string")
    keyed = T.normalise_log(log)
    tok = T.scoped_tokens(T.distinct_texts(keyed))
    return keyed.select("query_id", "tid").join(tok, "tid").orderBy("query_id", "pos").collect()


def test_neighbours_end_at_the_borders_of_a_text(spark):
    rows = _tokens(spark)
    for no, text in enumerate(TEXTS):
        own = [r for r in rows if r["query_id"] == no]
        u = text.replace("/* c */ ", "").replace("(", " ( ").replace(")", " ) ").upper().split() if no < 2 else []
        assert [r["u"] for r in own] == u and [r["pos"] for r in own] == list(range(1, len(u) + 1))
        at = lambda i: u[i] if 0 <= i < len(u) else None
        for i, r in enumerate(own):
            assert [r[c] for c in ("p1", "p2", "p3", "p4", "p5", "n1", "n2")] == [at(i + k) for k in (-1, -2, -3, -4, -5, 1, 2)]


def test_opening_parenthesis_and_set_operation(spark):
    own = [r for r in _tokens(spark) if r["query_id"] == 0]
    close = next(r for r in own if r["u"] == ")")
    assert close["m"].asDict() == {"at": close["pos"] - 2, "kind": "func", "fn": "F", "before": "WHERE"}
    assert [r["u"] for r in own if r["m"] is not None] == [")"]
    second = [r for r in own if r["u"] == "UNION"][1]
    assert second["prev_setop"].asDict() == {"u": "UNION", "n1": "SELECT"} and own[0]["prev_setop"] is None


def test_only_what_is_read_leaves_the_walk(spark):
    assert fold.given_for(["pos", "p1", "n2", "depth"]) == ["u", "depth"]
    assert not set(fold.given_for(list(fold.COLUMNS))) & {"pos", *fold.NEIGHBOURS, *fold.PAIRS}
    entry = pa.struct([("text", pa.string()), ("u", pa.string()), ("kind", pa.string()), ("name", pa.string()), *((k, pa.int32()) for k in ("breaks", "inner", "lead", "width"))])
    toks = pa.array([[dict(text="(", u="(", kind="op", name=None, breaks=0, inner=0, lead=0, width=1)], []], pa.list_(entry))
    assert fold.facts_of(toks, pa.array(["postgres", "postgres"]), ["depth", "frame"]).to_pylist() == [{"depth": [0], "frame": [-1]}, {"depth": [], "frame": []}]
    # methods above 8000 bytes are never compiled by the JVM
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_names_and_correlations_ask_for_few_segment_facts(spark, monkeypatch):
    from queryscope.operators import rules as R, usage as U

    asked, real = [], T.statements
    monkeypatch.setattr(T, "statements", lambda tok, demand=T.ON_DEMAND: asked.append(list(demand)) or real(tok, demand))
    log = spark.createDataFrame([(1, "postgres", "SELECT s.name, s.gone FROM ships s JOIN ports p ON p.id = s.id")], "query_id long, dialect string, sql string")
    catalog = spark.createDataFrame([("ships", "name"), ("ships", "id"), ("crew", "pay")], "table_name string, column_name string")
    assert {tuple(r) for r in U.unused_catalog(log, catalog).collect()} == {("crew", "pay", True)}
    assert [tuple(r) for r in U.unknown_columns_ranked(log, catalog).select("table_name", "column_name", "queries").collect()] == [("ships", "gone", 1)]
    assert [tuple(r) for r in U.unknown_tables_ranked(log, catalog).collect()] == [("ports", 1)]
    assert {r["table_name"]: r["columns"] for r in U.column_map(log).collect()} == {"ships": "gone,id,name", "ports": "id"}
    assert asked == [[], [], [], []]
    assert set(R.read_by(R.correlation_risk())) == {"c0", "wrapped", "ops"}
