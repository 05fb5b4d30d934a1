"""Every operator has one query, and SQL agrees where there is any."""

import duckdb

import __spark_entry__ as E

SMALL = "/root/testdata/sf0.001"
TABLES = ["documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def test_names():
    names = [n for n in E.queries() if n.startswith("op") and n.split("_")[0][2:].isdigit()]
    assert sorted(int(n.split("_")[0][2:]) for n in names) == list(range(1, 14)) and "pipeline" in E.queries()


def test_native_plan(spark):
    plan = E.queries()["op1_url_filter"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_oracles(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    for name in ("op4_lattice_dedup", "op5_decontaminate", "op8_minhash_dedup", "op11_prefix_trie", "op12_source_mixing", "op13_conversation_repair"):
        frame = E.queries()[name](spark, SMALL)
        cursor = con.execute(E.oracle_sql()[name])
        names = [c[0] for c in cursor.description]
        assert sorted(names) == sorted(frame.columns)
        assert sorted(cursor.fetchall(), key=repr) == sorted((tuple(r) for r in frame.select(*names).collect()), key=repr), name


def test_task_gives_back_what_it_held(monkeypatch):
    """When the memory of a worker is returned, the task's own objects are gone already."""
    import weakref

    from queryscope.llm import common

    class Held(list):
        pass

    seen = []

    def run(batches):
        held = Held(batches)
        seen.append(weakref.ref(held))
        yield from held

    monkeypatch.setattr(common, "give_back", lambda: seen.append(seen[0]() is None))
    assert list(common.lean(run)(iter([1, 2]))) == [1, 2] and seen[1:] == [True]
