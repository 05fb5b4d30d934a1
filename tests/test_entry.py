"""The driver contract, and the plan properties the design counts on."""

import __spark_entry__ as E
from pyspark.sql import functions as F

from queryscope.plans import tokens as T
from queryscope.plans.fixtures import query_log


def test_entry_and_registry(spark):
    assert E.entry(spark).count() == 1
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) > 150


def test_two_shuffles_and_no_window_for_all_token_facts(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    texts = T.distinct_texts(T.normalise_log(query_log(orders, ["SELECT a FROM t WHERE b = {n}"])))
    plan = T.statements(T.scoped_tokens(texts))._jdf.queryExecution().executedPlan().toString()
    # one shuffle of the texts and one of their facts; the only window runs over the arms of a scope, none over tokens
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("Window [") == 1


def test_audits_never_build_a_product(spark):
    d = "/root/testdata/sf0.001"
    for name in ("a03_outer_nullify", "a06_join_fanout", "a02_not_in_trap", "c01_correlated_count_gt", "a09_update_link"):
        plan = E.queries()[name](spark, d)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name
