"""Every rule fires on its texts and stays silent on the clean ones; hints, validity and rewrite risk."""

import pytest
from pyspark.sql import functions as F

from queryscope.operators import findings as FI, rules as R
from queryscope.plans import tokens as T
from queryscope.suite import golden as G
from queryscope.suite.lint import golden_catalog


def _log(spark, texts, dialects=None):
    rows = [(i, s.replace("{n}", "7"), dialects[i] if dialects else "bigquery") for i, s in enumerate(texts)]
    return spark.createDataFrame(rows, "query_id long, sql string, dialect string")


def _titles(spark, texts, catalog=None, titles=None):
    out = {i: set() for i in range(len(texts))}
    for r in FI.lint_findings(_log(spark, texts), titles, catalog).collect():
        out[r["query_id"]].add(r["title"])
    return out


def test_golden_pairs_upper_and_lower_case(spark):
    pairs = [(r, s, t) for r, l in G.GOLDEN.items() for s, t in l]
    texts = [s for _, s, _ in pairs] + [s.lower() for _, s, _ in pairs]
    got = _titles(spark, texts)
    for i, (rule, sql, want) in enumerate(pairs + pairs):
        assert got[i] & set(R.titles_of(rule)) == set(want), (rule, texts[i])


def test_catalog_rules(spark):
    pairs = [(r, s, t) for r, l in G.GOLDEN_CATALOG.items() for s, t in l]
    got = _titles(spark, [s for _, s, _ in pairs], golden_catalog(spark), ["Unknown table", "Unknown column"])
    for i, (rule, sql, want) in enumerate(pairs):
        assert got[i] & set(R.titles_of(rule)) == set(want), sql


def test_validity_battery_and_hints(spark):
    texts = [s for _, s, _, _ in G.INVALID] + [s for _, s in G.VALID]
    log = T.normalise_log(_log(spark, texts, [d for d, *_ in G.INVALID] + [d for d, _ in G.VALID]))
    tx = T.distinct_texts(log)
    v = R.validity(tx)
    got = {r["query_id"]: (r["valid"], r["kind"], r["hint_kind"]) for r in log.join(v.select("tid", "valid", "kind"), "tid").join(
        R.hints(tx, v).select("tid", "hint_kind"), "tid", "left").collect()}
    for i, (_, s, kind, hint) in enumerate(G.INVALID):
        assert got[i] == (kind is None, kind, hint), s
    for i in range(len(G.INVALID), len(texts)):
        assert got[i][0], texts[i]


def test_message_quotes_detail_and_line(spark):
    f = FI.lint_findings(_log(spark, ["SELECT id,\n  name amount\nFROM t"]), ["Possible missing comma"]).first()
    assert "line 2: `name` → `amount`" in f["message"]


def test_own_rule(spark):
    R.register_rule("No table t", "low", "avoid %s", "if(exists(tabs, x -> x.name = 't'), 't', NULL)")
    try:
        f = FI.lint_findings(_log(spark, ["SELECT a FROM t", "SELECT a FROM s"]), ["No table t"]).collect()
    finally:
        R.unregister_rule("No table t")
    assert [(r["query_id"], r["severity"], r["message"]) for r in f] == [(0, "low", "avoid t")]


def test_long_text_and_many_quotes(spark):
    sql = "SELECT '" + "''" * 20000 + "' AS a FROM t WHERE b IN (" + ", ".join(["1"] * 5000) + ")"
    assert _titles(spark, [sql, "SELECT * FROM t"], titles=["SELECT * used"]) == {0: set(), 1: {"SELECT * used"}}
