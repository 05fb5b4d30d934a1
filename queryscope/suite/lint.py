"""Lint rules over a query log made of all orders."""

from pyspark.sql import functions as F

from queryscope.operators import rules as R
from queryscope.operators.findings import lint_findings
from queryscope.operators.usage import portability
from queryscope.plans import tokens as T
from queryscope.plans.fixtures import query_log
from queryscope.suite.golden import DECORRELATION, GOLDEN, GOLDEN_CATALOG, INVALID, SCHEMA
from queryscope.suite.registry import query
from queryscope.suite.sqltext import expect_sql, values_sql

NAMES = {
    "L01": "dml_no_where", "L02": "cross_join", "L03": "join_no_condition", "L04": "select_star", "L05": "limit_no_order",
    "L06": "leading_wildcard", "L07": "not_in_subquery", "L08": "function_on_column", "L09": "union_distinct",
    "L10": "having_no_aggregate", "L11": "missing_group_key", "L12": "inner_order_by", "L13": "case_no_else",
    "L14": "join_tautology", "L15": "coalesce_equality", "L16": "window_no_order", "L17": "insert_no_columns",
    "L18": "outer_join_nullified", "L19": "between_dates", "L20": "order_by_ordinal", "L21": "scalar_subquery",
    "L22": "update_from_unlinked", "L23": "mixed_aggregate", "L24": "aggregate_of_window", "L25": "null_equality",
    "L26": "offset_no_order", "L27": "mixed_ordinals", "L28": "distinct_group_by", "L29": "unused_cte",
    "L30": "unused_join", "L31": "unqualified_column", "L32": "alias_in_own_over", "L33": "self_join_alias",
    "L34": "leaked_alias", "L35": "missing_comma", "L36": "unknown_table", "L37": "unknown_column",
}


def golden_catalog(spark):
    rows = [(t, c, i) for t, cols in SCHEMA.items() for i, c in enumerate(cols, 1)]
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal int")


def _rule(rule: str, pairs, with_catalog: bool):
    @query(f"{rule.lower()}_{NAMES[rule]}", expect_sql(pairs))
    def _(t):
        log = query_log(t.orders, [s for s, _ in pairs])
        cat = golden_catalog(t.spark) if with_catalog else None
        return lint_findings(log, R.titles_of(rule), cat).select("query_id", "title")


for _r, _p in GOLDEN.items():
    _rule(_r, _p, False)
for _r, _p in GOLDEN_CATALOG.items():
    _rule(_r, _p, True)


def _keyed(t, texts, dialect="bigquery"):
    keyed = T.normalise_log(query_log(t.orders, texts, dialect))
    return keyed.select("query_id", "tid"), T.distinct_texts(keyed)


_BAD = [s for _, s, _, _ in INVALID]


def _bad(t):
    """Fault texts of the log, each in its own dialect."""
    names = F.array(*[F.lit(d) for d, _, _, _ in INVALID])
    log = query_log(t.orders, _BAD).withColumn("dialect", F.get(names, F.pmod("query_id", F.lit(len(_BAD))).cast("int")))
    keyed = T.normalise_log(log)
    return keyed.select("query_id", "tid"), T.distinct_texts(keyed)


def _hint_query(name: str, kind: str):
    @query(name, values_sql([(i, h) for i, (_, _, _, h) in enumerate(INVALID) if h == kind], ["hint_kind"], len(INVALID)))
    def _(t):
        ids, texts = _bad(t)
        h = R.hints(texts, R.validity(texts)).where(F.col("hint_kind") == kind)
        return ids.join(h, "tid").select("query_id", "hint_kind")


_hint_query("l38_typo_hint", "typo")
_hint_query("l39_parenthesis_hint", "parentheses")
_hint_query("l40_adjacent_hint", "adjacent")


@query("l41_validity", values_sql([(i, k is None, k) for i, (_, _, k, _) in enumerate(INVALID)], ["valid", "kind"], len(INVALID), {"kind": "VARCHAR"}))
def _(t):
    ids, texts = _bad(t)
    return ids.join(R.validity(texts), "tid").select("query_id", "valid", "kind")


#: what the automaton rejects, and texts that only look alike; None: valid
_GRAMMAR = [
    ("SELECT tide FROM harbour WHERE berth = = {n}", "missing operand"),
    ("SELECT tide FROM harbour WHERE berth IN ()  AND depth = {n}", "empty list"),
    ("SELECT CASE WHEN berth = {n} THEN 'x' FROM harbour", "CASE without END"),
    ("SELECT CASE WHEN berth = {n} THEN 'x' ELSE 'y' END FROM harbour", None),
    ("SELECT tide FROM harbour WHERE berth = {n} ORDER BY", "empty list"),
    ("SELECT tide FROM harbour WHERE berth = {n} LIMIT", "missing operand"),
    ("UPDATE harbour SET WHERE berth = {n}", "empty list"),
    ("SELECT h.tide FROM harbour h JOIN fleet f ON WHERE f.berth = {n}", "empty condition"),
    ("SELECT tide FROM harbour WHERE berth BETWEEN {n}", "BETWEEN without AND"),
    ("SELECT tide FROM harbour WHERE berth BETWEEN {n} AND 9 AND lit IS DISTINCT FROM depth", None),
    ("SELECT tide || FROM harbour WHERE berth = {n}", "missing operand"),
    ("SELECT count(*), -depth, h.* FROM harbour h WHERE berth IN (SELECT 1) AND NOT (depth = {n})", None),
]


@query("l41_grammar", values_sql([(i, k is None, k) for i, (_, k) in enumerate(_GRAMMAR)], ["valid", "kind"], len(_GRAMMAR), {"kind": "VARCHAR"}))
def _(t):
    ids, texts = _keyed(t, [s for s, _ in _GRAMMAR])
    return ids.join(R.validity(texts), "tid").select("query_id", "valid", "kind")


@query("l42_decorrelation_risk", values_sql([(i, r) for i, (_, r) in enumerate(DECORRELATION)], ["risk"], len(DECORRELATION)))
def _(t):
    ids, texts = _keyed(t, [s for s, _ in DECORRELATION])
    st = T.statements(T.whole(texts), R.read_by(R.correlation_risk()), R.read_columns(R.correlation_risk()))
    risk = st.groupBy("tid").agg(F.expr(f"bool_or({R.correlation_risk()}) AS risk"))
    return ids.join(risk, "tid").select("query_id", "risk")


#: dialect, text, (function, function in bigquery, action)
_PORT = [
    ("postgres", "SELECT TO_CHAR(a, 'YYYY-MM'), COALESCE(b, {n}) FROM t", [("TO_CHAR", "FORMAT_DATE", "review format"), ("COALESCE", "IFNULL", "rename")]),
    ("mysql", "SELECT IFNULL(a, 0), DATE_FORMAT(d, '%Y-%m'), GROUP_CONCAT(tag) FROM t WHERE k = {n} GROUP BY a, d",
     [("IFNULL", "IFNULL", "same"), ("DATE_FORMAT", "FORMAT_DATE", "review format"), ("GROUP_CONCAT", "STRING_AGG", "rename")]),
    ("tsql", "SELECT TOP 10 ISNULL(a, 0) FROM t WHERE k = {n} ORDER BY a", [("ISNULL", "IFNULL", "rename"), ("TOP", "LIMIT", "rename")]),
    ("snowflake", "SELECT IFF(a > 0, 'pos', 'neg') FROM t WHERE k = {n}", [("IFF", "IF", "rename")]),
    ("spark", "SELECT collect_list(x) FROM t WHERE k = {n} GROUP BY d", [("COLLECT_LIST", "ARRAY_AGG", "rename")]),
]


@query("l43_portability", values_sql([(i, *f) for i, (_, _, fs) in enumerate(_PORT) for f in fs], ["function", "target_function", "action"], len(_PORT)))
def _(t):
    log = query_log(t.orders, [s for _, s, _ in _PORT])
    names = F.array(*[F.lit(d) for d, _, _ in _PORT])
    log = log.withColumn("dialect", F.get(names, F.pmod("query_id", F.lit(len(_PORT))).cast("int")))
    return portability(log, "bigquery")
