"""Audits and verification on the given tables."""

from pyspark.sql import functions as F

from queryscope.operators import audits as A, verify as V
from queryscope.plans.fixtures import ORDERS_GAPPY_SQL as THIN, ORDERS_N_SQL as ON, orders_gappy, orders_n
from queryscope.suite.registry import query

B = "CAST({} AS BIGINT)"


def cnt(cond=None, name=""):
    return f"CAST(count(*){f' FILTER (WHERE {cond})' if cond else ''} AS BIGINT) AS {name}"


@query(
    "a01_null_compare",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {cnt(None, 'rows_total')}, {cnt(f'{c} = NULL', 'eq_null')}, {cnt(f'{c} <> NULL', 'ne_null')}, "
        f"{cnt(f'{c} IS NULL', 'is_null')}, {cnt(f'{c} IS NOT NULL', 'is_not_null')} FROM {ON}"
        for c in ("g", "v")
    ),
)
def _(t):
    return A.null_compare(orders_n(t.orders), ["g", "v"])


def _not_in_sql(right: str) -> str:
    return f"""SELECT (SELECT count(*) FROM customer) AS left_rows,
 (SELECT count(*) FROM customer WHERE c_custkey IS NULL) AS left_null_keys,
 (SELECT count(*) FROM {right} r) AS right_rows,
 (SELECT count(*) FROM {right} r WHERE k IS NULL) AS right_null_keys,
 (SELECT count(*) FROM customer c WHERE NOT EXISTS (SELECT 1 FROM {right} r WHERE r.k = c.c_custkey)) AS not_exists_rows,
 (SELECT count(*) FROM customer c WHERE c.c_custkey NOT IN (SELECT k FROM {right} r)) AS not_in_rows"""


@query("a02_not_in_trap", _not_in_sql(f"(SELECT CASE WHEN o_orderkey % 40 < 4 THEN g ELSE -g END AS k FROM {ON})"))
def _(t):
    r = orders_n(t.orders).select(F.when(F.col("o_orderkey") % 40 < 4, F.col("g")).otherwise(-F.col("g")).alias("k"))
    return A.not_in_trap(t.customer, "c_custkey", r, "k")


@query("a02_not_in_trap_empty", _not_in_sql("(SELECT o_custkey AS k FROM orders WHERE o_totalprice < 0)"))
def _(t):
    return A.not_in_trap(t.customer, "c_custkey", t.orders.where("o_totalprice < 0").select(F.col("o_custkey").alias("k")), "k")


@query("a02_not_in_trap_clean", _not_in_sql(f"(SELECT coalesce(o_custkey, -1) AS k FROM {THIN})"))
def _(t):
    return A.not_in_trap(t.customer, "c_custkey", orders_gappy(t.orders).select(F.coalesce("o_custkey", F.lit(-1)).alias("k")), "k")


def _nullify_sql(join: str, opt: str, pred: str) -> str:
    base = f"customer c {join} JOIN {THIN} o ON c.c_custkey = o.o_custkey"
    on = f"customer c {join} JOIN {THIN} o ON c.c_custkey = o.o_custkey AND ({pred})"
    mark = f"{opt} IS NULL"
    return f"""WITH j AS (SELECT CAST(count(*) AS BIGINT) outer_rows, CAST(count(*) FILTER (WHERE {mark}) AS BIGINT) unmatched_rows,
 CAST(count(*) FILTER (WHERE {pred}) AS BIGINT) rows_in_where,
 CAST(count(*) FILTER (WHERE {mark} AND ({pred})) AS BIGINT) unmatched_kept FROM {base}),
 k AS (SELECT CAST(count(*) AS BIGINT) rows_if_in_on FROM {on})
 SELECT *, CASE WHEN unmatched_rows = 0 THEN 'no_unmatched' WHEN unmatched_kept > 0 THEN 'survives' ELSE 'filtered_out' END AS verdict FROM j, k"""


ONKEY = [("c_custkey", "o_custkey")]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("a03_outer_nullify", _nullify_sql("LEFT", "o.o_orderkey", "o.o_totalprice > 100000"))
def _(t):
    return A.outer_nullify(t.customer, orders_gappy(t.orders), ONKEY, "left", F.col("o_totalprice") > 100000)


@query(
    "a03_outer_nullify_empty",
    _nullify_sql("LEFT", "o.o_orderkey", "o.o_comment_free IS NULL").replace(THIN, f"(SELECT *, o_totalprice AS o_comment_free FROM {THIN} WHERE o_totalprice < 0)"),
)
def _(t):
    o = orders_gappy(t.orders).where("o_totalprice < 0").withColumn("o_comment_free", F.col("o_totalprice"))
    return A.outer_nullify(t.customer, o, ONKEY, "left", F.col("o_comment_free").isNull())


@query("a03_outer_nullify_guarded", _nullify_sql("LEFT", "o.o_orderkey", "COALESCE(o.o_orderstatus, 'none') <> 'F'"))
def _(t):
    return A.outer_nullify(t.customer, orders_gappy(t.orders), ONKEY, "left", F.coalesce("o_orderstatus", F.lit("none")) != "F")


@query("a03_outer_nullify_full", _nullify_sql("FULL", "o.o_orderkey", "o.o_totalprice > 100000"))
def _(t):
    return A.outer_nullify(t.customer, orders_gappy(t.orders), ONKEY, "full", F.col("o_totalprice") > 100000)


@query(
    "a03_outer_nullify_right",
    f"""WITH j AS (SELECT CAST(count(*) AS BIGINT) outer_rows, CAST(count(*) FILTER (WHERE o.o_orderkey IS NULL) AS BIGINT) unmatched_rows,
 CAST(count(*) FILTER (WHERE o.o_totalprice > 100000) AS BIGINT) rows_in_where,
 CAST(count(*) FILTER (WHERE o.o_orderkey IS NULL AND o.o_totalprice > 100000) AS BIGINT) unmatched_kept
 FROM {THIN} o RIGHT JOIN customer c ON c.c_custkey = o.o_custkey),
 k AS (SELECT CAST(count(*) AS BIGINT) rows_if_in_on FROM {THIN} o RIGHT JOIN customer c ON c.c_custkey = o.o_custkey AND o.o_totalprice > 100000)
 SELECT *, CASE WHEN unmatched_rows = 0 THEN 'no_unmatched' WHEN unmatched_kept > 0 THEN 'survives' ELSE 'filtered_out' END AS verdict FROM j, k""",
)
def _(t):
    return A.outer_nullify(orders_gappy(t.orders), t.customer, [("o_custkey", "c_custkey")], "right", F.col("o_totalprice") > 100000)


@query(
    "a04_coalesce_match",
    f"""SELECT {cnt(None, 'rows_total')}, {cnt('v = w', 'plain_eq')}, {cnt('v IS NOT DISTINCT FROM w', 'null_safe_eq')},
 {cnt('COALESCE(v, 0) = COALESCE(w, 0)', 'coalesce_eq')}, {cnt('v IS NULL AND w IS NULL', 'both_null')},
 {cnt('COALESCE(v, 0) = COALESCE(w, 0) AND (v IS NULL) <> (w IS NULL)', 'sentinel_collisions')}
 FROM (SELECT v, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_custkey % 20 AS INTEGER) END AS w FROM {ON})""",
)
def _(t):
    d = orders_n(t.orders).withColumn("w", F.when(F.col("g").isNotNull(), (F.col("g") % 20).cast("int")))
    return A.coalesce_match(d, "v", "w", 0)


@query(
    "a05_between_dates",
    """SELECT CAST(count(*) FILTER (WHERE ts <= TIMESTAMP '2024-01-06') AS BIGINT) AS between_rows, CAST(count(*) AS BIGINT) AS half_open_rows,
 CAST(count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-06') AS BIGINT) AS lost_rows,
 COALESCE(bool_or(ts <> date_trunc('day', ts)), FALSE) AS has_time_part
 FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-07'""",
)
def _(t):
    return A.between_dates(t.events, "ts", "2024-01-05", "2024-01-06")


@query(
    "a06_join_fanout",
    """WITH l AS (SELECT l_orderkey k, count(*) n FROM lineitem GROUP BY 1), r AS (SELECT o_orderkey k, count(*) n FROM orders GROUP BY 1),
 p AS (SELECT l.n * r.n AS p FROM l JOIN r USING (k))
 SELECT CAST((SELECT count(*) FROM lineitem) AS VARCHAR) AS left_rows, CAST((SELECT count(*) FROM orders) AS VARCHAR) AS right_rows,
 CAST((SELECT count(*) FROM lineitem) * (SELECT count(*) FROM orders) AS VARCHAR) AS cartesian_rows,
 CAST((SELECT CAST(sum(p) AS BIGINT) FROM p) AS VARCHAR) AS equi_rows, CAST((SELECT count(*) FROM p) AS VARCHAR) AS matched_keys,
 CAST((SELECT max(p) FROM p) AS VARCHAR) AS hottest_key_rows""",
)
def _(t):
    return A.join_fanout(t.lineitem, t.orders, [("l_orderkey", "o_orderkey")])


@query(
    "a06_hottest_keys",
    """WITH l AS (SELECT l_partkey k, count(*) n FROM lineitem GROUP BY 1), r AS (SELECT l_partkey k, count(*) n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
 SELECT k AS k0, l.n AS left_rows, r.n AS right_rows, l.n * r.n AS joined_rows FROM l JOIN r USING (k) ORDER BY joined_rows DESC, k LIMIT 10""",
)
def _(t):
    return A.hottest_keys(t.lineitem, t.lineitem.where("l_returnflag = 'R'"), [("l_partkey", "l_partkey")], 10)


_MULT = """WITH m AS (SELECT count(*) FILTER (WHERE {mark} IS NOT NULL) AS m FROM {l} l LEFT JOIN {r} r ON {on} GROUP BY l.{id})
 SELECT CAST(count(*) AS BIGINT) AS left_rows, CAST(count(*) FILTER (WHERE m = 0) AS BIGINT) AS no_match, CAST(count(*) FILTER (WHERE m = 1) AS BIGINT) AS one_match,
 CAST(count(*) FILTER (WHERE m > 1) AS BIGINT) AS many_matches, CAST(COALESCE(max(m), 0) AS BIGINT) AS max_matches,
 count(*) FILTER (WHERE m <> 1) = 0 AS inner_join_removable, count(*) FILTER (WHERE m > 1) = 0 AS left_join_removable FROM m"""


@query(
    "a07_join_multiplicity",
    _MULT.format(mark="r.o_orderkey", l="customer", r=THIN, on="l.c_custkey = r.o_custkey", id="c_custkey"),
)
def _(t):
    return A.join_multiplicity(t.customer, orders_gappy(t.orders), ONKEY)


@query(
    "a07_join_multiplicity_removable",
    _MULT.format(mark="r.c_custkey", l="orders", r="customer", on="l.o_custkey = r.c_custkey", id="o_orderkey"),
)
def _(t):
    return A.join_multiplicity(t.orders, t.customer, [("o_custkey", "c_custkey")])


@query(
    "a08_scalar_multi",
    f"""WITH i AS (SELECT o_custkey k, count(*) n, arg_min(o_orderkey, (o_orderdate, o_orderkey)) p FROM {THIN} GROUP BY 1),
 o AS (SELECT c_custkey k, count(*) n FROM customer GROUP BY 1)
 SELECT k AS k0, o.n AS outer_rows, i.n AS inner_rows, p AS first_pick FROM o JOIN i USING (k) WHERE i.n > 1""",
)
def _(t):
    return A.scalar_multi(t.customer, orders_gappy(t.orders), ONKEY, "o_orderkey", ["o_orderdate", "o_orderkey"])


@query(
    "a09_update_link",
    f"""WITH m AS (SELECT c.c_custkey, count(o.o_orderkey) m FROM customer c LEFT JOIN {THIN} o ON c.c_custkey = o.o_custkey GROUP BY 1)
 SELECT CAST(count(*) AS BIGINT) AS target_rows, CAST(count(*) FILTER (WHERE m = 0) AS BIGINT) AS untouched_rows,
 CAST(count(*) FILTER (WHERE m = 1) AS BIGINT) AS updated_once, CAST(count(*) FILTER (WHERE m > 1) AS BIGINT) AS ambiguous_rows,
 (SELECT count(*) FROM {THIN}) AS source_rows, CAST(count(*) * (SELECT count(*) FROM {THIN}) AS VARCHAR) AS unlinked_pairs FROM m""",
)
def _(t):
    return A.update_link(t.customer, orders_gappy(t.orders), ONKEY)


@query(
    "a10_dml_blast",
    """SELECT CAST(count(*) AS BIGINT) AS rows_without_where, CAST(count(*) FILTER (WHERE l_shipdate < TIMESTAMP '1996-01-01') AS BIGINT) AS rows_with_where,
 round(count(*) FILTER (WHERE l_shipdate < TIMESTAMP '1996-01-01') * 100.0::DOUBLE / count(*), 4) AS share_pct FROM lineitem""",
)
def _(t):
    return A.dml_blast(t.lineitem, F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp"))


@query(
    "a11_boundary_ties",
    """WITH top AS (SELECT o_orderdate d FROM orders ORDER BY 1 DESC LIMIT 30), top0 AS (SELECT o_orderdate d FROM orders ORDER BY 1 DESC LIMIT 10),
 x AS (SELECT (SELECT count(*) FROM top WHERE d = (SELECT min(d) FROM top)) AS end_ties_inside,
 (SELECT count(*) FROM orders WHERE o_orderdate = (SELECT min(d) FROM top)) AS end_ties_total,
 (SELECT count(*) FROM top0 WHERE d = (SELECT min(d) FROM top0)) AS start_ties_inside,
 (SELECT count(*) FROM orders WHERE o_orderdate = (SELECT min(d) FROM top0)) AS start_ties_total)
 SELECT *, end_ties_inside = end_ties_total AND start_ties_inside = start_ties_total AS deterministic FROM x""",
)
def _(t):
    return A.boundary_ties(t.orders, [("o_orderdate", False)], 20, 10)


@query(
    "a12_window_ties",
    """WITH g AS (SELECT o_custkey, o_orderdate, count(*) n FROM orders GROUP BY 1, 2),
 p AS (SELECT o_custkey, sum(n) AS r, sum(n) FILTER (WHERE n > 1) AS ti, count(*) FILTER (WHERE n > 1) AS gr FROM g GROUP BY 1)
 SELECT CAST(sum(r) AS BIGINT) AS rows_total, CAST(COALESCE(sum(ti), 0) AS BIGINT) AS tied_rows, CAST(sum(gr) AS BIGINT) AS tied_groups,
 CAST(count(*) FILTER (WHERE gr > 0) AS BIGINT) AS unstable_partitions FROM p""",
)
def _(t):
    return A.window_ties(t.orders, ["o_custkey"], ["o_orderdate"])


def _dep_sql(table, keys, cols):
    gb = f"GROUP BY {keys}" if keys else ""
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, CAST(count(*) AS BIGINT) AS groups_total, CAST(count(*) FILTER (WHERE d + z > 1) AS BIGINT) AS groups_varying,
 count(*) FILTER (WHERE d + z > 1) = 0 AS dependent FROM (SELECT count(DISTINCT {c}) d, CASE WHEN count({c}) < count(*) THEN 1 ELSE 0 END z FROM {table} {gb})"""
        for c in cols
    )


@query("a13_group_dependency", _dep_sql(ON, "o_custkey", ["o_custkey", "o_orderstatus", "g", "v"]))
def _(t):
    return A.group_dependency(orders_n(t.orders), ["o_custkey"], ["o_custkey", "o_orderstatus", "g", "v"])


@query("a13_group_dependency_global", _dep_sql("lineitem", "", ["l_returnflag", "l_linenumber"]))
def _(t):
    return A.group_dependency(t.lineitem, [], ["l_returnflag", "l_linenumber"])


@query(
    "a14_case_coverage",
    f"""WITH b AS (SELECT COALESCE(v >= 15, FALSE) a, COALESCE(v >= 8, FALSE) m, COALESCE(o_orderstatus = 'F', FALSE) f FROM {ON})
 SELECT 'large' AS branch, {cnt('a', 'rows')} FROM b UNION ALL SELECT 'medium', {cnt('NOT a AND m', 'r')} FROM b
 UNION ALL SELECT 'finished', {cnt('NOT a AND NOT m AND f', 'r')} FROM b UNION ALL SELECT '(none)', {cnt('NOT a AND NOT m AND NOT f', 'r')} FROM b
 UNION ALL SELECT '(several)', {cnt('a::INT + m::INT + f::INT > 1', 'r')} FROM b""",
)
def _(t):
    v = F.col("v")
    return A.case_coverage(orders_n(t.orders), {"large": v >= 15, "medium": v >= 8, "finished": F.col("o_orderstatus") == "F"})


@query(
    "a15_having_vs_where",
    """WITH h AS (SELECT l_returnflag, l_suppkey, count(*) n, sum(CAST(l_extendedprice AS DECIMAL(18, 2))) s FROM lineitem GROUP BY 1, 2 HAVING l_returnflag = 'R'),
 w AS (SELECT l_returnflag, l_suppkey, count(*) n, sum(CAST(l_extendedprice AS DECIMAL(18, 2))) s FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
 SELECT (SELECT count(*) FROM lineitem) AS rows_into_having, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS rows_into_where,
 (SELECT count(*) FROM (SELECT l_returnflag, l_suppkey FROM lineitem GROUP BY 1, 2 HAVING l_returnflag = 'R')) AS groups_kept,
 CASE WHEN EXISTS ((SELECT * FROM h) EXCEPT ALL (SELECT * FROM w)) OR EXISTS ((SELECT * FROM w) EXCEPT ALL (SELECT * FROM h)) THEN 'different' ELSE 'equivalent' END AS verdict""",
)
def _(t):
    return A.having_vs_where(t.lineitem, ["l_returnflag", "l_suppkey"], "l_extendedprice", F.col("l_returnflag") == "R")


@query(
    "a16_distinct_over_group",
    """WITH g AS (SELECT count(*) n FROM orders GROUP BY o_custkey)
 SELECT CAST((SELECT count(*) FROM g) AS BIGINT) AS rows_before, (SELECT count(*) FROM (SELECT DISTINCT n FROM g)) AS rows_after,
 (SELECT count(*) FROM g) - (SELECT count(*) FROM (SELECT DISTINCT n FROM g)) AS rows_saved""",
)
def _(t):
    return A.distinct_over_group(t.orders, ["o_custkey"], [F.count("*").alias("n")])


@query(
    "a16_distinct_over_group_noop",
    """WITH g AS (SELECT o_custkey k, count(*) n FROM orders GROUP BY o_custkey) SELECT count(*) AS rows_before, count(*) AS rows_after, CAST(0 AS BIGINT) AS rows_saved FROM g""",
)
def _(t):
    return A.distinct_over_group(t.orders, ["o_custkey"], [F.first("o_custkey").alias("k"), F.count("*").alias("n")])


@query(
    "a17_union_dups",
    """WITH a AS (SELECT o_custkey k, o_orderstatus s FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'), b AS (SELECT o_custkey k, o_orderstatus s FROM orders WHERE o_totalprice > 200000),
 g AS (SELECT k, s, sum(x) na, sum(y) nb FROM (SELECT k, s, 1 x, 0 y FROM a UNION ALL SELECT k, s, 0, 1 FROM b) GROUP BY 1, 2)
 SELECT CAST(sum(na + nb) AS BIGINT) AS union_all_rows, CAST(count(*) AS BIGINT) AS union_rows,
 CAST(sum(greatest(na - 1, 0) + greatest(nb - 1, 0)) AS BIGINT) AS dups_within_side, CAST(count(*) FILTER (WHERE na > 0 AND nb > 0) AS BIGINT) AS rows_in_both FROM g""",
)
def _(t):
    a = t.orders.where(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")).select("o_custkey", "o_orderstatus")
    b = t.orders.where("o_totalprice > 200000").select("o_custkey", "o_orderstatus")
    return A.union_dups(a, b)


_PATS = ["small%", "%ring", "%a%", "s_all%"]


@query(
    "a18_like_selectivity",
    " UNION ALL ".join(
        f"SELECT '{p}' AS pattern, '{c}' AS class, CAST(count(*) FILTER (WHERE p_name LIKE '{p}') AS BIGINT) AS matched_rows, CAST(count(*) AS BIGINT) AS rows_total FROM part"
        for p, c in zip(_PATS, ["prefix", "suffix", "contains", "prefix"])
    ),
)
def _(t):
    return A.like_selectivity(t.part, "p_name", _PATS)


@query(
    "a19_column_cost",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {u} AS used, CAST(COALESCE(sum({w}), 0) AS BIGINT) AS bytes FROM orders"
        for c, u, w in [
            ("o_orderkey", "TRUE", "8"), ("o_custkey", "FALSE", "8"), ("o_orderstatus", "FALSE", "octet_length(encode(o_orderstatus))"),
            ("o_totalprice", "TRUE", "8"), ("o_orderdate", "FALSE", "8"), ("o_orderpriority", "FALSE", "octet_length(encode(o_orderpriority))"),
        ]
    ),
)
def _(t):
    return A.column_cost(t.orders, ["o_orderkey", "o_totalprice"])


@query(
    "a20_sargable_check",
    """WITH b AS (SELECT CAST(ts AS DATE) = DATE '2024-01-05' AS w, ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-06' - INTERVAL 1 SECOND AS r FROM events)
 SELECT CAST(count(*) FILTER (WHERE w) AS BIGINT) AS wrapped_rows, CAST(count(*) FILTER (WHERE r) AS BIGINT) AS raw_rows,
 CAST(count(*) FILTER (WHERE w AND NOT r) AS BIGINT) AS only_wrapped, CAST(count(*) FILTER (WHERE r AND NOT w) AS BIGINT) AS only_raw,
 count(*) FILTER (WHERE w <> r) = 0 AS same_rows FROM b""",
)
def _(t):
    ts = F.col("ts")
    day = lambda s: F.lit(s).cast("timestamp")
    return A.sargable_check(
        t.events,
        F.to_date(ts) == F.lit("2024-01-05").cast("date"),
        (ts >= day("2024-01-05")) & (ts <= day("2024-01-06") - F.expr("INTERVAL 1 SECOND")),
    )


@query(
    "a21_append_check",
    """SELECT 'o_orderkey' AS target_column, 'o_custkey' AS filled_from, CAST(count(*) FILTER (WHERE o_custkey IS DISTINCT FROM o_orderkey) AS BIGINT) AS corrupted_rows, CAST(count(*) AS BIGINT) AS source_rows FROM orders
 UNION ALL SELECT 'o_custkey', 'o_orderkey', CAST(count(*) FILTER (WHERE o_custkey IS DISTINCT FROM o_orderkey) AS BIGINT), CAST(count(*) AS BIGINT) FROM orders
 UNION ALL SELECT 'o_orderstatus', 'o_orderstatus', CAST(0 AS BIGINT), CAST(count(*) AS BIGINT) FROM orders""",
)
def _(t):
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    return A.append_check(o, o.select("o_custkey", "o_orderkey", "o_orderstatus"))


@query(
    "a22_ambiguous_columns",
    """SELECT 'text' AS column_name, 'benchmark,conversations,documents' AS tables, CAST(3 AS BIGINT) AS table_count,
 CAST((SELECT count(text) FROM benchmark) + (SELECT count(text) FROM conversations) + (SELECT count(text) FROM documents) AS BIGINT) AS filled_rows
 UNION ALL SELECT 'doc_id', 'documents,labels', CAST(2 AS BIGINT), (SELECT count(doc_id) FROM documents) + (SELECT count(doc_id) FROM labels)""",
)
def _(t):
    return A.ambiguous_columns({n: getattr(t, n) for n in TABLES})


@query(
    "a23_resolve_ordinals",
    """SELECT o_custkey, count(*) AS n_orders, max(o_totalprice) AS top_price FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100""",
)
def _(t):
    d = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.max("o_totalprice").alias("top_price"))
    return d.orderBy(*A.resolve_ordinals(d.columns, [(2, False), 1])).limit(100)


@query(
    "a24_inner_sort_noop",
    """WITH a AS (SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem), b AS (SELECT * FROM a ORDER BY l_shipdate),
 x AS (SELECT count(*) AS n FROM ((SELECT * FROM a) EXCEPT ALL (SELECT * FROM b))), y AS (SELECT count(*) AS n FROM ((SELECT * FROM b) EXCEPT ALL (SELECT * FROM a)))
 SELECT CASE WHEN x.n + y.n = 0 THEN 'equivalent' ELSE 'different' END AS verdict, CAST(x.n AS BIGINT) AS extra_in_a, CAST(y.n AS BIGINT) AS extra_in_b FROM x, y""",
)
def _(t):
    return A.inner_sort_noop(t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate"), ["l_shipdate"])


_STATUS = "SELECT o_custkey, o_orderstatus FROM orders"


@query(
    "v01_verify_equal",
    """WITH d AS (SELECT o_custkey, o_orderstatus, sum(w) delta FROM (SELECT o_custkey, o_orderstatus, 1 w FROM orders
 UNION ALL SELECT o_custkey, o_orderstatus, -1 FROM orders WHERE o_orderkey % 9 <> 0) GROUP BY 1, 2 HAVING sum(w) <> 0)
 SELECT CASE WHEN count(*) = 0 THEN 'equivalent' ELSE 'different' END AS verdict, CAST(COALESCE(sum(delta) FILTER (WHERE delta > 0), 0) AS BIGINT) AS extra_in_a,
 CAST(COALESCE(-sum(delta) FILTER (WHERE delta < 0), 0) AS BIGINT) AS extra_in_b FROM d""",
)
def _(t):
    a = t.orders.select("o_custkey", "o_orderstatus")
    return V.verify_equal(a, t.orders.where("o_orderkey % 9 <> 0").select("o_custkey", "o_orderstatus"))


@query(
    "v02_row_delta",
    f"""SELECT c1, c2, CAST(sum(w) AS BIGINT) AS delta FROM (SELECT g AS c1, o_orderstatus AS c2, 1 w FROM {ON}
 UNION ALL SELECT o_custkey, o_orderstatus, -1 FROM orders) GROUP BY 1, 2 HAVING sum(w) <> 0""",
)
def _(t):
    return V.row_delta(orders_n(t.orders).select("g", "o_orderstatus"), t.orders.select("o_custkey", "o_orderstatus"))


def _same_sql(a: str, b: str) -> str:
    return f"NOT EXISTS (({a}) EXCEPT ALL ({b})) AND NOT EXISTS (({b}) EXCEPT ALL ({a}))"


_KEYS = ("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)", "SELECT DISTINCT o_custkey FROM orders")
_GAPS = ("SELECT o_custkey FROM orders", f"SELECT o_custkey FROM {THIN}")


@query(
    "v03_verdict",
    f"""WITH v AS (SELECT 'customer_vs_orders_keys' AS pair, {_same_sql(*_KEYS)} AS same UNION ALL SELECT 'gappy_vs_all', {_same_sql(*_GAPS)}
 UNION ALL SELECT 'type_mismatch', NULL)
 SELECT pair, CASE WHEN same IS NULL THEN 'inconclusive' WHEN same THEN 'equivalent' ELSE 'different' END AS verdict, coalesce(NOT same, FALSE) AS may_suppress FROM v""",
)
def _(t):
    ok = t.orders.select("o_custkey").distinct()
    rows = [
        ("customer_vs_orders_keys", V.verdict(t.customer.join(ok, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey"), ok)),
        ("type_mismatch", V.verdict(t.customer.select("c_custkey"), t.customer.select("c_name"))),
        ("gappy_vs_all", V.verdict(t.orders.select("o_custkey"), orders_gappy(t.orders).select("o_custkey"))),
    ]
    out = None
    for n, d in rows:
        d = d.withColumn("pair", F.lit(n))
        out = d if out is None else out.unionByName(d)
    return out


@query(
    "v05_survives_unmatched",
    """WITH j AS (SELECT o_totalprice, o_orderstatus FROM customer LEFT JOIN (SELECT * FROM orders WHERE FALSE) o ON c_custkey = o_custkey),
 n AS (SELECT 'plain' AS predicate, count(*) AS unmatched_rows, count(*) FILTER (WHERE o_totalprice > 100) AS surviving_rows FROM j
 UNION ALL SELECT 'guarded', count(*), count(*) FILTER (WHERE COALESCE(o_orderstatus, 'none') <> 'cancelled') FROM j)
 SELECT *, CASE WHEN surviving_rows > 0 THEN 'survives' ELSE 'filtered_out' END AS verdict FROM n""",
)
def _(t):
    o = t.orders
    plain = V.survives_unmatched(t.customer, o, ONKEY, F.col("o_totalprice") > 100)
    safe = V.survives_unmatched(t.customer, o, ONKEY, F.coalesce("o_orderstatus", F.lit("none")) != "cancelled")
    return plain.withColumn("predicate", F.lit("plain")).unionByName(safe.withColumn("predicate", F.lit("guarded")))
