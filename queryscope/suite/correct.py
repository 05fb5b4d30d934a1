"""The correct forms on the given tables."""

from pyspark.sql import functions as F

from queryscope.functions import scalars as S
from queryscope.operators import correct as C
from queryscope.plans.fixtures import ORDERS_GAPPY_SQL as THIN, ORDERS_N_SQL as ON, orders_gappy, orders_n
from queryscope.suite.registry import query

M = "decimal(18,2)"


def corr_sql(op: str, expr: str, kind: str) -> str:
    """Pre-aggregated form of the correlated subquery, window-free: exact and fast in DuckDB."""
    return f"""WITH o AS (SELECT o_orderkey, g, v, CAST(o_totalprice AS DECIMAL(18,2)) AS p FROM {ON}),
 d AS (SELECT g, v, count(*) c, sum(p) s, min(p) lo, max(p) hi FROM o WHERE g IS NOT NULL AND v IS NOT NULL GROUP BY 1, 2),
 r AS (SELECT a.g, a.v, {expr} AS r FROM d a LEFT JOIN d b ON a.g = b.g AND b.v {op} a.v GROUP BY 1, 2)
 SELECT o.o_orderkey, {kind} AS result FROM o LEFT JOIN r ON o.g = r.g AND o.v = r.v"""


def corr(name, op, agg, arg, expr, kind, post=lambda c: c):
    @query(name, corr_sql("<>" if op == "!=" else op, expr, kind))
    def _(t):
        o = orders_n(t.orders).select("o_orderkey", "g", "v", F.col("o_totalprice").cast(M).alias("p"))
        return C.correlated_agg(o, "g", "v", op, agg, arg).select("o_orderkey", post(F.col("result")).alias("result"))


_D = lambda c: c.cast("double")
corr("c01_correlated_count_gt", ">", "COUNT", None, "COALESCE(sum(b.c), 0)", "CAST(COALESCE(r, 0) AS BIGINT)")
corr("c01_correlated_count_lt", "<", "COUNT", None, "COALESCE(sum(b.c), 0)", "CAST(COALESCE(r, 0) AS BIGINT)")
corr("c01_correlated_count_ne", "!=", "COUNT", None, "COALESCE(sum(b.c), 0)", "CAST(COALESCE(r, 0) AS BIGINT)")
corr("c01_correlated_sum_gt", ">", "SUM", "p", "sum(b.s)", "CAST(r AS DOUBLE)", _D)
corr("c01_correlated_avg_gt", ">", "AVG", "p", "CAST(sum(b.s) AS DOUBLE) / sum(b.c)", "round(r, 4)", lambda c: F.round(c, 4))
corr("c01_correlated_min_gt", ">", "MIN", "p", "min(b.lo)", "CAST(r AS DOUBLE)", _D)
corr("c01_correlated_max_ne", "!=", "MAX", "p", "max(b.hi)", "CAST(r AS DOUBLE)", _D)


@query(
    "c02_decorrelation_check",
    f"""WITH o AS (SELECT o_orderkey, g, v FROM {ON}), d AS (SELECT g, v, count(*) c FROM o WHERE g IS NOT NULL AND v IS NOT NULL GROUP BY 1, 2),
 r AS (SELECT a.g, a.v, sum(b.c) r FROM d a JOIN d b ON a.g = b.g AND b.v > a.v GROUP BY 1, 2),
 n AS (SELECT g, count(*) n, max(v) mx FROM o WHERE g IS NOT NULL GROUP BY 1),
 j AS (SELECT COALESCE(r, 0) AS e, CASE WHEN n.mx > o.v THEN n.n ELSE 0 END AS nv FROM o LEFT JOIN r ON o.g = r.g AND o.v = r.v LEFT JOIN n ON o.g = n.g)
 SELECT count(*) AS rows_total, CAST(count(*) FILTER (WHERE e <> nv) AS BIGINT) AS rows_wrong, CAST(sum(abs(nv - e)) AS BIGINT) AS count_error FROM j""",
)
def _(t):
    return C.decorrelation_check(orders_n(t.orders), "g", "v")


@query(
    "c03_exists_greater",
    f"SELECT o_orderkey, g, v FROM (SELECT *, max(v) OVER (PARTITION BY g) AS mx FROM {ON} WHERE g IS NOT NULL) WHERE mx > v",
)
def _(t):
    return C.exists_greater(orders_n(t.orders).select("o_orderkey", "g", "v"), "g", "v")


@query(
    "c04_in_filtered",
    "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
)
def _(t):
    return C.in_filtered(t.customer.select("c_custkey", "c_name"), "c_custkey", t.orders, "o_custkey", F.col("o_totalprice") > 400000)


_LQ = "CAST(l_quantity AS INTEGER)"
_LI = f"(SELECT l_orderkey, l_linenumber, l_suppkey g, CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_partkey END k, {_LQ} q FROM lineitem)"


def _li(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", F.col("l_suppkey").alias("g"),
        F.when(F.col("l_orderkey") % 11 == 0, F.lit(None)).otherwise(F.col("l_partkey")).alias("k"),
        F.col("l_quantity").cast("int").alias("q"),
    )


@query(
    "c05_in_correlated",
    f"""WITH i AS {_LI}, m AS (SELECT g, k, max(q) mx FROM i WHERE k IS NOT NULL GROUP BY 1, 2)
 SELECT i.* FROM i JOIN m ON i.g = m.g AND i.k = m.k AND m.mx > i.q""",
)
def _(t):
    return C.in_correlated(_li(t), _li(t), "k", "g", "q")


@query(
    "c05_not_in_correlated",
    f"""WITH i AS {_LI}, m AS (SELECT g, k, max(q) mx FROM i WHERE k IS NOT NULL GROUP BY 1, 2),
 a AS (SELECT g, max(q) mx, max(q) FILTER (WHERE k IS NULL) nx FROM i GROUP BY 1)
 SELECT i.* FROM i LEFT JOIN m ON i.g = m.g AND i.k = m.k LEFT JOIN a ON i.g = a.g
 WHERE NOT COALESCE(m.mx > i.q, FALSE) AND NOT COALESCE(a.nx > i.q, FALSE) AND (i.k IS NOT NULL OR NOT COALESCE(a.mx > i.q, FALSE))""",
)
def _(t):
    return C.in_correlated(_li(t), _li(t), "k", "g", "q", negated=True)


@query(
    "c06_multi_eq_count",
    f"""WITH o AS (SELECT o_orderkey, g, o_orderstatus s FROM {ON}), c AS (SELECT g, s, count(*) n FROM o WHERE g IS NOT NULL GROUP BY 1, 2)
 SELECT o.o_orderkey, o.g, o.s, COALESCE(c.n, 0) AS n FROM o LEFT JOIN c ON o.g = c.g AND o.s = c.s""",
)
def _(t):
    o = orders_n(t.orders).select("o_orderkey", "g", F.col("o_orderstatus").alias("s"))
    return C.multi_eq_count(o, ["g", "s"])


@query("c07_not_exists", f"SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM {THIN} o WHERE o.o_custkey = c.c_custkey)")
def _(t):
    return C.not_exists(t.customer.select("c_custkey", "c_name"), orders_gappy(t.orders), [("c_custkey", "o_custkey")])


@query(
    "c08_outer_join_on",
    f"SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN {THIN} o ON c_custkey = o_custkey AND o_totalprice > 100000",
)
def _(t):
    j = C.outer_join_on(t.customer, orders_gappy(t.orders), [("c_custkey", "o_custkey")], F.col("o_totalprice") > 100000)
    return j.select("c_custkey", "o_orderkey", "o_totalprice")


@query("c09_in_days", "SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-07'")
def _(t):
    return C.in_days(t.events, "ts", "2024-01-05", "2024-01-06").select("event_id", "user_id")


@query("c10_page", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def _(t):
    return C.page(t.orders, [("o_orderdate", False)], ["o_orderkey"], 50, 100).select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    "c10_deep_page",
    "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 40 OFFSET (SELECT count(*) * 9 // 10 FROM lineitem)",
)
def _(t):
    rows = t.lineitem.count()
    return C.page(t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice"), [("l_extendedprice", False)], ["l_orderkey", "l_linenumber"], 40, rows * 9 // 10, head_rows=0)


@query(
    "c11_ordered_window",
    """SELECT o_orderkey, o_custkey, row_number() OVER w AS rn, lag(o_totalprice) OVER w AS prev_value, lead(o_totalprice) OVER w AS next_value
 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
)
def _(t):
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    return C.ordered_window(o, ["o_custkey"], [("o_orderdate", True)], ["o_orderkey"], "o_totalprice").drop("o_orderdate", "o_totalprice")


@query(
    "c12_agg_of_window",
    """SELECT l_returnflag, round(sum(a), 2) AS sum_of_avg FROM (SELECT l_returnflag, avg(l_quantity) OVER (PARTITION BY l_suppkey) a FROM lineitem) GROUP BY 1""",
)
def _(t):
    return C.agg_of_window(t.lineitem, "l_suppkey", "l_quantity", ["l_returnflag"]).select("l_returnflag", F.round("sum_of_avg", 2).alias("sum_of_avg"))


@query(
    "c13_update_from",
    f"""WITH s AS (SELECT o_custkey k, arg_min(o_totalprice, (o_orderdate, o_orderkey)) p FROM {THIN} GROUP BY 1)
 SELECT c_custkey, c_name, CASE WHEN s.k IS NOT NULL THEN s.p ELSE c_acctbal END AS c_acctbal, s.k IS NOT NULL AS updated FROM customer LEFT JOIN s ON c_custkey = s.k""",
)
def _(t):
    return C.update_from(
        t.customer.select("c_custkey", "c_name", "c_acctbal"), orders_gappy(t.orders), [("c_custkey", "o_custkey")],
        {"c_acctbal": "o_totalprice"}, ["o_orderdate", "o_orderkey"],
    )


@query(
    "c14_upsert",
    """WITH s AS (SELECT c_custkey * 2 AS c_custkey, concat('new-', c_name) AS c_name FROM customer)
 SELECT c.c_custkey, COALESCE(s.c_name, c.c_name) AS c_name, CASE WHEN s.c_custkey IS NULL THEN 'kept' ELSE 'updated' END AS action FROM customer c LEFT JOIN s ON c.c_custkey = s.c_custkey
 UNION ALL SELECT c_custkey, c_name, 'inserted' FROM s WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)""",
)
def _(t):
    target = t.customer.select("c_custkey", "c_name")
    source = t.customer.select((F.col("c_custkey") * 2).alias("c_custkey"), F.concat(F.lit("new-"), "c_name").alias("c_name"))
    return C.upsert(target, source, ["c_custkey"])


@query(
    "c15_append_by_name",
    "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier",
)
def _(t):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return C.append_by_name(a, t.supplier.select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id")))


@query(
    "c16_case_else",
    f"SELECT o_orderkey, CASE WHEN v >= 15 THEN 'large' WHEN v >= 8 THEN 'medium' ELSE 'small or unknown' END AS size FROM {ON}",
)
def _(t):
    v = F.col("v")
    return C.case_else(
        orders_n(t.orders).select("o_orderkey", "v"), [(v >= 15, F.lit("large")), (v >= 8, F.lit("medium"))], F.lit("small or unknown"), "size"
    ).drop("v")


@query(
    "c17_self_join",
    "SELECT l.c_custkey AS id, r.c_custkey AS parent, r.c_name AS parent_name FROM customer l JOIN customer r ON l.c_custkey // 10 = r.c_custkey",
)
def _(t):
    j = C.self_join(t.customer, lambda f, l, r: f.floor(f.col(f"{l}.c_custkey") / 10) == f.col(f"{r}.c_custkey"))
    return j.select(F.col("l.c_custkey").alias("id"), F.col("r.c_custkey").alias("parent"), F.col("r.c_name").alias("parent_name"))


@query(
    "c18_filtered_agg",
    """SELECT l_suppkey, count(*) AS rows_total, count(*) FILTER (WHERE l_returnflag = 'R') AS rows_filtered,
 CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) AS sum_filtered FROM lineitem GROUP BY 1""",
)
def _(t):
    d = t.lineitem.select("l_suppkey", "l_returnflag", F.col("l_extendedprice").cast(M).alias("p"))
    return C.filtered_agg(d, ["l_suppkey"], F.col("l_returnflag") == "R", "p").withColumn("sum_filtered", F.col("sum_filtered").cast("double"))


@query(
    "c19_latest_per_key",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
)
def _(t):
    return C.latest_per_key(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    "c20_moving_sum",
    """SELECT event_id, user_id, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 6 PRECEDING) AS DOUBLE) AS moving FROM events""",
)
def _(t):
    e = t.events.select("event_id", "user_id", "ts", F.col("value").cast(M).alias("value"))
    d = C.moving_sum(e, ["user_id"], ["ts", "event_id"], "value", 6, "moving")
    return d.select("event_id", "user_id", F.col("moving").cast("double").alias("moving"))


@query(
    "c21_pivot_sum",
    """SELECT l_suppkey, CAST(sum(CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS BIGINT) END) AS BIGINT) AS "A",
 CAST(sum(CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS BIGINT) END) AS BIGINT) AS "N", CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) END) AS BIGINT) AS "R" FROM lineitem GROUP BY 1""",
)
def _(t):
    d = t.lineitem.select("l_suppkey", "l_returnflag", F.col("l_quantity").cast("bigint").alias("q"))
    return C.pivot_sum(d, ["l_suppkey"], "l_returnflag", ["A", "N", "R"], "q")


@query(
    "c22_explode_items",
    "SELECT vec_id, CAST(p - 1 AS INTEGER) AS pos, CAST(embedding[p] AS DOUBLE) AS item FROM embeddings, range(1, 2000) r(p) WHERE p <= len(embedding)",
)
def _(t):
    return C.explode_items(t.embeddings, ["vec_id"], "embedding").withColumn("item", F.col("item").cast("double"))


@query("c22_json_field", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(t):
    return C.json_field(t.events, "props", "$.k", "k").select("event_id", "k")


@query(
    "c22_top_structs",
    """SELECT o_custkey, string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey) AS top5 FROM
 (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) r FROM orders) WHERE r <= 5 GROUP BY 1""",
)
def _(t):
    d = C.top_structs(t.orders, ["o_custkey"], [("o_orderkey", True)], ["o_orderkey", "o_orderstatus"], 5)
    flat = F.transform("items", lambda s: F.concat(s["o_orderkey"].cast("string"), F.lit(":"), s["o_orderstatus"]))
    return d.select("o_custkey", F.array_join(flat, ",").alias("top5"))


@query(
    "c23_string_agg",
    "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS joined FROM orders GROUP BY 1",
)
def _(t):
    return C.string_agg(t.orders, ["o_custkey"], "o_orderpriority")


@query(
    "c24_scalar_forms",
    f"""SELECT o_orderkey, CASE WHEN v IS NULL OR v = 0 THEN NULL ELSE o_totalprice / v END AS ratio, COALESCE(v, 0) AS v0,
 CASE WHEN v > 10 THEN 'pos' ELSE 'neg' END AS sign, strftime(o_orderdate, '%Y-%m') AS ym,
 strftime(o_orderdate - INTERVAL 7 DAY, '%Y-%m-%d') AS week_before FROM {ON}""",
)
def _(t):
    d = orders_n(t.orders)
    return d.select(
        "o_orderkey",
        S.safe_div(F.col("o_totalprice"), F.col("v")).alias("ratio"),
        S.if_null(F.col("v"), 0).alias("v0"),
        S.iff(F.col("v") > 10, "pos", "neg").alias("sign"),
        S.year_month(F.col("o_orderdate")).alias("ym"),
        F.date_format(S.minus_days(F.col("o_orderdate"), 7), "yyyy-MM-dd").alias("week_before"),
    )
