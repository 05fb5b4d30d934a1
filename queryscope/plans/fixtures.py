"""Views of the given tables that carry the NULLs, gaps and SQL texts the audits need."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

#: DuckDB text of the same view, for the comparison queries
ORDERS_N_SQL = (
    "(SELECT *, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_custkey END AS g, "
    "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(trunc(o_totalprice/20000) AS INTEGER) END AS v FROM orders)"
)


def orders_n(orders: DataFrame) -> DataFrame:
    """Orders with a NULL-bearing group ``g`` and small integer value ``v``."""
    return orders.select(
        "*",
        F.when(F.col("o_orderkey") % 10 == 0, F.lit(None)).otherwise(F.col("o_custkey")).cast("bigint").alias("g"),
        F.when(F.col("o_orderkey") % 7 == 0, F.lit(None)).otherwise((F.col("o_totalprice") / 20000).cast("int")).alias("v"),
    )


#: all orders; most customer keys lead nowhere and some are NULL, so that most customers have no order
ORDERS_GAPPY_SQL = """(SELECT * REPLACE (CASE o_orderkey % 50 WHEN 0 THEN o_custkey WHEN 1 THEN NULL ELSE -o_custkey END AS o_custkey) FROM orders)"""


def orders_gappy(orders: DataFrame) -> DataFrame:
    """All orders, most of them of customers that do not exist and some of nobody."""
    rest = F.col("o_orderkey") % 50
    key = F.when(rest == 0, F.col("o_custkey")).when(rest != 1, -F.col("o_custkey"))
    return orders.withColumn("o_custkey", key.cast(orders.schema["o_custkey"].dataType))


def query_log(orders: DataFrame, templates: Sequence[str], dialect: str = "bigquery") -> DataFrame:
    """One SQL text per order: templates in turn, ``{n}`` replaced by the customer key."""
    texts = F.array(*[F.lit(t) for t in templates])
    tid = F.pmod(F.col("o_orderkey"), F.lit(len(templates))).cast("int")
    return orders.select(
        F.col("o_orderkey").alias("query_id"),
        F.col("o_custkey").alias("author"),
        F.col("o_orderdate").alias("ts"),
        F.lit(dialect).alias("dialect"),
        F.replace(F.get(texts, tid), F.lit("{n}"), F.col("o_custkey").cast("string")).alias("sql"),
    )


def api_keys(customer: DataFrame, orders: DataFrame) -> DataFrame:
    """One key record per customer with orders; expiry counts from the first order."""
    first = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderdate").alias("created_at"))
    k = F.col("c_custkey")
    return customer.join(first, "c_custkey", "inner").select(
        F.concat(F.when(k % 7 == 0, F.lit("test_")).otherwise(F.lit("live_")), k.cast("string")).alias("api_key"),
        k.alias("owner"),
        F.when(k % 2 == 0, "monthly").when(k % 11 == 1, F.lit(None)).otherwise("annual").alias("plan"),
        F.when(k % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("c"), k.cast("string"), F.lit("@example.com"))).alias("email"),
        "created_at",
        (k % 3 == 0).alias("reminder_sent"),
    )
