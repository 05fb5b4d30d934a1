"""Result verification: multiset comparison and NULL-row survival."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

def _positional(df: DataFrame) -> DataFrame:
    return df.toDF(*[f"c{i + 1}" for i in range(len(df.columns))])


def _group_safe(df: DataFrame) -> DataFrame:
    """Maps cannot be grouped; compare them through sorted entries."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.MapType):
            cols.append(F.array_sort(F.map_entries(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def row_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows whose multiplicity differs, with ``delta`` = copies in a minus copies in b.

    Columns are matched by position; NULLs are equal to NULLs.
    """
    left = _group_safe(_positional(a)).withColumn("_w", F.lit(1).cast("bigint"))
    right = _group_safe(_positional(b)).withColumn("_w", F.lit(-1).cast("bigint"))
    cols = [c for c in left.columns if c != "_w"]
    return left.union(right).groupBy(*cols).agg(F.sum("_w").alias("delta")).where("delta <> 0")


def verify_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: verdict, rows only in a, rows only in b."""
    d = row_delta(a, b)
    return d.agg(
        F.coalesce(F.sum(F.when(F.col("delta") > 0, F.col("delta"))), F.lit(0)).cast("bigint").alias("extra_in_a"),
        F.coalesce(F.sum(F.when(F.col("delta") < 0, -F.col("delta"))), F.lit(0)).cast("bigint").alias("extra_in_b"),
    ).select(
        F.when((F.col("extra_in_a") == 0) & (F.col("extra_in_b") == 0), "equivalent").otherwise("different").alias("verdict"),
        "extra_in_a",
        "extra_in_b",
    )


def comparable(a: DataFrame, b: DataFrame) -> bool:
    ta = [f.dataType for f in a.schema.fields]
    tb = [f.dataType for f in b.schema.fields]
    return len(ta) == len(tb) and all(x == y for x, y in zip(ta, tb))


def verdict(a: DataFrame, b: DataFrame) -> DataFrame:
    """equivalent / different, or inconclusive if the columns differ; ``may_suppress`` only on a proven difference."""
    if not comparable(a, b):
        return a.agg(F.count(F.lit(1)).alias("_n")).select(
            F.lit("inconclusive").alias("verdict"), F.lit(False).alias("may_suppress")
        )
    return verify_equal(a, b).select("verdict", (F.col("verdict") == "different").alias("may_suppress"))


def survives_unmatched(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], pred: Column) -> DataFrame:
    """Does a left row without any partner pass ``pred``? The right side is taken as empty."""
    empty = right.where(F.lit(False))
    cond = [left[lk] == empty[rk] for lk, rk in on]
    kept = left.join(empty, cond, "left").agg(
        F.count(F.lit(1)).alias("unmatched_rows"),
        F.count_if(pred).alias("surviving_rows"),
    )
    return kept.select(
        "unmatched_rows",
        "surviving_rows",
        F.when(F.col("surviving_rows") > 0, "survives").otherwise("filtered_out").alias("verdict"),
    )
