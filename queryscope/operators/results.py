"""The whole result of a check: findings, hint, fixed text, what the fix removed and how the texts differ."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from queryscope.operators.compare import query_diff
from queryscope.operators.findings import lint_corpus
from queryscope.operators.fixes import apply_auto_fixes
from queryscope.session import cut


def full_results(log: DataFrame, titles: Sequence[str] | None = None, catalog: DataFrame | None = None) -> DataFrame:
    """``lint_corpus`` with hints, plus fixed_sql, fixed_titles and fix_diff (null where there is nothing to fix)."""
    results = lint_corpus(log, titles, catalog, with_hints=True)
    fixes = cut(apply_auto_fixes(log).select("query_id", "sql", "fixed_sql", "fixed_titles"))
    pairs = fixes.join(log.select("query_id", "dialect"), "query_id").selectExpr("query_id AS pair_id", "dialect", "sql AS sql_a", "fixed_sql AS sql_b")
    diff = query_diff(pairs).groupBy(F.col("pair_id").alias("query_id")).agg(
        F.array_sort(F.collect_list(F.struct("category", "subject", "before", "after"))).alias("fix_diff")
    )
    extra = fixes.select("query_id", "fixed_sql", "fixed_titles").join(diff, "query_id", "left")
    return results.join(extra, "query_id", "left")
