"""Which base-table column each name in a text stands for, through CTEs, derived tables, renames and stars.

The names of a text are resolved inside the text (``plans.names``), in the walk that reads it: no reference is shuffled. Only what
leads to a base table meets the catalog, by one equi-join on the table's name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from queryscope.plans import names as N, shape as S, tokens as T
from queryscope.session import cut  # noqa: F401  nothing is cut here any more; tests look for it


def _low(c: str) -> Column:
    return F.lower(F.col(c))


def _wide(df: DataFrame) -> DataFrame:
    """A table that grows with the texts. Estimates behind a checkpoint are far too low, so that joins would send it whole through the driver."""
    return df.hint("merge")


def _columns(catalog: DataFrame) -> DataFrame:
    """table_name, known: the columns of each table of a catalog."""
    return catalog.groupBy(_low("table_name").alias("table_name")).agg(F.collect_set(_low("column_name")).alias("known")).where("table_name IS NOT NULL")


def resolved_columns(texts: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """tid, stmt, pos, given (qualifier as written), written (name as written), table_name, column_name, state.

    ``state``: ``table`` (column_name of table_name), ``expression`` (an item of a sub-select that is computed), ``unknown`` (no item
    or column of that name, or a name that only leads back to itself). With a ``catalog`` (table_name, column_name) a star over
    several sources leads to those that have the column, and a base column must be in it if its table is.
    """
    out = T.whole(texts).rows(N.references_of, S.array_of(N.REFERENCES))
    if catalog is None:
        return out.drop("several")
    met = out.join(_columns(catalog), "table_name", "left")
    lacks = F.coalesce(~F.array_contains("known", F.col("column_name")), F.lit(False))
    state = F.when(lacks, "unknown").otherwise(F.col("state"))
    return met.where(~(lacks & F.col("several"))).select("tid", "stmt", "pos", "given", "written", "table_name", "column_name", state.alias("state"))


def lineage(log: DataFrame, catalog: DataFrame) -> DataFrame:
    """query_id, table_name, columns: the base columns that a query names or reads through a star, whatever it is nested in."""
    keyed = T.normalise_log(log)
    read = T.whole(T.distinct_texts(keyed)).rows(N.tables_of, S.array_of(N.READ))
    met = read.join(_columns(catalog), "table_name", "left")
    # a table that the catalog does not have is taken as it is named
    named = F.when(F.col("known").isNull(), F.col("names")).otherwise(F.array_intersect("names", "known"))
    every = F.when(F.col("star") & F.col("known").isNotNull(), F.array_union(named, "known")).otherwise(named)
    per = met.select("tid", "table_name", F.array_sort(every).alias("columns")).where(F.size("columns") > 0)
    return keyed.select("query_id", "tid").join(_wide(per), "tid").select("query_id", "table_name", F.array_join("columns", ",").alias("columns"))


def unknown_names(log: DataFrame, catalog: DataFrame) -> DataFrame:
    """query_id, name: qualified columns that neither a sub-select's output nor the catalog has."""
    keyed = T.normalise_log(log)
    asked = T.whole(T.distinct_texts(keyed)).rows(N.qualified_of, S.array_of(N.ASKED))
    met = asked.join(_columns(catalog), "table_name", "left")
    lost = F.filter("names", lambda n: F.col("table_name").isNull() | F.coalesce(~F.array_contains("known", n["column_name"]), F.lit(False)))
    per = met.select("tid", F.explode(F.transform(lost, lambda n: n["name"])).alias("name")).distinct()
    return keyed.select("query_id", "tid").join(_wide(per), "tid").select("query_id", "name")
