"""What a query log uses of a catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from queryscope.functions import words as K
from queryscope.operators import rules as R
from queryscope.plans import tokens as T


def _facts(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(copies per text, statement facts of the distinct texts)."""
    texts = T.distinct_texts(T.normalise_log(log))
    return texts.select("tid", "copies"), T.statements(T.whole(texts), ())  # names are read, no facts of segments on demand


def unknown_tables_ranked(log: DataFrame, catalog: DataFrame) -> DataFrame:
    """Unknown table names by the number of queries that use them."""
    copies, st = _facts(log)
    known = catalog.select(F.lower("table_name").alias("table_name")).distinct()
    miss = R.table_refs(st).join(known, "table_name", "left_anti").select("tid", "table_name").distinct()
    return miss.join(copies, "tid").groupBy("table_name").agg(F.sum("copies").alias("queries"))


def unknown_columns_ranked(log: DataFrame, catalog: DataFrame) -> DataFrame:
    """Unknown columns of known tables by queries, each with the nearest known name."""
    copies, st = _facts(log)
    low = catalog.select(F.lower("table_name").alias("table_name"), F.lower("column_name").alias("known")).distinct()
    refs = R.column_refs(st).where("table_name IS NOT NULL").select("tid", "table_name", F.lower("column_name").alias("column_name")).distinct()
    refs = refs.join(low.select("table_name").distinct(), "table_name", "left_semi")
    miss = refs.join(low.withColumnRenamed("known", "column_name"), ["table_name", "column_name"], "left_anti")
    ranked = miss.join(copies, "tid").groupBy("table_name", "column_name").agg(F.sum("copies").alias("queries"))
    near = ranked.join(low, "table_name").groupBy("table_name", "column_name").agg(
        F.max("queries").alias("queries"),
        F.min_by("known", F.struct(F.levenshtein("column_name", "known"), F.col("known"))).alias("nearest"),
    )
    return near


def unused_catalog(log: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalog columns no query mentions; ``table_unused`` if the whole table is not read."""
    _, st = _facts(log)
    cat = catalog.select(F.lower("table_name").alias("table_name"), F.lower("column_name").alias("column_name")).distinct()
    tabs = R.table_refs(st).select("table_name").distinct().withColumn("used", F.lit(True))
    cols = R.column_refs(st).where("table_name IS NOT NULL").select("table_name", F.lower("column_name").alias("column_name")).distinct()
    rest = cat.join(cols, ["table_name", "column_name"], "left_anti").join(tabs, "table_name", "left")
    return rest.select("table_name", "column_name", F.col("used").isNull().alias("table_unused"))


def column_map(log: DataFrame) -> DataFrame:
    """query_id, table_name, columns, unresolved: what each query reads from each table."""
    keyed = T.normalise_log(log)
    st = T.statements(T.whole(T.distinct_texts(keyed)), ())
    refs = R.column_refs(st)
    lost = refs.groupBy("tid").agg(F.bool_or(F.col("table_name").isNull()).alias("unresolved"))
    per = refs.where("table_name IS NOT NULL").groupBy("tid", "table_name").agg(
        F.array_join(F.array_sort(F.collect_set(F.lower("column_name"))), ",").alias("columns")
    )
    return keyed.select("query_id", "tid").join(per.join(lost, "tid"), "tid").select("query_id", "table_name", "columns", "unresolved")


# One row per meaning, with the function each dialect uses for it.
PORTABLE = {
    "null default": dict(bigquery="IFNULL", postgres="COALESCE", mysql="IFNULL", snowflake="NVL", spark="NVL", sqlite="IFNULL", tsql="ISNULL", oracle="NVL", duckdb="IFNULL", redshift="NVL"),
    "joined text": dict(bigquery="STRING_AGG", postgres="STRING_AGG", mysql="GROUP_CONCAT", snowflake="LISTAGG", spark="LISTAGG", sqlite="GROUP_CONCAT", tsql="STRING_AGG", oracle="LISTAGG", duckdb="STRING_AGG", redshift="LISTAGG"),
    "inline condition": dict(bigquery="IF", postgres="CASE", mysql="IF", snowflake="IFF", spark="IF", sqlite="IIF", tsql="IIF", oracle="CASE", duckdb="IF", redshift="CASE"),
    "safe division": dict(bigquery="SAFE_DIVIDE", postgres="NULLIF", mysql="NULLIF", snowflake="DIV0NULL", spark="TRY_DIVIDE", sqlite="NULLIF", tsql="NULLIF", oracle="NULLIF", duckdb="NULLIF", redshift="NULLIF"),
    "date text": dict(bigquery="FORMAT_DATE", postgres="TO_CHAR", mysql="DATE_FORMAT", snowflake="TO_VARCHAR", spark="DATE_FORMAT", sqlite="STRFTIME", tsql="FORMAT", oracle="TO_CHAR", duckdb="STRFTIME", redshift="TO_CHAR"),
    "value list": dict(bigquery="ARRAY_AGG", postgres="ARRAY_AGG", snowflake="ARRAY_AGG", spark="COLLECT_LIST", duckdb="ARRAY_AGG", mysql="JSON_ARRAYAGG", sqlite="JSON_GROUP_ARRAY", oracle="JSON_ARRAYAGG"),
    "current time": dict(bigquery="CURRENT_TIMESTAMP", postgres="NOW", mysql="NOW", snowflake="CURRENT_TIMESTAMP", spark="NOW", sqlite="DATETIME", tsql="GETDATE", oracle="SYSTIMESTAMP", duckdb="NOW", redshift="GETDATE"),
}
#: meanings whose arguments carry a format text that differs between dialects
FORMATTED = ["date text"]


def _lookup() -> Column:
    """(dialect, function) -> meaning, as a literal map."""
    pairs = [(f"{d}:{fn}", meaning) for meaning, m in PORTABLE.items() for d, fn in m.items()]
    return F.create_map(*[x for k, v in pairs for x in (F.lit(k), F.lit(v))])


def _targets() -> Column:
    return F.create_map(*[x for m, fns in PORTABLE.items() for d, fn in fns.items() for x in (F.lit(f"{d}:{m}"), F.lit(fn))])


def portability(log: DataFrame, target: str) -> DataFrame:
    """Per query the functions that need another name, another form or a look at their format in ``target``."""
    from pyspark.sql import Window as W

    if target not in K.DIALECTS:
        raise ValueError(f"unknown dialect {target}")
    c = F.col
    keyed = T.normalise_log(log)
    texts = T.distinct_texts(keyed)
    w = W.partitionBy("tid").orderBy("pos")
    tok = T.token_table(texts).where("kind <> 'comment'").withColumn("n1", F.lead("u").over(w)).withColumn("p1", F.lag("u").over(w))
    call = (c("n1") == "(") & c("kind").isin("word", "kw")
    top = (c("u") == "TOP") & (c("p1") == "SELECT") & (c("dialect") == "tsql")
    calls = tok.where(call | top).select("tid", "dialect", c("u").alias("function"), top.alias("top")).distinct()
    meaning = F.try_element_at(_lookup(), F.concat_ws(":", "dialect", "function"))
    other = F.try_element_at(_targets(), F.concat_ws(":", F.lit(target), "meaning"))
    hits = calls.withColumn("meaning", F.when(c("top"), "row limit").otherwise(meaning)).where("meaning IS NOT NULL AND dialect <> '%s'" % target)
    hits = hits.withColumn("target_function", F.when(c("top"), "LIMIT").otherwise(other))
    action = (
        F.when(c("target_function").isNull(), "no counterpart")
        .when(c("meaning").isin(FORMATTED), "review format")
        .when(c("target_function") == c("function"), "same")
        .otherwise("rename")
    )
    per = hits.select("tid", "function", "target_function", action.alias("action"))
    return keyed.select("query_id", "tid").join(per, "tid").select("query_id", "function", "target_function", "action")
