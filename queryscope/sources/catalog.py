"""Catalogs: rows (table_name, column_name, ordinal) from JSON, DDL or live tables."""

from __future__ import annotations

from itertools import accumulate, zip_longest

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from queryscope.functions import words as K
from queryscope.functions.text import bare, tokens
from queryscope.session import cut


def catalog_size(catalog: DataFrame) -> DataFrame:
    """One row: tables, columns, accepted by an interactive check. A report only: catalogs of any size are used."""
    return catalog.agg(
        F.countDistinct("table_name").alias("tables"), F.count("*").alias("columns")
    ).withColumn("accepted", (F.col("tables") <= K.MAX_TABLES) & (F.col("columns") <= K.MAX_COLUMNS))


def catalog_from_tables(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Catalog of live tables, from their schemas."""
    rows = [(t, f.name, i, f.dataType.simpleString()) for t, df in tables.items() for i, f in enumerate(df.schema.fields, 1)]
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal int, data_type string")


def read_catalog_json(spark: SparkSession, path: str) -> DataFrame:
    """``{table: [columns]}`` files as catalog rows."""
    raw = spark.read.text(path, wholetext=True)
    m = F.from_json("value", "map<string,array<string>>")
    return raw.select(F.explode(m).alias("table_name", "cols")).select(
        "table_name", F.posexplode("cols").alias("i", "column_name")
    ).select("table_name", "column_name", (F.col("i") + 1).alias("ordinal"))


def merge_catalogs(explicit: DataFrame, derived: DataFrame) -> DataFrame:
    """The explicit catalog wins table by table, with its whole column list."""
    rest = derived.join(explicit.select("table_name").distinct(), "table_name", "left_anti")
    return rest.unionByName(explicit, allowMissingColumns=True)


def catalog_profile(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Live catalog with the filled values of every column (one pass per table)."""
    parts = []
    for t, df in tables.items():
        rows = [
            F.struct(
                F.lit(t).alias("table_name"),
                F.lit(f.name).alias("column_name"),
                F.lit(i).cast("int").alias("ordinal"),
                F.count(f.name).cast("bigint").alias("filled_rows"),
            )
            for i, f in enumerate(df.schema.fields, 1)
        ]
        parts.append(df.agg(F.array(*rows).alias("a")).select(F.inline("a")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def catalog_from_json(df: DataFrame, col: str, *keep: str) -> DataFrame:
    """Catalog rows from a column of ``{table: [columns]}`` texts."""
    m = F.from_json(F.col(col), "map<string,array<string>>")
    return df.select(*keep, F.explode(m).alias("table_name", "cols")).select(
        *keep, "table_name", F.posexplode("cols").alias("i", "column_name")
    ).select(*keep, "table_name", "column_name", (F.col("i") + 1).alias("ordinal"))


_NOT_COLUMNS = frozenset(["CONSTRAINT", "PRIMARY", "FOREIGN", "UNIQUE", "CHECK", "KEY", "INDEX"])
_MADE = frozenset(["TABLE", "VIEW", "INDEX", "FUNCTION", "PROCEDURE", "SCHEMA", "DATABASE"])
_STATEMENTS = "array<struct<is_create:boolean,is_table:boolean,balanced:boolean,table_name:string,cols:array<string>>>"
_STATEMENT = pa.struct([*((k, pa.bool_()) for k in ("is_create", "is_table", "balanced")), ("table_name", pa.string()), ("cols", pa.list_(pa.string()))])


def _lists(rows: pa.ListArray) -> list[list[list]]:
    """Lists of lists as Python ones, by way of one flat column: much faster than ``to_pylist``."""
    inner = rows.flatten()
    flat = inner.flatten().to_numpy(zero_copy_only=False).tolist()
    cuts = lambda x: list(accumulate(pc.list_value_length(x).to_pylist(), initial=0))
    at = cuts(inner)
    texts = [flat[s:e] for s, e in zip(at, at[1:])]
    at = cuts(rows)
    return [texts[s:e] for s, e in zip(at, at[1:])]


def read_statement(u: list[str], name: list[str | None]) -> tuple:
    """What one DDL statement creates (is_create, is_table, balanced, table_name, columns), from its tokens in upper case and what they name: a walk with the depth of its parentheses."""
    made = table_name = None
    opened = closed = 0
    after_table = after_as = False
    cols = []
    for i, x in enumerate(u):
        named = name[i]
        closed += x == ")"
        if named is not None:
            # the name is the last part of the dotted run right before the first parenthesis
            if not opened and after_table and not after_as and x not in ("IF", "EXISTS"):
                table_name = named
            if opened - closed == 1 and 0 < i < len(u) - 1 and u[i - 1] in ("(", ",") and x not in _NOT_COLUMNS and u[i + 1] not in (",", ")"):
                cols.append(named)
        if made is None and x in _MADE:
            made = x
        opened += x == "("
        after_table = after_table or x == "TABLE"
        after_as = after_as or x == "AS"
    is_table = None if made is None else made == "TABLE"
    return u[0] == "CREATE", is_table, opened == closed, table_name, cols


def read_statements(u: list[str], name: list[str | None]) -> list[tuple]:
    """Every statement of a text that has a token; a broken one ends at the next semicolon."""
    out, start = [], 0
    for i in [*(k for k, x in enumerate(u) if x == ";"), len(u)]:
        if i > start:
            out.append(read_statement(u[start:i], name[start:i]))
        start = i + 1
    return out


def _ddl_statements(ddl: DataFrame, default_dialect: str) -> DataFrame:
    """ddl_id and its DDL statements: is_create, is_table, balanced, table_name, columns in order; ids without a statement are left out.

    The tokens of a text stay one row and are read in one walk, without a window or a sort over tokens. Rows of a repeated id are
    read as one text, token by token side by side.
    """
    from queryscope.plans import tokens as T

    @F.arrow_udf(_STATEMENTS)
    def walk(u: pa.Array, name: pa.Array) -> pa.Array:
        side = lambda rows: rows[0] if len(rows) == 1 else [x for xs in zip_longest(*rows) for x in xs]
        found, sizes = [], []
        for us, names in zip(_lists(u), _lists(name)):
            toks = [(x, n) for x, n in zip(side(us), side(names)) if x is not None]
            own = read_statements([x for x, _ in toks], [n for _, n in toks])
            found += own
            sizes.append(len(own))
        columns = [pa.array(v, f.type) for v, f in zip(zip(*found), _STATEMENT)] if found else [pa.array([], f.type) for f in _STATEMENT]
        offsets = pa.array([0, *accumulate(sizes)], pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, fields=list(_STATEMENT)))

    c = F.col
    dialect = F.when(c("dialect").isin(K.DIALECTS), c("dialect")).otherwise(K.DIALECTS[0]) if "dialect" in ddl.columns else F.lit(default_dialect)
    # shuffle the texts, not their tokens
    rows = ddl.where("sql IS NOT NULL").groupBy("ddl_id").agg(F.collect_list(F.struct(dialect.alias("dialect"), "sql")).alias("rows"))
    lexed = lambda r: F.struct(r["dialect"].alias("dialect"), F.transform(tokens(r["sql"], r["dialect"]), bare).alias("cut"))
    t = rows.select("ddl_id", F.transform("rows", lexed).alias("rows"))
    each = lambda entry: f"transform(rows, r -> struct(r.dialect AS dialect, transform(r.cut, c -> {entry}) AS cut)) AS rows"
    t = t.selectExpr("ddl_id", each("struct(c AS text, if(c = '==', '=', upper(c)) AS u)"))
    t = t.selectExpr("ddl_id", each(f"struct(c.text AS text, c.u AS u, {T.kind_of('c.', 'r.dialect')} AS kind)"))
    # a comment keeps its place without a token
    shown = lambda value: F.expr(f"transform(rows, r -> transform(r.cut, c -> {value}))")
    # one walk a text: the optimizer would repeat a deterministic one in the filter
    found = t.select("ddl_id", walk.asNondeterministic()(shown("if(c.kind = 'comment', NULL, c.u)"), shown(T.name_of("c."))).alias("statements"))
    return found.where("size(statements) > 0")


def catalog_from_ddl(ddl: DataFrame, dialect: str = K.DIALECTS[0]) -> tuple[DataFrame, DataFrame]:
    """(catalog rows, skipped counts) of DDL texts (ddl_id, sql and perhaps dialect); a bad statement never hides its neighbours.

    Only CREATE TABLE with columns counts; everything else is counted as skipped. Texts of any length are read, each in
    its row's dialect or else in ``dialect``.
    """
    ok = lambda x: f"coalesce({x}is_create AND {x}is_table AND {x}balanced AND {x}table_name IS NOT NULL AND size({x}cols) > 0, false)"
    st = cut(_ddl_statements(ddl, dialect))  # read for the catalog and for the counts
    one = st.select("ddl_id", F.inline("statements")).where(ok(""))
    catalog = one.select("ddl_id", "table_name", F.posexplode("cols").alias("i", "column_name")).select(
        "ddl_id", "table_name", "column_name", (F.col("i") + 1).alias("ordinal")
    )
    skipped = st.selectExpr("ddl_id", f"CAST(size(filter(statements, x -> NOT {ok('x.')})) AS BIGINT) AS skipped")
    return catalog, skipped


# ---- corpus-wide checks -----------------------------------------------------


def ambiguous_names(catalog: DataFrame) -> DataFrame:
    """Column names of two or more catalog tables."""
    return catalog.groupBy(F.lower("column_name").alias("column_name")).agg(
        F.countDistinct(F.lower("table_name")).alias("table_count"),
        F.array_join(F.array_sort(F.collect_set(F.lower("table_name"))), ",").alias("tables"),
    ).where("table_count > 1")


def positional_check(target: DataFrame, source: DataFrame) -> DataFrame:
    """Target and source columns side by side by position, with the source values at stake."""
    t = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(target.schema.fields, 1)]
    s = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(source.schema.fields, 1)]
    spark = target.sparkSession
    filled = catalog_profile(spark, {"s": source}).select("ordinal", "filled_rows")
    td = spark.createDataFrame(t, "ordinal int, target_column string, target_type string")
    sd = spark.createDataFrame(s, "ordinal int, source_column string, source_type string")
    j = td.join(sd, "ordinal", "full").join(filled, "ordinal", "left")
    return j.select(
        "ordinal", "target_column", "source_column",
        F.coalesce(F.lower("target_column") == F.lower("source_column"), F.lit(False)).alias("same_name"),
        F.coalesce(F.col("target_type") == F.col("source_type"), F.lit(False)).alias("same_type"),
        F.coalesce("filled_rows", F.lit(0)).alias("filled_rows"),
    )
