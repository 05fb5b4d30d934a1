"""Data-impact audits: what a query mistake does to the rows of real tables.

Two rules hold throughout. A join that is only needed for counting first
aggregates both sides per key, so that a hot key is one row by the time it is
joined and no pair of rows is ever produced. One-row results are laid side by
side by a union, never by a cross join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from queryscope.operators.verify import verify_equal
from queryscope.plans.skew import merge_rows

BIG = "decimal(38,0)"
N = "*"


def _cnt(cond: Column | None = None) -> Column:
    return (F.count(N) if cond is None else F.count_if(cond)).cast("bigint")


def _sum0(col: Column) -> Column:
    return F.coalesce(F.sum(col), F.lit(0)).cast("bigint")


def _key_counts(df: DataFrame, keys: Sequence[str], name: str, prefix: str = "k") -> DataFrame:
    """Rows per key, keys renamed to ``k0..``; partial aggregation happens before the shuffle."""
    return df.groupBy(*[F.col(k).alias(f"{prefix}{i}") for i, k in enumerate(keys)]).agg(F.count(N).alias(name))


def _keys(n: int) -> list[str]:
    return [f"k{i}" for i in range(n)]


def null_compare(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows kept per column by ``= NULL``, ``<> NULL``, ``IS NULL`` and ``IS NOT NULL``."""
    aggs = []
    for c in cols:
        null = F.lit(None).cast(df.schema[c].dataType)
        aggs.append(
            F.struct(
                F.lit(c).alias("column_name"),
                _cnt().alias("rows_total"),
                _cnt(F.col(c) == null).alias("eq_null"),
                _cnt(F.col(c) != null).alias("ne_null"),
                _cnt(F.col(c).isNull()).alias("is_null"),
                _cnt(F.col(c).isNotNull()).alias("is_not_null"),
            )
        )
    return df.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


def not_in_trap(left: DataFrame, lk: str, right: DataFrame, rk: str) -> DataFrame:
    """Rows kept by NOT IN and by NOT EXISTS, without a null-aware join."""
    l = _key_counts(left, [lk], "n")
    r = right.select(F.col(rk).alias("k0")).where("k0 IS NOT NULL").distinct().withColumn("hit", F.lit(True))
    per_key = l.join(r, "k0", "left").agg(
        _sum0(F.col("n")).alias("left_rows"),
        _sum0(F.when(F.col("k0").isNull(), F.col("n"))).alias("left_null_keys"),
        _sum0(F.when(F.col("hit").isNull(), F.col("n"))).alias("not_exists_rows"),
    )
    flags = right.agg(_cnt().alias("right_rows"), _cnt(F.col(rk).isNull()).alias("right_null_keys"))
    return merge_rows(per_key, flags).withColumn(
        "not_in_rows",
        F.when(F.col("right_rows") == 0, F.col("left_rows"))
        .when(F.col("right_null_keys") > 0, F.lit(0))
        .otherwise(F.col("not_exists_rows") - F.col("left_null_keys"))
        .cast("bigint"),
    )


def outer_nullify(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], how: str, pred: Column) -> DataFrame:
    """What a WHERE predicate on the optional side does to an outer join.

    ``pred`` reads the optional side: the right table for left and full joins,
    the left table for right joins.
    """
    if how == "right":
        return outer_nullify(right, left, [(r, l) for l, r in on], "left", pred)
    n = len(on)
    l = _key_counts(left, [a for a, _ in on], "n")
    r = right.groupBy(*[F.col(b).alias(f"k{i}") for i, (_, b) in enumerate(on)]).agg(
        F.count(N).alias("m"), F.count_if(pred).alias("mt")
    )
    cond = [l[k] == r[k] for k in _keys(n)]
    j = l.join(r, cond, "left" if how == "left" else "full")
    nn, m, mt = F.col("n").cast(BIG), F.col("m"), F.col("mt")
    both = F.col("n").isNotNull() & m.isNotNull()
    alone = F.col("n").isNotNull() & m.isNull()
    extra = F.col("n").isNull()
    one = j.agg(
        _sum0(F.when(both, nn * m).when(alone, nn).otherwise(m)).alias("outer_rows"),
        _sum0(F.when(alone, nn)).alias("unmatched_rows"),
        _sum0(F.when(both, nn * mt).when(extra, mt)).alias("kept_matched"),
        _sum0(
            F.when(both, F.when(mt > 0, nn * mt).otherwise(nn) + (F.lit(0) if how == "left" else m - mt))
            .when(alone, nn)
            .otherwise(m)
        ).alias("rows_if_in_on"),
    )
    # the predicate on a row of NULLs decides the fate of every unmatched row
    one_row = right.sparkSession.range(1)  # from the schema alone: the optional side may be empty
    null_row = one_row.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields])
    nulls = null_row.agg(F.coalesce(F.max(F.when(pred, 1)), F.lit(0)).cast("bigint").alias("null_ok"))
    res = merge_rows(one, nulls)
    unmatched_kept = (F.col("unmatched_rows") * F.coalesce(F.col("null_ok"), F.lit(0))).cast("bigint")
    return res.select(
        "outer_rows",
        "unmatched_rows",
        (F.col("kept_matched") + unmatched_kept).alias("rows_in_where"),
        unmatched_kept.alias("unmatched_kept"),
        "rows_if_in_on",
        F.when(F.col("unmatched_rows") == 0, "no_unmatched")
        .when(unmatched_kept > 0, "survives")
        .otherwise("filtered_out")
        .alias("verdict"),
    )


def coalesce_match(df: DataFrame, a: str, b: str, sentinel) -> DataFrame:
    """Plain, null-safe and COALESCE equality side by side."""
    x, y, s = F.col(a), F.col(b), F.lit(sentinel)
    cx, cy = F.coalesce(x, s), F.coalesce(y, s)
    return df.agg(
        _cnt().alias("rows_total"),
        _cnt(x == y).alias("plain_eq"),
        _cnt(x.eqNullSafe(y)).alias("null_safe_eq"),
        _cnt(cx == cy).alias("coalesce_eq"),
        _cnt(x.isNull() & y.isNull()).alias("both_null"),
        _cnt((cx == cy) & (x.isNull() != y.isNull())).alias("sentinel_collisions"),
    )


def between_dates(df: DataFrame, ts: str, lo: str, hi: str) -> DataFrame:
    """BETWEEN two bare dates against the half-open day range; the range reaches the scan."""
    t = F.col(ts)
    lo_, hi_ = F.lit(lo).cast("timestamp"), F.lit(hi).cast("timestamp")
    hits = df.where((t >= lo_) & (t < hi_ + F.expr("INTERVAL 1 DAY")))
    inside = t <= hi_
    return hits.agg(
        _cnt(inside).alias("between_rows"),
        _cnt().alias("half_open_rows"),
        _cnt(~inside).alias("lost_rows"),
        F.coalesce(F.bool_or(t != F.date_trunc("day", t)), F.lit(False)).alias("has_time_part"),
    )


def join_fanout(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]]) -> DataFrame:
    """Size of the Cartesian product and of the equi join, from per-key counts alone."""
    l = _key_counts(left, [a for a, _ in keys], "cl")
    r = _key_counts(right, [b for _, b in keys], "cr")
    pairs = l.join(r, _keys(len(keys)), "inner").select((F.col("cl").cast(BIG) * F.col("cr")).cast(BIG).alias("p"))
    eq = pairs.agg(
        F.coalesce(F.sum("p"), F.lit(0)).cast(BIG).alias("equi_rows"),
        F.coalesce(F.max("p"), F.lit(0)).cast(BIG).alias("hottest_key_rows"),
        F.count(N).cast(BIG).alias("matched_keys"),
    )
    sizes_l = l.agg(F.coalesce(F.sum("cl"), F.lit(0)).cast(BIG).alias("left_rows"))
    sizes_r = r.agg(F.coalesce(F.sum("cr"), F.lit(0)).cast(BIG).alias("right_rows"))
    res = merge_rows(eq, sizes_l, sizes_r).withColumn("cartesian_rows", F.col("left_rows") * F.col("right_rows"))
    return res.select(
        *[
            F.col(c).cast(BIG).cast("string").alias(c)
            for c in ("left_rows", "right_rows", "cartesian_rows", "equi_rows", "matched_keys", "hottest_key_rows")
        ]
    )


def hottest_keys(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], k: int = 10) -> DataFrame:
    """The k keys that contribute most rows to an equi join."""
    l = _key_counts(left, [a for a, _ in keys], "left_rows")
    r = _key_counts(right, [b for _, b in keys], "right_rows")
    ks = _keys(len(keys))
    return (
        l.join(r, ks, "inner")
        .withColumn("joined_rows", F.col("left_rows") * F.col("right_rows"))
        .orderBy(F.desc("joined_rows"), *ks)
        .limit(k)
    )


def join_multiplicity(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]]) -> DataFrame:
    """Left rows with no, one and many partners; a join is removable iff all have exactly one."""
    l = _key_counts(left, [a for a, _ in keys], "n")
    r = _key_counts(right, [b for _, b in keys], "m")
    j = l.join(r, _keys(len(keys)), "left")
    n, m = F.col("n"), F.coalesce(F.col("m"), F.lit(0))
    return j.agg(
        _sum0(n).alias("left_rows"),
        _sum0(F.when(m == 0, n)).alias("no_match"),
        _sum0(F.when(m == 1, n)).alias("one_match"),
        _sum0(F.when(m > 1, n)).alias("many_matches"),
        F.coalesce(F.max(m), F.lit(0)).cast("bigint").alias("max_matches"),
    ).select(
        "*",
        ((F.col("no_match") == 0) & (F.col("many_matches") == 0)).alias("inner_join_removable"),
        (F.col("many_matches") == 0).alias("left_join_removable"),
    )


def scalar_multi(
    outer: DataFrame, inner: DataFrame, keys: Sequence[tuple[str, str]], pick: str, order: Sequence[str]
) -> DataFrame:
    """Outer keys whose scalar subquery returns several rows, with the pick of an ordered LIMIT 1."""
    ks = _keys(len(keys))
    i = inner.groupBy(*[F.col(b).alias(f"k{n}") for n, (_, b) in enumerate(keys)]).agg(
        F.count(N).alias("inner_rows"),
        F.min_by(F.col(pick), F.struct(*order)).alias("first_pick"),
    )
    o = _key_counts(outer, [a for a, _ in keys], "outer_rows")
    return o.join(i.where("inner_rows > 1"), ks, "inner").select(*ks, "outer_rows", "inner_rows", "first_pick")


def update_link(target: DataFrame, source: DataFrame, keys: Sequence[tuple[str, str]]) -> DataFrame:
    """UPDATE ... FROM with and without the linking condition."""
    t = _key_counts(target, [a for a, _ in keys], "n")
    s = _key_counts(source, [b for _, b in keys], "m")
    n, m = F.col("n"), F.coalesce(F.col("m"), F.lit(0))
    linked = t.join(s, _keys(len(keys)), "left").agg(
        _sum0(n).alias("target_rows"),
        _sum0(F.when(m == 0, n)).alias("untouched_rows"),
        _sum0(F.when(m == 1, n)).alias("updated_once"),
        _sum0(F.when(m > 1, n)).alias("ambiguous_rows"),
    )
    src = s.agg(_sum0(F.col("m")).alias("source_rows"))
    return merge_rows(linked, src).withColumn(
        "unlinked_pairs", (F.col("target_rows").cast(BIG) * F.col("source_rows")).cast(BIG).cast("string")
    )


def dml_blast(df: DataFrame, pred: Column) -> DataFrame:
    """Rows a DELETE or UPDATE touches with and without its predicate."""
    return df.agg(_cnt().alias("rows_without_where"), _cnt(pred).alias("rows_with_where")).withColumn(
        "share_pct",
        F.round(F.col("rows_with_where") * F.lit(100.0) / F.nullif(F.col("rows_without_where"), F.lit(0)), 4),
    )


def boundary_ties(df: DataFrame, order: Sequence[tuple[str, bool]], limit: int, offset: int = 0) -> DataFrame:
    """Is a LIMIT/OFFSET page deterministic? Compares ties inside and outside the page borders."""
    cols = [c for c, _ in order]
    fwd = [F.col(c).asc() if up else F.col(c).desc() for c, up in order]
    # rows per distinct sort key, aggregated map-side; no border lies beyond the first ``limit + offset`` keys
    keys = df.groupBy(*cols).agg(F.count(N).alias("_n")).orderBy(*fwd).limit(limit + offset)
    before = W.orderBy(*fwd).rowsBetween(W.unboundedPreceding, -1)
    keys = keys.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    hit = lambda rows: (F.col("_before") < rows) & (F.col("_before") + F.col("_n") >= rows)

    def edge(rows: int, side: str) -> list[Column]:
        # a table shorter than the border ends inside its last key
        held = F.max(F.when(hit(rows), F.struct("_before", "_n")))
        last = F.max(F.struct("_before", "_n"))
        inside = F.coalesce(F.lit(rows) - held["_before"], last["_n"], F.lit(0))
        total = F.coalesce(held["_n"], last["_n"], F.lit(0))
        return [inside.cast("bigint").alias(side + "_ties_inside"), total.cast("bigint").alias(side + "_ties_total")]

    out = keys.agg(*edge(limit + offset, "end"), *(edge(offset, "start") if offset else []))
    ok = F.col("end_ties_inside") == F.col("end_ties_total")
    if offset:
        ok = ok & (F.col("start_ties_inside") == F.col("start_ties_total"))
    return out.withColumn("deterministic", ok)


def window_ties(df: DataFrame, part: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows whose row_number, lag or lead is arbitrary because the window order ties."""
    g = df.groupBy(*part, *order).agg(F.count(N).alias("n"))
    per_part = g.groupBy(*part).agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("n") > 1, F.col("n"))).alias("tied"),
        F.count_if(F.col("n") > 1).alias("groups"),
    )
    return per_part.agg(
        _sum0(F.col("rows")).alias("rows_total"),
        _sum0(F.col("tied")).alias("tied_rows"),
        _sum0(F.col("groups")).alias("tied_groups"),
        _cnt(F.col("groups") > 0).alias("unstable_partitions"),
    )


def group_dependency(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Per column, the groups in which it is not constant (min/max and null count only)."""
    aggs = [F.count(N).alias("_n")]
    for c in cols:
        aggs += [F.min(c).alias("lo_" + c), F.max(c).alias("hi_" + c), F.count(c).alias("nn_" + c)]
    g = df.groupBy(*keys).agg(*aggs)
    rows = []
    for c in cols:
        nn = F.col("nn_" + c)
        varies = (F.col("lo_" + c) != F.col("hi_" + c)) | ((nn > 0) & (nn < F.col("_n")))
        rows.append(
            F.struct(
                F.lit(c).alias("column_name"),
                _cnt().alias("groups_total"),
                _cnt(F.coalesce(varies, F.lit(False))).alias("groups_varying"),
            )
        )
    return g.agg(F.array(*rows).alias("a")).select(F.inline("a")).withColumn("dependent", F.col("groups_varying") == 0)


def case_coverage(df: DataFrame, branches: dict[str, Column]) -> DataFrame:
    """Rows per first matching branch, rows no branch takes, rows several branches would take."""
    names = list(branches)
    hit = {b: F.coalesce(c, F.lit(False)) for b, c in branches.items()}
    rows, seen = [], F.lit(False)
    for b in names:
        rows.append(F.struct(F.lit(b).alias("branch"), _cnt(hit[b] & ~seen).alias("rows")))
        seen = seen | hit[b]
    many = sum((c.cast("int") for c in hit.values()), F.lit(0)) > 1
    rows.append(F.struct(F.lit("(none)").alias("branch"), _cnt(~seen).alias("rows")))
    rows.append(F.struct(F.lit("(several)").alias("branch"), _cnt(many).alias("rows")))
    return df.agg(F.array(*rows).alias("a")).select(F.inline("a"))


def having_vs_where(df: DataFrame, keys: Sequence[str], value: str, pred: Column) -> DataFrame:
    """A key-only HAVING against the same predicate in WHERE: results and aggregate input."""

    # one pass: per group the aggregate of all its rows, and of those that WHERE lets in
    amount = F.col(value).cast("decimal(18,2)")
    g = df.groupBy(*keys).agg(
        F.count(N).alias("n"), F.sum(amount).alias("s"), F.count_if(pred).alias("wn"), F.sum(F.when(pred, amount)).alias("ws")
    )
    having, where = F.coalesce(pred, F.lit(False)), F.col("wn") > 0
    differs = (having != where) | (having & ((F.col("n") != F.col("wn")) | ~F.col("s").eqNullSafe(F.col("ws"))))
    return g.agg(
        _sum0(F.col("n")).alias("rows_into_having"),
        _sum0(F.col("wn")).alias("rows_into_where"),
        _cnt(where).alias("groups_kept"),
        F.when(F.count_if(differs) == 0, "equivalent").otherwise("different").alias("verdict"),
    )


def distinct_over_group(df: DataFrame, keys: Sequence[str], proj: Sequence[Column]) -> DataFrame:
    """Rows of a grouped projection before and after DISTINCT."""
    g = df.groupBy(*keys).agg(*proj)
    names = [c for c in g.columns if c not in keys]
    per_row = g.groupBy(*names).agg(F.count(N).alias("_copies"))
    return per_row.agg(
        _sum0(F.col("_copies")).alias("rows_before"),
        _cnt().alias("rows_after"),
    ).withColumn("rows_saved", F.col("rows_before") - F.col("rows_after"))


def union_dups(a: DataFrame, b: DataFrame) -> DataFrame:
    """UNION ALL against UNION, and where the duplicates come from."""
    cols = a.columns
    tagged = a.withColumn("_a", F.lit(1)).withColumn("_b", F.lit(0)).unionByName(
        b.withColumn("_a", F.lit(0)).withColumn("_b", F.lit(1))
    )
    g = tagged.groupBy(*cols).agg(F.sum("_a").alias("na"), F.sum("_b").alias("nb"))
    na, nb = F.col("na"), F.col("nb")
    return g.agg(
        _sum0(na + nb).alias("union_all_rows"),
        _cnt().alias("union_rows"),
        _sum0(F.greatest(na - 1, F.lit(0)) + F.greatest(nb - 1, F.lit(0))).alias("dups_within_side"),
        _cnt((na > 0) & (nb > 0)).alias("rows_in_both"),
    )


def pattern_class(p: str) -> str:
    lead, tail = p.startswith("%"), p.endswith("%")
    if lead and tail:
        return "contains"
    return "suffix" if lead else "prefix" if tail else "other"


def like_selectivity(df: DataFrame, col: str, patterns: Sequence[str]) -> DataFrame:
    """Rows matched per LIKE pattern in one pass, with the pattern's class."""
    rows = [
        F.struct(
            F.lit(p).alias("pattern"),
            F.lit(pattern_class(p)).alias("class"),
            _cnt(F.col(col).like(p)).alias("matched_rows"),
            _cnt().alias("rows_total"),
        )
        for p in patterns
    ]
    return df.agg(F.array(*rows).alias("a")).select(F.inline("a"))


_FIXED_WIDTH = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.DateType: 4, T.FloatType: 4}


def _width(f: T.StructField) -> Column:
    if isinstance(f.dataType, (T.StringType, T.BinaryType)):
        return F.octet_length(F.col(f.name))
    if isinstance(f.dataType, T.ArrayType):
        return F.size(F.col(f.name)) * F.lit(_FIXED_WIDTH.get(type(f.dataType.elementType), 8))
    return F.when(F.col(f.name).isNotNull(), F.lit(_FIXED_WIDTH.get(type(f.dataType), 8)))


def column_cost(df: DataFrame, used: Sequence[str]) -> DataFrame:
    """Bytes per column and whether a projection needs them (what SELECT * reads in vain)."""
    rows = [
        F.struct(
            F.lit(f.name).alias("column_name"),
            F.lit(f.name in used).alias("used"),
            _sum0(_width(f)).alias("bytes"),
        )
        for f in df.schema.fields
    ]
    return df.agg(F.array(*rows).alias("a")).select(F.inline("a"))


def sargable_check(df: DataFrame, wrapped: Column, raw: Column) -> DataFrame:
    """Does the raw-range predicate keep the same rows as the wrapped one?"""
    w, r = F.coalesce(wrapped, F.lit(False)), F.coalesce(raw, F.lit(False))
    return df.agg(
        _cnt(w).alias("wrapped_rows"),
        _cnt(r).alias("raw_rows"),
        _cnt(w & ~r).alias("only_wrapped"),
        _cnt(~w & r).alias("only_raw"),
    ).withColumn("same_rows", (F.col("only_wrapped") == 0) & (F.col("only_raw") == 0))


def append_check(target: DataFrame, source: DataFrame) -> DataFrame:
    """Source rows that change under a positional append, per target column."""
    if len(target.columns) != len(source.columns):
        raise ValueError("positional append needs equal column counts")
    rows = []
    for i, c in enumerate(target.columns):
        pos = F.col(source.columns[i]).cast("string")
        byname = F.col(c).cast("string") if c in source.columns else F.lit(None).cast("string")
        rows.append(
            F.struct(
                F.lit(c).alias("target_column"),
                F.lit(source.columns[i]).alias("filled_from"),
                _cnt(~pos.eqNullSafe(byname)).alias("corrupted_rows"),
                _cnt().alias("source_rows"),
            )
        )
    return source.agg(F.array(*rows).alias("a")).select(F.inline("a"))


def ambiguous_columns(tables: dict[str, DataFrame]) -> DataFrame:
    """Column names living in two or more tables, with the values at stake in each."""
    owners: dict[str, list[str]] = {}
    for t, df in tables.items():
        for c in df.columns:
            owners.setdefault(c.lower(), []).append(t)
    shared = {c for c, ts in owners.items() if len(ts) > 1}
    parts = []
    for t, df in tables.items():
        cols = [c for c in df.columns if c.lower() in shared]
        if cols:
            rows = [
                F.struct(
                    F.lit(c.lower()).alias("column_name"),
                    F.lit(t).alias("table_name"),
                    _cnt(F.col(c).isNotNull()).alias("filled_rows"),
                )
                for c in cols
            ]
            parts.append(df.agg(F.array(*rows).alias("a")).select(F.inline("a")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("column_name").agg(
        F.array_join(F.array_sort(F.collect_list("table_name")), ",").alias("tables"),
        F.count(N).alias("table_count"),
        F.sum("filled_rows").alias("filled_rows"),
    )


def resolve_ordinals(columns: Sequence[str], items: Sequence[int | str | tuple[int | str, bool]]) -> list[Column]:
    """Turn ORDER BY positions (1-based) into named sort keys."""
    out = []
    for it in items:
        ref, up = it if isinstance(it, tuple) else (it, True)
        name = columns[ref - 1] if isinstance(ref, int) else ref
        if name not in columns:
            raise ValueError(f"unknown sort column {name}")
        out.append(F.col(name).asc() if up else F.col(name).desc())
    return out


def inner_sort_noop(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """An inner ORDER BY without LIMIT leaves the multiset as it is: rows against rows sorted inside their partitions."""
    return verify_equal(df, df.sortWithinPartitions(*order))
