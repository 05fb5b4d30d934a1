"""Correct set-based forms of the constructs the audits and rules warn about."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from queryscope.plans.skew import frame_buckets, number_keys, numbered, range_blocks, running, with_numbers

N = "*"
OPS = (">", "<", "!=")


def correlated_agg(df: DataFrame, group: str, value: str, op: str, agg: str, arg: str | None = None, out: str = "result") -> DataFrame:
    """``(SELECT agg(arg) FROM df i WHERE i.group = o.group AND i.value op o.value)`` per row.

    No self join on the inequality: rows shrink to one per (group, value), a
    running aggregate over those answers every comparison, and one equi join
    brings the answer back. A NULL group or value compares with nothing and
    gets the empty-set result (COUNT 0, others NULL).
    """
    agg = agg.upper()
    if op not in OPS or agg not in ("COUNT", "SUM", "AVG", "MIN", "MAX"):
        raise ValueError(f"unsupported {agg} / {op}")
    a = F.col(arg) if arg else N
    known = df.where(F.col(group).isNotNull() & F.col(value).isNotNull())
    pre = known.groupBy(F.col(group).alias("_g"), F.col(value).alias("_v")).agg(
        F.count(a).alias("_c"),
        *([F.sum(a).alias("_s")] if agg in ("SUM", "AVG") else []),
        *([F.min(a).alias("_lo")] if agg == "MIN" else []),
        *([F.max(a).alias("_hi")] if agg == "MAX" else []),
    )
    specs = {"_rc": ("sum", "_c")}
    if agg in ("SUM", "AVG"):
        specs["_rs"] = ("sum", "_s")
    if agg == "MIN":
        specs["_rm"] = ("min", "_lo")
    if agg == "MAX":
        specs["_rm"] = ("max", "_hi")

    blocks = range_blocks(pre, ["_g", "_v"])
    if op != "!=":
        res = running(blocks, ["_g"], "_v", specs, descending=op == ">")
    else:
        below = running(blocks, ["_g"], "_v", specs)
        above = running(blocks, ["_g"], "_v", {k + "_up": s for k, s in specs.items()}, descending=True)
        res = below.join(above.select("_g", "_v", *[k + "_up" for k in specs]), ["_g", "_v"], "inner")
        for k, (fn, _) in specs.items():
            lo, up = F.col(k), F.col(k + "_up")
            both = lo + up if fn == "sum" else (F.least if fn == "min" else F.greatest)(lo, up)
            res = res.withColumn(k, both)

    cnt = F.col("_rc").cast("bigint")
    if agg == "COUNT":
        answer = cnt
    elif agg == "SUM":
        answer = F.when(cnt > 0, F.col("_rs"))
    elif agg == "AVG":
        answer = F.when(cnt > 0, F.col("_rs").cast("double") / cnt)
    else:
        answer = F.col("_rm")
    res = res.select("_g", "_v", answer.alias(out))
    joined = df.join(res, [df[group] == res["_g"], df[value] == res["_v"]], "left").drop("_g", "_v")
    return joined.withColumn(out, F.coalesce(F.col(out), F.lit(0))) if agg == "COUNT" else joined


def decorrelation_check(df: DataFrame, group: str, value: str) -> DataFrame:
    """The naive decorrelated COUNT (group count gated by the group maximum) against the exact one."""
    exact = correlated_agg(df, group, value, ">", "COUNT", out="exact")
    g = df.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("_g")).agg(
        F.count(N).alias("_n"), F.max(value).alias("_mx")
    )
    j = exact.join(g, exact[group] == g["_g"], "left")
    naive = F.when(F.col("_mx") > F.col(value), F.col("_n")).otherwise(F.lit(0))
    return j.select(naive.cast("bigint").alias("naive"), F.col("exact")).agg(
        F.count(N).alias("rows_total"),
        F.count_if(F.col("naive") != F.col("exact")).alias("rows_wrong"),
        F.coalesce(F.sum(F.abs(F.col("naive") - F.col("exact"))), F.lit(0)).cast("bigint").alias("count_error"),
    )


def exists_greater(df: DataFrame, group: str, value: str) -> DataFrame:
    """Rows for which some row of the same group has a greater value."""
    g = df.groupBy(F.col(group).alias("_g")).agg(F.max(value).alias("_mx"))
    return df.join(g, (df[group] == g["_g"]) & (g["_mx"] > df[value]), "left_semi")


def in_filtered(left: DataFrame, lk: str, right: DataFrame, rk: str, pred: Column) -> DataFrame:
    """``lk IN (SELECT rk FROM right WHERE pred)``."""
    r = right.where(pred).select(F.col(rk).alias("_k")).distinct()
    return left.join(r, left[lk] == r["_k"], "left_semi")


def in_correlated(
    left: DataFrame, right: DataFrame, key: str, group: str, value: str, op: str = ">", negated: bool = False
) -> DataFrame:
    """``key [NOT] IN (SELECT key FROM right i WHERE i.group = o.group AND i.value op o.value)``.

    One row per (group, key) holding the extreme value decides each comparison,
    with SQL's NULL rules for NOT IN.
    """
    best = {">": F.max, "<": F.min}[op]
    wins = (lambda x, own: x > own) if op == ">" else (lambda x, own: x < own)
    known = right.where(F.col(group).isNotNull() & F.col(value).isNotNull())
    per_key = known.groupBy(F.col(group).alias("_g"), F.col(key).alias("_k")).agg(best(value).alias("_x"))
    if not negated:
        cond = (left[group] == per_key["_g"]) & (left[key] == per_key["_k"]) & wins(per_key["_x"], left[value])
        return left.join(per_key, cond, "left_semi")
    per_group = known.groupBy(F.col(group).alias("_g")).agg(
        best(value).alias("_any"), best(F.when(F.col(key).isNull(), F.col(value))).alias("_nul")
    )
    cols = left.columns
    pk = per_key.where("_k IS NOT NULL")
    j = left.join(pk, (left[group] == pk["_g"]) & (left[key] == pk["_k"]), "left").drop("_g")
    j = j.join(per_group, j[group] == per_group["_g"], "left")
    yes = lambda c: F.coalesce(wins(F.col(c), F.col(value)), F.lit(False))
    keep = ~yes("_x") & ~yes("_nul") & (F.col(key).isNotNull() | ~yes("_any"))
    return j.where(keep).select(*cols)


def multi_eq_count(df: DataFrame, keys: Sequence[str], out: str = "n") -> DataFrame:
    """Rows sharing all keys; a NULL in any key gives 0."""
    g = df.dropna(subset=list(keys)).groupBy(*[F.col(k).alias("_" + k) for k in keys]).agg(F.count(N).alias(out))
    j = df.join(g, [df[k] == g["_" + k] for k in keys], "left").drop(*["_" + k for k in keys])
    return j.withColumn(out, F.coalesce(F.col(out), F.lit(0)))


def not_exists(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]]) -> DataFrame:
    """Left rows without a partner; NULL keys are kept."""
    r = right.select(*[F.col(b).alias(f"_k{i}") for i, (_, b) in enumerate(on)]).distinct()
    return left.join(r, [left[a] == r[f"_k{i}"] for i, (a, _) in enumerate(on)], "left_anti")


def outer_join_on(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], pred: Column, how: str = "left") -> DataFrame:
    """Outer join with the optional side's predicate moved into ON (filtered before a left join)."""
    if how != "left":
        cond = pred
        for a, b in on:
            cond = cond & (left[a] == right[b])
        return left.join(right, cond, how)
    r = right.where(pred)
    return left.join(r, [left[a] == r[b] for a, b in on], "left")


def in_days(df: DataFrame, ts: str, lo: str, hi: str) -> DataFrame:
    """Whole days lo..hi, as a half-open range that reaches the scan."""
    return df.where(
        (F.col(ts) >= F.lit(lo).cast("timestamp"))
        & (F.col(ts) < F.lit(hi).cast("timestamp") + F.expr("INTERVAL 1 DAY"))
    )


def _sort(order: Sequence[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).asc() if up else F.col(c).desc() for c, up in order]


#: rows up to which a page is taken from the sorted head of the table
HEAD_ROWS = 100_000


def page(df: DataFrame, order: Sequence[tuple[str, bool]], tiebreak: Sequence[str], limit: int, offset: int = 0, head_rows: int = HEAD_ROWS) -> DataFrame:
    """A page that is the same on every run: total order, then offset and limit.

    A deep page is found by rank: keys alone are range-partitioned and counted, and only the rows that the page holds are
    fetched and sorted. No task reads ``limit + offset`` rows.
    """
    total = [*order, *[(c, True) for c in tiebreak]]
    if limit + offset <= head_rows:
        d = df.orderBy(*_sort(total))
        return (d.offset(offset) if offset else d).limit(limit)
    ranked = number_keys(df, [], total, "_rank").where((F.col("_rank") > offset) & (F.col("_rank") <= offset + limit))
    rows = with_numbers(df, ranked, "_rank", few=limit <= head_rows)
    return rows.orderBy("_rank").drop("_rank")


def ordered_window(
    df: DataFrame, part: Sequence[str], order: Sequence[tuple[str, bool]], tiebreak: Sequence[str], value: str
) -> DataFrame:
    """row_number, lag and lead over a total order, for parts of any size."""
    d = numbered(df, part, [*order, *[(c, True) for c in tiebreak]])
    d = frame_buckets(d, "rn", 1, 1)
    w = W.partitionBy(*part, "_bucket").orderBy("rn")
    d = d.withColumn("prev_value", F.lag(value).over(w)).withColumn("next_value", F.lead(value).over(w))
    return d.where("_own").drop("_bucket", "_own")


def moving_sum(df: DataFrame, part: Sequence[str], order: Sequence[str | Column], value: str, n: int, out: str) -> DataFrame:
    """``sum(value) OVER (PARTITION BY part ORDER BY order ROWS n PRECEDING)`` for parts of any size."""
    d = frame_buckets(numbered(df, part, order), "rn", n, 0)
    w = W.partitionBy(*part, "_bucket").orderBy("rn").rowsBetween(-n, 0)
    return d.withColumn(out, F.sum(value).over(w)).where("_own").drop("_bucket", "_own", "rn")


def agg_of_window(df: DataFrame, part: str, value: str, outer_keys: Sequence[str]) -> DataFrame:
    """``SUM(AVG(value) OVER (PARTITION BY part)) GROUP BY outer_keys`` in two steps.

    The window value is constant per part, so counts per (outer keys, part) and
    one average per part give the same sum without a window.
    """
    cells = df.groupBy(*outer_keys, part).agg(F.count(N).alias("_n"), F.sum(value).alias("_s"), F.count(value).alias("_c"))
    avg = cells.groupBy(F.col(part).alias("_p")).agg((F.sum("_s") / F.sum("_c")).alias("_avg"))
    j = cells.join(avg, cells[part].eqNullSafe(avg["_p"]), "left")
    return j.groupBy(*outer_keys).agg(F.sum(F.col("_avg") * F.col("_n")).alias("sum_of_avg"))


def resolve_source(source: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One source row per key: the first in ``order`` (a map-side-combined min_by)."""
    rest = [c for c in source.columns if c not in keys]
    return source.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def update_from(
    target: DataFrame, source: DataFrame, keys: Sequence[tuple[str, str]], sets: dict[str, str], order: Sequence[str]
) -> DataFrame:
    """UPDATE target SET ... FROM source with a link; several source rows resolve by ``order``."""
    sk = [b for _, b in keys]
    s = resolve_source(source.select(*dict.fromkeys([*sk, *sets.values(), *order])), sk, order)
    s = s.select(*[F.col(c).alias("_s_" + c) for c in s.columns]).withColumn("_hit", F.lit(True))
    j = target.join(s, [target[a] == s["_s_" + b] for a, b in keys], "left")
    return j.select(
        *[
            (F.when(F.col("_hit"), F.col("_s_" + sets[c])).otherwise(F.col(c)).alias(c) if c in sets else F.col(c))
            for c in target.columns
        ],
        F.coalesce(F.col("_hit"), F.lit(False)).alias("updated"),
    )


def ambiguous_keys(source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with several source rows, which a MERGE rejects."""
    return source.groupBy(*keys).agg(F.count(N).alias("source_rows")).where("source_rows > 1")


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """MERGE: matched rows take the source's values, unmatched source rows are inserted.

    Several source rows of a key resolve to the first in ``order`` (all other columns if not given), so that no target
    row is multiplied. Written as left join + anti join, so that a hot target key can be split at run time (a full outer
    join could not).
    """
    rest = [c for c in source.columns if c not in keys]
    if rest:
        source = resolve_source(source, keys, order or rest).select(*source.columns)
    else:
        source = source.distinct()
    s = source.select(*[F.col(c).alias("_s_" + c) for c in source.columns]).withColumn("_hit", F.lit(True))
    j = target.join(s, [target[k] == s["_s_" + k] for k in keys], "left")
    changed = j.select(
        *[
            (
                F.when(F.col("_hit"), F.col("_s_" + c)).otherwise(F.col(c)).alias(c)
                if c in source.columns and c not in keys
                else F.col(c)
            )
            for c in target.columns
        ],
        F.when(F.col("_hit"), "updated").otherwise("kept").alias("action"),
    )
    tk = target.select(*keys).distinct()
    fresh = source.join(tk, list(keys), "left_anti").withColumn("action", F.lit("inserted"))
    return changed.unionByName(fresh, allowMissingColumns=True).select(*target.columns, "action")


def append_by_name(target: DataFrame, source: DataFrame) -> DataFrame:
    return target.unionByName(source, allowMissingColumns=True)


def case_else(df: DataFrame, branches: Sequence[tuple[Column, Column]], default, out: str) -> DataFrame:
    """CASE with an explicit ELSE."""
    (c0, v0), rest = branches[0], branches[1:]
    expr = F.when(c0, v0)
    for c, v in rest:
        expr = expr.when(c, v)
    return df.withColumn(out, expr.otherwise(default))


def self_join(df: DataFrame, on, how: str = "inner") -> DataFrame:
    """Self join under the aliases ``l`` and ``r``; ``on`` builds the condition from both."""
    return df.alias("l").join(df.alias("r"), on(F, "l", "r"), how)


def filtered_agg(df: DataFrame, keys: Sequence[str], pred: Column, value: str) -> DataFrame:
    """``COUNT(*) FILTER (WHERE pred)`` and ``SUM(value) FILTER (WHERE pred)``."""
    return df.groupBy(*keys).agg(
        F.count(N).alias("rows_total"),
        F.count_if(pred).alias("rows_filtered"),
        F.sum(F.when(pred, F.col(value))).alias("sum_filtered"),
    )


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """DISTINCT ON / QUALIFY row_number() = 1: one map-side-combined max_by per key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def pivot_sum(df: DataFrame, keys: Sequence[str], col: str, vals: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).pivot(col, list(vals)).agg(F.sum(value))


def explode_items(df: DataFrame, keys: Sequence[str], arr: str) -> DataFrame:
    return df.select(*keys, F.posexplode(arr).alias("pos", "item"))


def json_field(df: DataFrame, col: str, path: str, out: str) -> DataFrame:
    return df.withColumn(out, F.get_json_object(col, path))


def top_structs(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]], fields: Sequence[str], n: int = 5) -> DataFrame:
    """``ARRAY_AGG(STRUCT(...) ORDER BY ... LIMIT n)``.

    The rank filter runs before the shuffle too (window group limit), so a hot
    key sends at most n rows per task.
    """
    w = W.partitionBy(*keys).orderBy(*_sort(order))
    top = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    return top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_rn", *fields))).alias("_a")).select(
        *keys, F.transform("_a", lambda s: F.struct(*[s[f].alias(f) for f in fields])).alias("items")
    )


def string_agg(df: DataFrame, keys: Sequence[str], col: str, sep: str = ",") -> DataFrame:
    """GROUP_CONCAT / STRING_AGG / LISTAGG of the distinct values, in order.

    Duplicates collapse in a partial aggregate first; what reaches the string
    is one entry per distinct value.
    """
    d = df.where(F.col(col).isNotNull()).select(*keys, col).distinct()
    return d.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(col)), sep).alias("joined"))
