"""Exact work-splitting for groups that are too big for one task.

A window ``PARTITION BY key ORDER BY ts`` sends each key to one task. When one
key owns a third of the rows that task never finishes. The helpers below cut
each key's ordered rows into range blocks, work inside the blocks in parallel,
and repair the block borders with tiny per-block tables.

Size bound used for broadcasts here: range blocks are contiguous in
``(key, order)``, hence at most two keys of a block continue in a neighbour and
the table of "keys that span several blocks" has at most ``2 * blocks`` rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from queryscope.session import cut

BLK = "_blk"
#: rows of one key that may share a task in ``frame_buckets``
BUCKET_ROWS = 1_000_000


def merge_rows(*frames: DataFrame) -> DataFrame:
    """Lay one-row frames with different columns side by side (no cross join)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])


def range_blocks(df: DataFrame, keys: Sequence[Column | str]) -> DataFrame:
    """Range-partition by ``keys`` and write the block number into ``_blk``.

    Materialised once: block borders come from sampling, so two evaluations
    could disagree.
    """
    return cut(df.repartitionByRange(*keys).withColumn(BLK, F.spark_partition_id()))


def _combine(fn: str, a: Column, b: Column) -> Column:
    if fn == "sum":
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return (F.least if fn == "min" else F.greatest)(a, b)


def running(
    df: DataFrame,
    part: Sequence[str],
    order: str,
    specs: dict[str, tuple[str, str]],
    descending: bool = False,
    strict: bool = True,
) -> DataFrame:
    """Running aggregate per ``part`` in ``order`` (unique per part), split by blocks.

    ``specs`` maps an output name to ``(sum|min|max, column)``. ``strict`` leaves
    the own row out. ``df`` must come from ``range_blocks(df, part + [order])``.
    """
    o = F.col(order).desc() if descending else F.col(order).asc()
    local = W.partitionBy(*part, BLK).orderBy(o).rowsBetween(W.unboundedPreceding, -1 if strict else 0)
    rows = df
    for out, (fn, col) in specs.items():
        rows = rows.withColumn("_l_" + out, getattr(F, fn)(col).over(local))

    totals = df.groupBy(*part, BLK).agg(*[getattr(F, fn)(c).alias("_t_" + out) for out, (fn, c) in specs.items()])
    spread = W.partitionBy(*part)
    bo = F.col(BLK).desc() if descending else F.col(BLK).asc()
    before = spread.orderBy(bo).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumn("_n", F.count(F.lit(1)).over(spread)).where("_n > 1")
    for out, (fn, _) in specs.items():
        totals = totals.withColumn("_o_" + out, getattr(F, fn)("_t_" + out).over(before))
    offsets = totals.select(*part, BLK, *["_o_" + o_ for o_ in specs])

    cond = [rows[p].eqNullSafe(offsets[p]) for p in part] + [rows[BLK] == offsets[BLK]]
    joined = rows.join(F.broadcast(offsets), cond, "left")
    keep = [rows[c] for c in df.columns if c != BLK]
    return joined.select(
        *keep,
        *[_combine(fn, F.col("_l_" + out), F.col("_o_" + out)).alias(out) for out, (fn, _) in specs.items()],
    )


def _changes(b: pa.RecordBatch, columns: Sequence[str], last: tuple | None) -> np.ndarray:
    """Whether each row differs from the one before it in some column; ``last``: the values before the first row."""
    new = np.zeros(b.num_rows, bool)
    for c in columns:
        codes = b.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    new[0] = last != tuple(b.column(c)[0].as_py() for c in columns)
    return new


def _since(new: np.ndarray, before: int) -> np.ndarray:
    """Rows since the last change, 0-based; ``before``: rows of the first run that came earlier."""
    at = np.arange(len(new))
    start = np.maximum.accumulate(np.where(new, at, -before))
    return at - start


def _count_locally(part: Sequence[str], keys: Sequence[str]):
    """For ``mapInArrow`` over sorted keys: block, place in the block's part, place among equal keys; then a total for the first
    and the last part of the block (place among equals: -1), which may go on in other blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, rows, same = TaskContext.get().partitionId(), 0, 0
        last_part = last_key = schema = None
        ends: list[tuple[pa.RecordBatch, int]] = []  # first row and number of rows of the first and the last part

        def out(b: pa.RecordBatch, k: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
            n = b.num_rows
            extra = [pa.array(np.full(n, block, np.int32)), pa.array(k.astype(np.int64)), pa.array(d.astype(np.int64))]
            return pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*b.schema.names, BLK, "_k", "_d"])

        for b in batches:
            if not b.num_rows:
                continue
            new = _changes(b, part, last_part)
            k = _since(new, rows)
            d = _since(new | _changes(b, keys, last_key), same)
            yield out(b, k, d)
            starts = np.flatnonzero(new)
            if ends and not new[0]:
                ends[-1] = (ends[-1][0], int(k[starts[0] - 1] if len(starts) else k[-1]) + 1)
            for at, stop in [(starts[0], starts[1] if len(starts) > 1 else b.num_rows), (starts[-1], b.num_rows)] if len(starts) else []:
                entry = (b.slice(at, 1), int(stop - at))
                ends = [*ends[:1], entry]
            rows, same = int(k[-1]) + 1, int(d[-1]) + 1
            last_part, last_key = (tuple(b.column(c)[-1].as_py() for c in x) for x in (part, keys))
        for b, n in ends:
            yield out(b, np.array([n]), np.array([-1]))

    return run


def _named(df: DataFrame, order: Sequence[str | Column | tuple[str, bool]]) -> list[tuple[str, bool]]:
    """(name, ascending) of each order column; a bare name is ascending, a column may say ``asc()`` or ``desc()``."""

    def one(x: str | Column | tuple[str, bool]) -> tuple[str, bool]:
        if isinstance(x, tuple):
            return x
        shown = x if isinstance(x, str) else str(x)[len("Column<'") : -len("'>")]
        name, _, direction = shown.partition(" ")
        if name not in df.columns:
            raise ValueError(f"{shown} is no column of the table")
        return name, not direction.startswith("DESC")

    return [one(x) for x in order]


def number_keys(df: DataFrame, part: Sequence[str], order: Sequence[str | Column | tuple[str, bool]], name: str = "rn") -> DataFrame:
    """(part, order columns, ``_d``, name): ``row_number`` per ``part``, on keys alone; ``_d`` counts equal keys from 0.

    Only keys are range-partitioned and checkpointed. A task counts its sorted keys; parts that span blocks are repaired from
    at most two totals per block, the only thing broadcast.
    """
    order = _named(df, order)
    keys = list(dict.fromkeys([*part, *[c for c, _ in order]]))
    cols = [F.col(c).asc_nulls_first() for c in part] + [F.col(c).asc() if up else F.col(c).desc() for c, up in order]
    slim = df.select(*keys)
    slim = slim.repartitionByRange(*cols).sortWithinPartitions(*cols)
    schema = T.StructType([*slim.schema.fields, T.StructField(BLK, T.IntegerType()), T.StructField("_k", T.LongType()), T.StructField("_d", T.LongType())])
    found = cut(slim.mapInArrow(_count_locally(list(part), keys), schema))
    spread = W.partitionBy(*part) if part else W.partitionBy(F.lit(0))
    ends = found.where("_d < 0").groupBy(*part, BLK).agg(F.max("_k").alias("_t"))
    ends = ends.withColumn("_o", F.sum("_t").over(spread.orderBy(BLK).rowsBetween(W.unboundedPreceding, -1))).where("_o > 0")
    ends = ends.select(*[F.col(c).alias("_p_" + c) for c in part], F.col(BLK).alias("_b"), "_o")
    cond = [F.col(c).eqNullSafe(F.col("_p_" + c)) for c in part] + [F.col(BLK) == F.col("_b")]
    rows = found.where("_d >= 0").join(F.broadcast(ends), cond, "left")
    return rows.select(*keys, "_d", (F.col("_k") + F.lit(1) + F.coalesce("_o", F.lit(0))).cast("bigint").alias(name))


def with_numbers(df: DataFrame, numbers: DataFrame, name: str, few: bool = False) -> DataFrame:
    """The rows of ``df`` that ``numbers`` (from ``number_keys``) names; rows with equal keys are told apart by their count.

    ``few``: the caller has bounded ``numbers``, so it may be broadcast.
    """
    keys = [c for c in numbers.columns if c not in ("_d", name)]
    named = numbers.select(*[F.col(c).alias("_n_" + c) for c in keys], F.col("_d").alias("_n_d"), name)
    if few:  # drop what no number names before equal keys are counted
        wanted = named.select(*["_n_" + c for c in keys]).distinct()
        df = df.join(F.broadcast(wanted), [F.col(c).eqNullSafe(F.col("_n_" + c)) for c in keys], "left_semi")
    rows = df.withColumn("_d", F.row_number().over(W.partitionBy(*keys).orderBy(F.lit(0))) - 1)
    cond = [rows[c].eqNullSafe(named["_n_" + c]) for c in keys] + [rows["_d"] == named["_n_d"]]
    return rows.join(named, cond).select(*[rows[c] for c in df.columns], name)


def numbered(df: DataFrame, part: Sequence[str], order: Sequence[str | Column | tuple[str, bool]], name: str = "rn") -> DataFrame:
    """``row_number`` per ``part`` over ``order`` (names, columns, or name and ascending), exact for hot parts; the payload is shuffled once and never written.

    Rows that are equal in part and order are numbered in any order. With a total order each row meets its number by its key.
    """
    return with_numbers(df, number_keys(df, part, order, name), name)


def frame_buckets(df: DataFrame, rn: str, before: int, after: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Cut numbered rows into buckets and copy the border rows a frame needs.

    Adds ``_bucket`` and ``_own`` (false for a border copy). A window
    ``PARTITION BY part, _bucket ORDER BY rn`` then sees every row its frame
    reaches, and rows with ``_own`` carry the exact result.
    """
    bucket_rows = max(bucket_rows, 2 * max(before, after))  # a frame never reaches beyond the neighbouring bucket
    b = F.floor((F.col(rn) - 1) / F.lit(bucket_rows))
    inside = F.pmod(F.col(rn) - 1, F.lit(bucket_rows))
    homes = F.array_compact(
        F.array(
            b,
            F.when(inside >= bucket_rows - before, b + 1),
            F.when((inside < after) & (b > 0), b - 1),
        )
    )
    return (
        df.withColumn("_home", b)
        .withColumn("_bucket", F.explode(homes))
        .withColumn("_own", F.col("_home") == F.col("_bucket"))
        .drop("_home")
    )
