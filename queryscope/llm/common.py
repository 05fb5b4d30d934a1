"""What the corpus operators share: session settings, held-out folds, bounded samples, numbering without a window."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from queryscope.session import cut, ensure_checkpoint_dir

#: rows handed to Python at once; with whole texts of a few kB this is a few MB
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the operators count on: adaptive plans, skewed joins dealt anew, small Arrow batches."""
    for key, value in {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS),
        "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
    }.items():
        spark.conf.set(key, value)
    return spark


def fold(key: Column, parts: int) -> Column:
    """Fold number of a row: crc32 of the key as text."""
    return F.crc32(key.cast("string").cast("binary")) % parts


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows picked by a hash of ``key``, or all if there are no more. One narrow count, no sort."""
    total = df.select(key).count()
    if total <= rows:
        return df
    span = 1 << 30
    return df.where(F.pmod(F.xxhash64(F.col(key)), F.lit(span)) < int(span * (rows / total)))


def give_back() -> None:
    """Return memory that is free again to the system; the allocators of Arrow and C keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for tasks whose worker goes on to other operators: what the task held is given back when it ends."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return task


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """Texts of a batch, null as the empty text."""
    return pc.fill_null(batch.column(column), "").to_pylist()


def replace_columns(batch: pa.RecordBatch, keep: list[str], **new: pa.Array) -> pa.RecordBatch:
    """``keep`` of the batch, then the new columns."""
    return pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + list(new.values()), names=[*keep, *new])


class Recent:
    """A bounded memory (``now``) with an older generation: once full, what was not used since the last turn is forgotten."""

    def __init__(self, limit: int):
        self.limit, self.now, self.old = limit, {}, {}

    def unknown(self, keys: set) -> list:
        """Those of ``keys`` that have no entry, after room was made for all and older entries were taken over."""
        missing = keys.difference(self.now)
        if len(self.now) + len(missing) > self.limit:
            self.now, self.old = {}, self.now
            missing = keys
        out, now, old = [], self.now, self.old
        for k in missing:
            v = old.get(k)
            if v is None:
                out.append(k)
            else:
                now[k] = v
        return out


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _running(keys: pa.Array, values: np.ndarray, seen: dict, ordered: bool) -> np.ndarray:
    """Sum of the earlier values of each row's key, ``seen`` included and brought up to date; ``ordered`` rows forget finished keys."""
    coded = keys.dictionary_encode(null_encoding="encode")
    codes, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
    order = np.argsort(codes, kind="stable")
    sums = np.cumsum(values[order])
    ends = np.flatnonzero(np.r_[codes[order][1:] != codes[order][:-1], True])
    totals = np.diff(sums[ends], prepend=0)
    sizes = np.diff(ends, prepend=-1)
    known = np.array([seen.get(n, 0) for n in names], np.int64)
    out = np.empty(len(codes), np.int64)
    out[order] = sums - values[order] - np.repeat(sums[ends] - totals, sizes) + np.repeat(known, sizes)
    if ordered:
        seen.clear()
        seen[names[codes[-1]]] = int(known[codes[-1]] + totals[codes[-1]])
    else:
        seen.update(zip(names, (known + totals).tolist()))
    return out


def numbered_locally(df: DataFrame, group: str, value: str | None = None, ordered: bool = False) -> DataFrame:
    """Add ``_tid`` (task) and ``_k`` (0.. per task and ``group``, or the sum of the earlier ``value``) in one pass.

    The rows are written to the checkpoint folder before anything depends on the numbers, so a lost executor cannot change
    them. ``ordered``: the rows of a group are neighbours, so a task remembers one group at a time.
    """
    names = df.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tid, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            if b.num_rows:
                values = b.column(value).to_numpy(zero_copy_only=False) if value else np.ones(b.num_rows, np.int64)
                ks = _running(b.column(group), values, seen, ordered)
                yield replace_columns(b, names, _tid=pa.array(np.full(b.num_rows, tid, np.int32)), _k=pa.array(ks))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return cut(df.mapInArrow(lean(number), f"{schema}, _tid int, _k bigint"))


def with_rank(rows: DataFrame, group: str, name: str, value: str | None = None, ordered: bool = False) -> DataFrame:
    """``name``: 0.. without gaps per ``group`` of rows from ``numbered_locally``, or the sum of the earlier ``value``.

    Only one row per task and group is ordered; the rows themselves meet their offset in an equi-join. Where a group's rows
    are neighbours (``ordered``), only a task's first and last group can go on elsewhere: those at most two rows per task are broadcast.
    """
    sizes = rows.groupBy(group, "_tid").agg((F.sum(value) if value else F.count(F.lit(1))).alias("_n"))
    spread = W.partitionBy(group)
    before = spread.orderBy("_tid").rowsBetween(W.unboundedPreceding, -1)
    if ordered:
        sizes = sizes.withColumn("_c", F.count(F.lit(1)).over(spread)).where("_c > 1")
    sizes = sizes.select(
        F.col(group).alias("_g"), F.col("_tid").alias("_t"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o")
    )
    met = rows[group].eqNullSafe(sizes["_g"]) & (rows["_tid"] == sizes["_t"])
    joined = rows.join(F.broadcast(sizes) if ordered else sizes, met, "left")
    return joined.withColumn(name, (F.col("_k") + F.coalesce("_o", F.lit(0))).cast("bigint")).drop("_g", "_t", "_o", "_tid", "_k")


def kept(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows, written as a Parquet table in the shared checkpoint folder and read back column by column; and where they lie."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame) -> DataFrame:
    """The rows, written as a Parquet table in the shared checkpoint folder: computed once, whatever executor is lost later."""
    return kept(df)[0]


def forget(spark: SparkSession, path: str) -> None:
    """Remove a table of ``kept`` that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
