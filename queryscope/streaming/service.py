"""Service-log operators: limiter, hit rates, keys, history, and linting of arriving files.

Batch forms come first; the stream forms keep the same semantics.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from queryscope.functions.scalars import snippet
from queryscope.plans.skew import numbered
from queryscope.session import cut, ensure_checkpoint_dir

# Limiter and key lifetimes.
RATE_LIMIT = 60
RATE_WINDOW_S = 600
PLAN_DAYS = {"monthly": 30, "annual": 365}
REMINDER_DAYS = 3
KEY_PREFIX = "live_"
HISTORY_MAX = 30

#: rows of one client that a limiter task holds at once
BLOCK_ROWS = 500_000


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _event_time(df: DataFrame, ts: str, late: str) -> DataFrame:
    """Watermark for streams; event time must be an instant."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if df.isStreaming else df


def _judge(times: np.ndarray, kept: list[int], limit: int, window_us: int) -> tuple[np.ndarray, list[int]]:
    """(accepted flags, last accepted times) for hits in time order after the accepted times ``kept``.

    While ``limit`` accepted hits lie inside the window nothing is accepted, so the walk jumps to the first later hit.
    """
    ok, kept, i = np.zeros(len(times), bool), list(kept), 0
    while i < len(times):
        if len(kept) >= limit and times[i] - kept[-limit] <= window_us:
            i = int(np.searchsorted(times, kept[-limit] + window_us, "right"))
            continue
        ok[i] = True
        kept.append(int(times[i]))
        i += 1
    return ok, kept[-limit:]


def throttle(
    df: DataFrame, key: str, ts: str, tie: str, limit: int = RATE_LIMIT, window_s: int = RATE_WINDOW_S, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Sliding-log limiter over a table: adds ``accepted``; rejected hits do not count later.

    A decision depends on the accepted hits before it, so a client is walked in order, cut into blocks of ``block_rows``.
    All blocks are walked at first as if nothing had come before; then a block is walked again only if the state that
    its predecessor hands over has changed. A state is at most ``limit`` times.
    """
    window_us = window_s * 1_000_000
    rows = numbered(df.withColumn("_us", _micros(ts)), [key], [("_us", True), (tie, True)], "_rn")
    rows = cut(rows.withColumn("_blk", F.floor((F.col("_rn") - 1) / F.lit(block_rows))))
    kt = df.schema[key].dataType
    state_schema = T.StructType([T.StructField(key, kt), T.StructField("_blk", T.LongType()), T.StructField("_st", T.ArrayType(T.LongType()))])
    out_schema = T.StructType([*df.schema.fields, T.StructField("accepted", T.BooleanType())])
    names, parts = df.columns, [key, "_blk"]

    def walk(block: pd.DataFrame, state: pd.DataFrame) -> tuple[pd.DataFrame, list[int]]:
        block = block.sort_values("_rn")
        ok, kept = _judge(block["_us"].to_numpy(), list(state["_st"].iloc[0]) if len(state) else [], limit, window_us)
        return block.assign(accepted=ok), kept

    def decide(block: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        return walk(block, state)[0][[*names, "accepted"]] if len(block) else pd.DataFrame(columns=[*names, "accepted"])

    def hand_over(block: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if not len(block):
            return pd.DataFrame(columns=[key, "_blk", "_st"])
        kept = walk(block, state)[1]
        return pd.DataFrame({key: [block[key].iloc[0]], "_blk": [int(block["_blk"].iloc[0]) + 1], "_st": [kept]})

    slim = rows.select(key, "_blk", "_rn", "_us")
    # blocks that have a successor hand a state over
    last = slim.groupBy(F.col(key).alias("_k")).agg(F.max("_blk").alias("_last"))
    giving = slim.join(last, F.col(key).eqNullSafe(F.col("_k"))).where("_blk < _last").select(key, "_blk", "_rn", "_us")

    def at(states: DataFrame) -> DataFrame:
        return states.select(F.col(key).alias("_k"), F.col("_blk").alias("_b"), F.col("_st").alias("_old"))

    here = F.col(key).eqNullSafe(F.col("_k")) & (F.col("_blk") == F.col("_b"))
    none = df.sparkSession.createDataFrame([], state_schema)
    state = cut(giving.groupBy(*parts).cogroup(none.groupBy(*parts)).applyInPandas(hand_over, state_schema))
    changed = state
    while not changed.isEmpty():
        again = giving.join(at(changed), here, "left_semi")
        new = cut(again.groupBy(*parts).cogroup(changed.groupBy(*parts)).applyInPandas(hand_over, state_schema))
        changed = cut(new.join(at(state), here, "left").where(~F.col("_st").eqNullSafe(F.col("_old"))).select(key, "_blk", "_st"))
        state = cut(state.join(at(changed), here, "left_anti").unionByName(changed))
    return rows.groupBy(*parts).cogroup(state.groupBy(*parts)).applyInPandas(decide, out_schema)


def throttle_stream(
    stream: DataFrame, key: str, ts: str, tie: str, limit: int = RATE_LIMIT, window_s: int = RATE_WINDOW_S, late: str = "1 hour"
) -> DataFrame:
    """The limiter on a stream: key, tie and ``accepted``; state = the accepted times of the window.

    Hits of a micro-batch are judged in time order; a hit older than the state meets the hits kept so far. A client's
    state goes once the watermark (``late`` behind the newest hit) has passed its last hit's window.
    """
    window_us = window_s * 1_000_000
    s = _event_time(stream, ts, late)
    s = s.select(key, tie, ts, _micros(ts).alias("_us"))
    out = T.StructType([s.schema[key], s.schema[tie], T.StructField("accepted", T.BooleanType())])
    st = T.StructType([T.StructField("kept", T.ArrayType(T.LongType()))])

    def step(k: Any, chunks: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        hits = pd.concat([c[[key, tie, "_us"]] for c in chunks]).sort_values(["_us", tie])
        ok, kept = _judge(hits["_us"].to_numpy(), kept, limit, window_us)
        state.update((kept,))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, (kept[-1] + window_us) // 1000 + 1))
        yield hits[[key, tie]].assign(accepted=ok)

    return s.groupBy(key).applyInPandasWithState(step, out, st, "append", "EventTimeTimeout")


def hit_rate(df: DataFrame, key: str, ts: str, width: str = "10 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Hits per key and sliding window; on a stream, rows later than ``late`` are dropped."""
    d = _event_time(df, ts, late)
    w = F.window(ts, width, slide)
    return d.groupBy(key, w.alias("w")).agg(F.count("*").alias("hits")).select(
        key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "hits"
    )


def split_keyed(hits: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Adds ``bypass``: hits of clients that hold an active key skip the limiter."""
    k = keys.select(F.col("owner").alias(key)).distinct().withColumn("_k", F.lit(True))
    return hits.join(k, key, "left").withColumn("bypass", F.coalesce("_k", F.lit(False))).drop("_k")


def _plan_days(plan: Column) -> Column:
    return F.element_at(F.create_map(*[x for p, d in PLAN_DAYS.items() for x in (F.lit(p), F.lit(d))]), plan)


def with_expiry(keys: DataFrame) -> DataFrame:
    """expires_at = created_at plus the plan's days; an unknown plan has none."""
    days = _plan_days(F.coalesce("plan", F.lit("monthly")))
    return keys.withColumn("expires_at", (F.col("created_at") + F.make_dt_interval(days)).cast(keys.schema["created_at"].dataType))


def active_keys(keys: DataFrame, now: Column, prefix: str = KEY_PREFIX) -> DataFrame:
    """Keys with the live prefix that have not expired; a missing plan counts as monthly."""
    return keys.where(F.col("api_key").startswith(prefix) & (F.col("expires_at") >= now)).withColumn(
        "plan", F.coalesce("plan", F.lit("monthly"))
    )


def due_for_reminder(keys: DataFrame, now: Column, days: int = REMINDER_DAYS) -> DataFrame:
    """Keys that expire within ``days``, have an address and got no reminder yet."""
    soon = (F.col("expires_at") > now) & (F.col("expires_at") <= now + F.make_dt_interval(F.lit(days)))
    return keys.where(~F.col("reminder_sent") & soon & (F.coalesce("email", F.lit("")) != ""))


def history(checks: DataFrame, n: int = HISTORY_MAX, tie: str = "query_id") -> DataFrame:
    """Latest check per (sql, dialect), newest n; copies collapse before the shuffle."""
    rest = [c for c in checks.columns if c not in ("sql", "dialect")]
    last = checks.groupBy("sql", "dialect").agg(F.max_by(F.struct(*rest), F.struct("ts", tie)).alias("_r")).select("sql", "dialect", "_r.*")
    return last.orderBy(F.desc("ts"), F.desc(tie)).limit(n).withColumn("snippet", snippet(F.col("sql")))


def sessions(df: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of activity per key; rows merge map-side first."""
    d = _event_time(df, ts, late)
    return d.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("hits")).select(
        key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "hits"
    )


# ---- running streams --------------------------------------------------------


def scratch(spark, name: str) -> str:
    """A fresh folder next to the checkpoints, visible to all executors."""
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def drain(out: DataFrame, folder: str) -> DataFrame:
    """Run an append stream over what has arrived, into parquet files, and read them back."""
    spark = out.sparkSession
    q = (
        out.writeStream.format("parquet").outputMode("append")
        .option("path", folder + "/out").option("checkpointLocation", folder + "/ckpt")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(folder + "/out")


def lint_stream(stream: DataFrame, folder: str, lint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Lint each micro-batch; a batch writes its own folder, so a repeated batch replaces itself."""
    spark = stream.sparkSession

    def one(batch: DataFrame, batch_id: int) -> None:
        lint(batch).write.mode("overwrite").parquet(f"{folder}/out/batch_id={batch_id}")

    q = (
        stream.writeStream.foreachBatch(one).option("checkpointLocation", folder + "/ckpt").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.parquet(folder + "/out")
