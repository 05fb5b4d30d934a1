"""Session settings and the two places where a job cuts its lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def tune(spark: SparkSession) -> SparkSession:
    """Runtime SQL settings the operators count on; safe to call repeatedly."""
    for key, value in {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # split a hot join key even when an aggregate on the same key follows
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        # one hash on the text id serves every finer window, group and join
        "spark.sql.requireAllClusterKeysForCoPartition": "false",
        # token jobs multiply their input, so small text partitions are worth a task of their own
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k",
        # fact tables have many small groups per task, each with some sixty buffers: beyond a few, sorting is faster than collecting garbage
        "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "2048",
        # no Python call-site capture for each of the many column expressions
        "spark.sql.dataFrameQueryContext.enabled": "false",
        # texts go to Python in batches of bounded size, however long they are
        "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
        # the JVM never compiles a method above 8000 bytes: wide plans run as many small ones instead
        "spark.sql.codegen.hugeMethodLimit": "8000",
        # merge activity sessions map-side before the key shuffle
        "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
    }.items():
        spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temp folder only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="queryscope-ckpt-")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder, so that it is computed exactly once."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
