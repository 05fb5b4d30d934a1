"""Reading and selecting SQL files, and writing results back."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from queryscope.functions.text import glob_regex

_SCHEMA = "path string, sql string, dialect string, error string"


def read_sql_files(spark: SparkSession, paths: Sequence[str], dialect: str = "bigquery") -> DataFrame:
    """path, sql, dialect, error: one row per file; a pattern without any file yields an error row."""
    frames = []
    for p in paths:
        try:
            raw = spark.read.text(p, wholetext=True, recursiveFileLookup=True)
            d = raw.select(
                F.col("_metadata.file_path").alias("path"),
                F.col("value").alias("sql"),
                F.lit(dialect).alias("dialect"),
                F.lit(None).cast("string").alias("error"),
            )
            d.schema
        except AnalysisException:
            d = spark.createDataFrame([(p, None, dialect, "no file matches")], _SCHEMA)
        frames.append(d)
    return reduce(DataFrame.unionByName, frames)


def matches_any(path: Column, patterns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [path.rlike(glob_regex(p)) for p in patterns], F.lit(False))


def filter_paths(df: DataFrame, patterns: Sequence[str], path: str = "path") -> DataFrame:
    """Rows whose path matches one of the globs."""
    return df.where(matches_any(F.col(path), patterns))


def select_changed(manifest: DataFrame, corpus: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Corpus rows of files a change touches: not removed, and matching the globs."""
    changed = filter_paths(manifest.where("status <> 'removed'"), patterns).select("path").distinct()
    return corpus.join(changed, "path", "left_semi")


def write_results(results: DataFrame, path: str) -> None:
    """One JSON object per row."""
    results.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_fixed(fixed: DataFrame, out: str, key: str) -> None:
    """Fixed texts under ``out/<key>=.../``; never the folder they came from."""
    fixed.select(key, F.col("fixed_sql").alias("value")).write.mode("overwrite").partitionBy(key).text(out)
