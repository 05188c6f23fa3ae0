"""Writers: CSV with a header, partitioned Parquet, and one JSON record."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header. Arrays, maps and structs become JSON, which read_lists turns back."""
    nested = {n: F.to_json(n) for n, t in df.dtypes if t.startswith(("array", "map", "struct"))}
    df = df.withColumns(nested) if nested else df
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_evidence(df: DataFrame, path: str, keys: tuple[str, ...] = ("domain", "horizon")) -> None:
    """Task evidence as Parquet folders per task; only the tasks in df are overwritten, so that a run can be resumed."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*keys).parquet(path)


def remaining(tasks: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("domain", "horizon")) -> DataFrame:
    """Tasks that have no finished row yet."""
    return tasks.join(done.select(*keys).distinct(), list(keys), "left_anti")


def write_record(spark: SparkSession, record: dict, path: str) -> None:
    """One JSON object, refusing NaN; the committer makes the write atomic."""
    spark.createDataFrame([(json.dumps(record, allow_nan=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
