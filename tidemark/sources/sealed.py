"""Decisions that are frozen before a test: written, sealed by a marker, and only then open to the step that tests them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

from tidemark.sources.sinks import write_record

MARKER = "seal"


def digest(rows: DataFrame) -> dict:
    """Rows and a digest of them that is free of order: the sum of 60 bits of each row's SHA-256."""
    line = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
    value = F.conv(F.substring(F.sha2(line, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    one = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(value), F.lit(0)).cast("string").alias("digest")).first()
    return {"rows": one["rows"], "digest": one["digest"]}


def freeze(decisions: DataFrame, path: str) -> None:
    """Write decisions under path, which must be new, then the marker with their digest; the marker is the last to appear.

    A job that dies between leaves decisions without a marker, which open_frozen refuses.
    """
    spark = decisions.sparkSession
    decisions.write.mode("errorifexists").parquet(f"{path}/decisions")
    write_record(spark, digest(spark.read.parquet(f"{path}/decisions")), f"{path}/{MARKER}")


def open_frozen(spark: SparkSession, path: str) -> DataFrame:
    """Frozen decisions; refused where there is no marker, or where the rows are no longer those that were sealed."""
    try:
        lines = spark.read.text(f"{path}/{MARKER}").collect()
    except AnalysisException as e:
        raise ValueError(f"no sealed decisions in {path}: decide and freeze before testing") from e
    rows = spark.read.parquet(f"{path}/decisions")
    if len(lines) != 1 or json.loads(lines[0]["value"]) != digest(rows):
        raise ValueError(f"decisions in {path} are not those that were sealed")
    return rows


def evidence_order(spark: SparkSession, path: str, results: str) -> DataFrame:
    """(frozen, completed, in_order): when the seal and the results were last written, by the files' own metadata."""
    last = lambda p, f: spark.read.format("binaryFile").option("recursiveFileLookup", True).load(p).agg(f("modificationTime").alias("t"))
    frozen = last(path, F.max).select(F.col("t").alias("frozen"))
    # One row each
    return frozen.join(last(results, F.min).select(F.col("t").alias("completed"))).withColumn("in_order", F.coalesce(F.col("frozen") < F.col("completed"), F.lit(False)))
