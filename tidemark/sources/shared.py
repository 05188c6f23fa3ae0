"""Tables that a job writes for its own later steps, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _ready(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def settled(df: DataFrame) -> DataFrame:
    """df written to the folder of spark.checkpoint.dir and read from there: computed once, and safe from lost executors.

    Only where no such folder is set, as in tests in local mode, a temporary one is made.
    """
    _ready(df.sparkSession)
    return df.checkpoint()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the folder of spark.checkpoint.dir."""
    _ready(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, where its files give fewer; a larger table stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
