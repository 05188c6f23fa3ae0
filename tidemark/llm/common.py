"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Words are runs of characters other than ASCII space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only where neither that nor a folder set by the caller exists, as in tests in
    local mode, a temporary one is made."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it from there, so that later stages survive lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def as_parquet(df: DataFrame, **options: str) -> DataFrame:
    """Write df as Parquet in the shared folder, with the writer's options, and read that: for large tables, of which later jobs read few columns.

    The table is the session's: it is removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}.parquet"
    df.write.options(**options).parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.parquet(path)


def map_rows(df: DataFrame, rows: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """Run a generator over the rows of each partition, as dicts of the selected columns, in Arrow batches.

    Output is sent in batches of limited size, so that a task holds one input batch and one output batch.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    for values in zip(*(c.to_pylist() for c in part.columns), strict=True):
                        yield dict(zip(names, values, strict=True))

        held, weight = [], 0
        for row in rows(each()):
            held.append(row)
            weight += 64 + sum(len(v) for v in row.values() if isinstance(v, (str, bytes, list)))
            if len(held) >= 4096 or weight > 8_000_000:
                yield pa.RecordBatch.from_pylist(held, schema=arrow)
                held, weight = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=arrow)

    return df.mapInArrow(run, schema)
