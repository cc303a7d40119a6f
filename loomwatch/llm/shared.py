"""Tables in the folder that driver and executors share.

Several operators cut their lineage by writing a table and reading it back. A
written table survives the loss of any executor, so a retry restarts from the
files and not from the beginning of the job.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only where the setting is absent (a local test session) is a temporary
    folder made and recorded in the session.
    """
    path = spark.conf.get(_SETTING, None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_SETTING} to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set(_SETTING, path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path for a table that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read from there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` over batches of about 4 MB, or of what the session sets.

    Spark's own bound is 64 MB. Executors hold a batch outside their heap, twice
    while it grows, and so does each Python worker, and both keep what they once
    took. Spark reads the bound when the job runs, so it stays in the session.
    """
    spark = df.sparkSession
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(4 << 20))
    return df.mapInArrow(run, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
