"""Shared storage for intermediate tables.

A table that several plans read, or that an iteration grows from, is written as
Parquet under the session's ``spark.checkpoint.dir``. That folder is shared by
driver and executors, so the table outlives any executor.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """The session's shared checkpoint folder. A session without one is refused: a local folder would not be seen by executors."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return configured.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _write(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{root(spark)}/inkspan-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a DataFrame over the written files."""
    return _write(df, name)[0]


def discard(df: DataFrame) -> None:
    """Delete the files behind a DataFrame that ``materialise`` returned."""
    files = df.inputFiles()
    if files:
        _delete(df.sparkSession, files[0].rsplit("/", 1)[0])


class Tables:
    """Intermediate tables of one computation, deleted together when its result no longer reads them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        written, path = _write(df, name)
        self.paths.append(path)
        return written

    def clear(self) -> None:
        for path in self.paths:
            _delete(self.spark, path)
        self.paths = []
