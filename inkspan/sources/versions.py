"""Sinks whose writes count once and wholly.

A store is a folder of Parquet parts and a log. A write goes to a new part that
nobody reads; then one small log entry names the parts of the new version. A
task that fails, or a job that dies before its entry, leaves the old version. A
write that is repeated under its batch name finds its entry and does nothing.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "version long, batch string, parts array<string>"


def history(spark: SparkSession, path: str) -> DataFrame:
    """``(version, batch, parts)`` of every committed write."""
    try:
        return spark.read.schema(LOG).json(f"{path}/log/*")
    except AnalysisException as failure:
        if failure.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)


def commit(rows: DataFrame, path: str, batch: str, append: bool = True) -> int:
    """Write ``rows`` as the store's next version (or as more of it) and return its number.

    ``batch`` names the write: a second one of the same name returns the first
    one's version. Two writers that race for a version meet at its log entry,
    which only one of them can create; the other fails and may be repeated.
    """
    spark = rows.sparkSession
    log = history(spark, path)
    done = log.filter(F.col("batch") == batch).agg(F.min("version")).first()[0]
    if done is not None:
        return done
    last = log.orderBy(F.desc("version")).limit(1).collect()
    part = f"part-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{part}")
    version = last[0]["version"] + 1 if last else 1
    parts = [*(last[0]["parts"] if last and append else []), part]
    entry = spark.createDataFrame([(version, batch, parts)], LOG).coalesce(1)
    entry.write.mode("error").json(f"{path}/log/{version:012d}")
    return version


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest version, or the given one."""
    log = history(spark, path)
    if version is not None:
        log = log.filter(F.col("version") == version)
    found = log.orderBy(F.desc("version")).limit(1).collect()
    if not found:
        raise ValueError(f"no version {version or ''} in {path}")
    return spark.read.parquet(*[f"{path}/{part}" for part in found[0]["parts"]])
