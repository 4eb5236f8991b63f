"""Translation cache: hash-keyed lookup joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(blocks: DataFrame, cache: DataFrame, empty_is_hit: bool = True) -> DataFrame:
    """``blocks`` with ``translated_text`` and ``from_cache`` by the SHA-256 of ``text``.

    ``empty_is_hit`` decides whether an empty translation counts.
    """
    usable = cache if empty_is_hit else cache.filter(F.col("translation") != "")
    joined = blocks.withColumn("hash", F.sha2("text", 256)).join(usable.select("hash", F.col("translation").alias("translated_text")), "hash", "left")
    return joined.withColumn("from_cache", F.col("translated_text").isNotNull()).drop("hash")


def attach(blocks: DataFrame, translations: DataFrame, key: str) -> DataFrame:
    """Translation of each block by its key; empty where there is none."""
    joined = blocks.join(translations.select(key, F.col("translation").alias("t")), key, "left")
    return joined.withColumn("translated_text", F.coalesce("t", F.lit(""))).drop("t")


def to_document(cache: DataFrame) -> DataFrame:
    """Entries as JSON lines of a versioned store, one entry a row: the whole store never meets in one task."""
    return cache.select("hash", F.to_json(F.struct(F.lit("1.0").alias("version"), "hash", "translation")).alias("entry"))
