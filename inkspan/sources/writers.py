"""Writers of the stores. Rows are written where they are; one-file layouts are for small lists only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.functions import ids


def registry(papers: DataFrame, path: str) -> None:
    """Papers as JSON lines in one folder per sanitised identifier's last characters."""
    key = F.right(ids.sanitise_id(F.col("arxiv_id")), F.lit(2))
    papers.withColumn("part", key).write.mode("overwrite").partitionBy("part").json(path)


def records(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def id_list(rows: DataFrame, path: str, append: bool = False) -> None:
    """Identifiers one per line; an empty list leaves an empty folder."""
    rows.select(F.col("id").cast("string")).write.mode("append" if append else "overwrite").text(path)


def cache(entries: DataFrame, path: str, version: str = "1.0") -> None:
    """Cache entries as JSON lines that carry the store's version."""
    entries.select(F.lit(version).alias("version"), F.array(F.struct(*entries.columns)).alias("entries")).write.mode("overwrite").json(path)


def harvest(entries: DataFrame, path: str, order: str | None = None) -> None:
    """Identifiers as text and entries as JSON, from one input that is computed once.

    Of entries with one identifier the least by the column ``order``, which is not written, is kept; without it any one.
    """
    if order:
        row = F.struct(*[c for c in entries.columns if c != order])
        kept = entries.groupBy("arxiv_id").agg(F.min_by(row, order).alias("row")).select("row.*").persist()
    else:
        kept = entries.dropDuplicates(["arxiv_id"]).persist()
    try:
        kept.select("arxiv_id").write.mode("overwrite").text(f"{path}/ids")
        kept.write.mode("overwrite").json(f"{path}/entries")
    finally:
        kept.unpersist()


def encoded(rows: DataFrame, text: str, charset: str) -> DataFrame:
    """``rows`` with ``content``: the text's bytes in a charset."""
    return rows.withColumn("content", F.encode(text, charset))
