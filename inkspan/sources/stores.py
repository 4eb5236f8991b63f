"""Stores with bad records: every record is parsed where it stands, and what does not parse is a row of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.functions import ids, text
from inkspan.sources.readers import ERROR, LISTING, PAPER, zero_filled

#: Column that a parser fills with a record that does not fit the schema.
BAD = "bad_record"
ENTRY = "id string, title string, summary string"


def parsed(rows: DataFrame, raw: str, schema: str, kind: str = "json") -> DataFrame:
    """``rows`` with ``record`` (a struct) and ``error`` (null for a good record).

    A record is bad if it is no JSON or XML, or if a value does not have its
    field's type; missing fields are null and fine. Blank text is no record.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    parse = F.from_json if kind == "json" else F.from_xml
    made = rows.filter(F.trim(F.coalesce(raw, F.lit(""))) != "").withColumn("record", parse(F.col(raw), f"{schema}, {BAD} string", options))
    bad = F.col("record").isNull() | F.col(f"record.{BAD}").isNotNull()
    return made.withColumn("error", F.when(bad, F.lit(f"no {kind} record of the store's schema")))


def good(rows: DataFrame) -> DataFrame:
    """The fields of the records that parsed."""
    return rows.filter("error is null").select("record.*").drop(BAD)


def bad(rows: DataFrame, raw: str) -> DataFrame:
    """``(raw, error)`` of the others."""
    return rows.filter("error is not null").select(F.col(raw).alias("raw"), "error")


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "raw")


def _whole(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob).withColumnRenamed("value", "raw")


def _newest(rows: DataFrame, key: str, by: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(F.col(by).isNotNull(), by)).alias("r")).select("r.*")


def error_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Records of an error log in JSON lines, of those that repeat an id the newest; and the bad lines."""
    rows = parsed(lines(spark, path), "raw", ERROR)
    return _newest(zero_filled(good(rows)), "id", "timestamp"), bad(rows, "raw")


def registry(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """One JSON document per paper below ``path``; and the documents that do not parse."""
    rows = parsed(_whole(spark, path, "metadata.json"), "raw", PAPER)
    return zero_filled(good(rows)), bad(rows, "raw")


def registry_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Papers of a registry written as JSON lines; and the bad lines."""
    rows = parsed(lines(spark, path), "raw", PAPER)
    return zero_filled(good(rows)), bad(rows, "raw")


def listing(rows: DataFrame, json: str) -> tuple[DataFrame, DataFrame]:
    """Files of repository listings held as JSON arrays, element by element; and the bad elements and texts."""
    elements = rows.select(F.explode(F.coalesce(F.from_json(json, "array<string>"), F.array(F.col(json)))).alias("raw"))
    made = parsed(elements, "raw", LISTING)
    return zero_filled(good(made)), bad(made, "raw")


def entry_texts(feed: Column) -> Column:
    """The entries of a feed, from one opening tag up to the next or to the feed's end, so a missing closing tag costs one entry."""
    found = F.regexp_extract_all(feed, F.lit(r"(?s)<entry\b.*?(?=<entry\b|</feed>|\z)"), F.lit(0))
    return F.transform(found, text.strip)


def atom_feed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Cleaned entries of Atom feeds; and the entries that are no XML or have no identifier."""
    entries = _whole(spark, path).select(F.explode(entry_texts(F.col("raw"))).alias("raw"))
    rows = parsed(entries, "raw", ENTRY, "xml").withColumn("arxiv_id", ids.feed_paper_id(F.coalesce("record.id", F.lit(""))))
    rows = rows.withColumn("error", F.coalesce("error", F.when(F.col("arxiv_id") == "", F.lit("no identifier"))))
    clean = lambda c: text.clean_feed_text(F.coalesce(c, F.lit("")))
    kept = rows.filter("error is null").select("arxiv_id", clean("record.title").alias("title"), clean("record.summary").alias("abstract"))
    return kept, bad(rows, "raw")
