"""Readers of the stores and files that the operators work on.

All readers take Spark paths (any file system), declare their schemas, and give
missing fields their zero value, as the stores leave those out.
"""

from __future__ import annotations

import io
import json
import tarfile
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.functions import ids, text

PAPER = (
    "arxiv_id string, title string, translated_at timestamp, original_pdf string, translated_pdf string, bilingual_pdf string, source_dir string, "
    "has_latex_source boolean, status string, error_message string, last_phase string, original_input string, main_tex_file string, source_type string, "
    "source_md5 string, source_file_name string"
)
ERROR = "id string, title string, input string, stage string, error_msg string, timestamp timestamp, can_retry boolean, retry_count int, last_retry timestamp, reported boolean, reported_at timestamp"
CACHE = "version string, entries array<struct<hash:string,original:string,translation:string,created_at:timestamp>>"
FEED = "arxiv_id string, title string, abstract string"
LISTING = "name string, path string, type string, download_url string, html_url string, size long"


def zero_filled(rows: DataFrame) -> DataFrame:
    """Missing strings, numbers and flags as their zero value; times stay null, which means never."""
    return rows.fillna("").fillna(0).fillna(False)


def json_store(spark: SparkSession, path: str, schema: str):
    """A reader for a store of either layout: one document a file, or one record a line, told by whether the first line is whole."""
    first = spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()
    try:
        whole = bool(first) and json.loads(first[0]["value"].removeprefix("\ufeff")) is not None
    except ValueError:
        whole = False
    return spark.read.schema(schema).option("multiLine", not whole)


def registry(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per paper below ``path``; unreadable ones are skipped."""
    rows = spark.read.schema(PAPER).option("multiLine", True).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).option("pathGlobFilter", "metadata.json").json(path)
    return zero_filled(rows)


def error_log(spark: SparkSession, path: str) -> DataFrame:
    """Records as one JSON array or one a line; of records that repeat an id the newest counts."""
    rows = zero_filled(json_store(spark, path, ERROR).json(path))
    return rows.groupBy("id").agg(F.max_by(F.struct(*rows.columns), "timestamp").alias("r")).select("r.*")


def translation_cache(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a versioned cache store."""
    return json_store(spark, path, CACHE).json(path).select(F.inline("entries"))


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """Identifiers of a text file, without blanks and comments."""
    rows = spark.read.text(path).select(text.strip(F.col("value")).alias("id"))
    return rows.filter((F.col("id") != "") & ~F.col("id").startswith("#"))


def harvest(spark: SparkSession, path: str) -> DataFrame:
    """Harvested entries, one per identifier; malformed stores are empty."""
    return json_store(spark, path, FEED).option("mode", "DROPMALFORMED").json(path).filter("arxiv_id is not null").dropDuplicates(["arxiv_id"])


def atom_feed(spark: SparkSession, path: str) -> DataFrame:
    """Entries of Atom feeds, cleaned; entries without an identifier are dropped."""
    rows = spark.read.format("xml").option("rowTag", "entry").schema("id string, title string, summary string").load(path)
    named = rows.select(
        ids.feed_paper_id(F.coalesce("id", F.lit(""))).alias("arxiv_id"),
        text.clean_feed_text(F.coalesce("title", F.lit(""))).alias("title"),
        text.clean_feed_text(F.coalesce("summary", F.lit(""))).alias("abstract"),
    )
    return named.filter("arxiv_id <> ''")


def feed_metadata(rows: DataFrame, xml: str) -> DataFrame:
    """Title, abstract and authors of one-entry feeds held as text: the second title, the first summary, all names."""
    many = lambda tag: F.regexp_extract_all(xml, F.lit(rf"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
    tidy = lambda c: F.regexp_replace(text.strip(c), r"\s+", " ")
    return rows.withColumns(
        {"title": tidy(F.try_element_at(many("title"), F.lit(2))), "abstract": tidy(F.try_element_at(many("summary"), F.lit(1))), "authors": F.array_join(many("name"), ", ")}
    )


def repository_listing(rows: DataFrame, listing: str) -> DataFrame:
    """Files of a repository listing held as JSON text."""
    return rows.select(F.inline(F.from_json(listing, f"array<struct<{LISTING.replace(' ', ':').replace(',:', ',')}>>"))).fillna("")


def tex_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, content)`` of all TeX files below a folder, by suffix without case."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[tT][eE][xX]").load(path).select("path", "content")


def documents(files: DataFrame) -> DataFrame:
    """``(path, encoding, text)`` of binary files in their detected encodings."""
    from inkspan.functions.rules import repairs
    from inkspan.operators.rules import with_text

    named = with_text(files, "encoding", lambda b: repairs.detect_encoding(bytes(b)), "content")
    return with_text(named, "text", lambda b: repairs.to_text(bytes(b)), "content").drop("content")


def archives(spark: SparkSession, path: str) -> DataFrame:
    """``(archive, path, content)`` of the files in zip and tar.gz archives below a folder.

    The kind is told by the first bytes; entries that would leave the archive's
    folder are dropped. One archive is unpacked by one task, entry by entry.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    known = files.select("path", text.sniff_archive(F.col("content")).alias("kind"), "content").filter("kind is not null")

    def unpacked(batches):
        for batch in batches:
            for name, kind, content in zip(*(c.to_pylist() for c in batch.columns)):
                for entry, data in _entries(kind, content):
                    yield pa.RecordBatch.from_pydict({"archive": [name], "path": [entry], "content": [data]})

    entries = known.mapInArrow(unpacked, "archive string, path string, content binary")
    return entries.filter(ids.is_safe_path(F.col("path")))


def _entries(kind: str, content: bytes):
    if kind == "zip":
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            for info in archive.infolist():
                if not info.is_dir():
                    yield info.filename, archive.read(info)
    else:
        with tarfile.open(fileobj=io.BytesIO(content), mode="r:gz") as archive:
            for member in archive:
                if member.isfile():
                    yield member.name, archive.extractfile(member).read()
