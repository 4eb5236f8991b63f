"""Queries that write a store to the shared folder and read it back: archives, stores with bad records, repeated writes."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from inkspan.plans.catalog import query
from inkspan.plans.relational import FOLD
from inkspan.plans.views import text
from inkspan.sources import archives, readers, stores, versions, writers
from inkspan.streaming import state


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which the driver and all executors share. It stays, as the result reads it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{root.rstrip('/')}/inkspan-store-{uuid.uuid4().hex}"


@query("SELECT doc_id, md5(coalesce(text, '')) AS content, false AS broken FROM documents UNION ALL SELECT NULL, NULL, true")
def archive_round_trip(t):
    """Documents as zip (even ids) and tar.gz archives, and one file that only begins like an archive."""
    folder = shared_folder(t.spark)
    files = t.documents.select("doc_id", F.concat(F.lit("docs/"), text(F.col("doc_id")), F.lit(".txt")).alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    archives.write(files.filter("doc_id % 2 = 0"), f"{folder}/even", "zip")
    archives.write(files.filter("doc_id % 2 <> 0"), f"{folder}/odd", "tar.gz")
    damaged = t.documents.groupBy().agg(F.concat(F.lit("PK\x03\x04"), F.coalesce(F.md5(F.min("text")), F.lit(""))).alias("value"))
    damaged.coalesce(1).write.text(f"{folder}/damaged")
    rows = archives.read(t.spark, folder)
    return rows.select(F.regexp_extract("path", r"(-?\d+)\.txt$", 1).try_cast("long").alias("doc_id"), F.md5("content").alias("content"), F.col("error").isNotNull().alias("broken"))


ERROR_LINE = """CASE WHEN event_id % 7 = 3 THEN substr(line, 1, length(line) - 5) WHEN event_id % 7 = 5 THEN replace(line, ':' || event_id || '}', ':"many"}') ELSE line END"""


@query(
    f"""WITH made AS (SELECT event_id, stage, '{{"id":"' || event_id || '","stage":"' || stage || '","retry_count":' || event_id || '}}' AS line FROM err_events),
damaged AS (SELECT *, {ERROR_LINE} AS raw FROM made)
SELECT CAST(event_id AS VARCHAR) AS id, stage, event_id AS retry_count, NULL AS raw FROM damaged WHERE raw = line
UNION ALL SELECT NULL, NULL, NULL, raw FROM damaged WHERE raw <> line"""
)
def error_store_records(t):
    """An error log in which some lines are cut short and some have a word for a number."""
    folder, n = shared_folder(t.spark), text(F.col("event_id"))
    line = F.concat(F.lit('{"id":"'), n, F.lit('","stage":"'), "stage", F.lit('","retry_count":'), n, F.lit("}"))
    made = t.err_events.select("event_id", line.alias("line"))
    k = F.col("event_id") % 7
    wrong = F.replace("line", F.concat(F.lit(":"), n, F.lit("}")), F.lit(':"many"}'))
    made.select(F.when(k == 3, F.expr("substr(line, 1, length(line) - 5)")).when(k == 5, wrong).otherwise(F.col("line"))).write.text(folder)
    good, bad = stores.error_log(t.spark, folder)
    nothing = lambda kind: F.lit(None).cast(kind)
    return good.select("id", "stage", "retry_count", nothing("string").alias("raw")).unionByName(
        bad.select(nothing("string").alias("id"), nothing("string").alias("stage"), nothing("int").alias("retry_count"), "raw")
    )


@query(
    """SELECT CASE WHEN doc_id % 9 < 7 THEN arxiv_id END AS arxiv_id, CASE WHEN doc_id % 9 < 7 THEN title END AS title,
  CASE WHEN doc_id % 9 = 7 THEN '<entry><id>http://arxiv.org/abs/' || arxiv_id || 'v1</id><title>' || title || '<title></entry>'
    WHEN doc_id % 9 = 8 THEN '<entry><id>none</id><title>' || title || '</title></entry>' END AS raw FROM papers"""
)
def feed_store_records(t):
    """Feeds of a hundred entries in which some titles are not closed and some entries have no identifier."""
    folder, k = shared_folder(t.spark), F.col("doc_id") % 9
    entry = F.concat(
        F.lit("<entry><id>"), F.when(k == 8, "none").otherwise(F.concat(F.lit("http://arxiv.org/abs/"), "arxiv_id", F.lit("v1"))),
        F.lit("</id><title>"), "title", F.when(k == 7, "<title>").otherwise("</title>"), F.lit("</entry>"),
    )
    feeds = t.papers.groupBy(F.floor(F.col("doc_id") / 100)).agg(F.array_join(F.collect_list(entry), "\n").alias("entries"))
    body = F.concat(F.lit('<feed><title>query</title>\n'), "entries", F.lit("\n</feed>"))
    feeds.select(F.col("`floor((doc_id / 100))`").alias("feed"), body.alias("value")).write.partitionBy("feed").text(folder)
    good, bad = stores.atom_feed(t.spark, folder)
    return good.select("arxiv_id", "title", F.lit(None).cast("string").alias("raw")).unionByName(
        bad.select(F.lit(None).cast("string").alias("arxiv_id"), F.lit(None).cast("string").alias("title"), "raw")
    )


@query("SELECT doc_id, arxiv_id, status FROM papers")
def versioned_append(t):
    """Two appends, the second of them three times under its name, are read once."""
    folder, rows = shared_folder(t.spark), t.papers.select("doc_id", "arxiv_id", "status")
    versions.commit(rows.filter("doc_id % 2 = 0"), folder, "even")
    for _ in range(3):
        versions.commit(rows.filter("doc_id % 2 <> 0"), folder, "odd")
    return versions.read(t.spark, folder)


@query("SELECT doc_id, arxiv_id, status FROM papers WHERE doc_id % 2 <> 0")
def versioned_replace(t):
    """A version that replaces the one before it."""
    folder, rows = shared_folder(t.spark), t.papers.select("doc_id", "arxiv_id", "status")
    versions.commit(rows, folder, "all")
    versions.commit(rows.filter("doc_id % 2 <> 0"), folder, "odd", append=False)
    return versions.read(t.spark, folder)


@query(FOLD)
def error_state_stream(t):
    """The error events as files in no order of time, replayed through the stateful stream into a versioned store."""
    folder = shared_folder(t.spark)
    kind = t.err_events.schema["ts"].dataType
    files = t.err_events.withColumn("ts", F.col("ts").cast("timestamp")).repartition(6, F.xxhash64("event_id"))
    files.write.parquet(f"{folder}/events")
    events = t.spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 3).parquet(f"{folder}/events")
    records = state.error_records(events, keep_ms=10**15, delay="1000 days")
    state.into_store(records, f"{folder}/store", f"{folder}/checkpoint").awaitTermination()
    found = state.newest(versions.read(t.spark, f"{folder}/store"))
    return found.withColumns({c: F.col(c).cast(kind) for c in ("timestamp", "last_retry")})


@query("SELECT arxiv_id, title, status, source_type, error_message, source_md5 FROM papers")
def registry_store(t):
    """Papers through the registry's files: one document each, read back with missing fields as zero values."""
    folder = shared_folder(t.spark)
    papers = t.papers.select("arxiv_id", "title", "status", "source_type", "error_message", "source_md5")
    writers.registry(papers, folder)
    good, _ = stores.registry_lines(t.spark, folder)
    return good.select(*papers.columns)


@query("SELECT arxiv_id AS id FROM papers WHERE doc_id % 3 = 0 UNION ALL SELECT arxiv_id FROM papers WHERE doc_id % 3 = 1")
def id_list_store(t):
    """Two lists appended to a text store that also holds comments and blanks; a first list is overwritten."""
    folder, ids = shared_folder(t.spark), t.papers.select("doc_id", F.col("arxiv_id").alias("id"))
    writers.id_list(ids, folder)
    writers.id_list(ids.filter("doc_id % 3 = 0"), folder)
    writers.id_list(ids.filter("doc_id % 3 = 1"), folder, append=True)
    writers.id_list(ids.filter("doc_id % 3 = 2").select(F.concat(F.lit("# "), "id").alias("id")), folder, append=True)
    return readers.id_list(t.spark, folder)


@query("SELECT hash, translation FROM cache_entries")
def cache_store(t):
    """Cache entries through the versioned store."""
    folder = shared_folder(t.spark)
    writers.cache(t.cache_entries.select("hash", F.lit("").alias("original"), "translation"), folder)
    return readers.translation_cache(t.spark, folder).select("hash", "translation")


@query("SELECT arxiv_id, any_value(title) AS title FROM papers GROUP BY arxiv_id")
def harvest_store(t):
    """A harvest of entries that come twice, kept once; of papers with one identifier the first."""
    folder, entries = shared_folder(t.spark), t.papers.select("doc_id", "arxiv_id", "title", F.lit("").alias("abstract"))
    writers.harvest(entries.unionByName(entries), folder, "doc_id")
    return readers.harvest(t.spark, f"{folder}/entries").select("arxiv_id", "title")


@query("SELECT id, max(event_id) AS event_id, count(*) AS events FROM err_events GROUP BY id")
def error_store(t):
    """Error records written as JSON lines; of those that repeat an id the newest by time and number is read."""
    folder = shared_folder(t.spark)
    stamp = F.timestamp_seconds(F.col("event_id"))
    rows = t.err_events.select("id", F.col("event_id").cast("string").alias("title"), "stage", stamp.alias("timestamp"))
    writers.records(rows, folder)
    good, _ = stores.error_log(t.spark, folder)
    counts = t.err_events.groupBy("id").agg(F.count("*").alias("events"))
    return good.select("id", F.col("title").cast("long").alias("event_id")).join(counts, "id")


@query("SELECT arxiv_id || '_cs_cn.pdf' AS name, doc_id AS size FROM papers WHERE doc_id % 4 <> 1 UNION ALL SELECT NULL, NULL FROM papers WHERE doc_id % 4 = 1")
def listing_store(t):
    """Repository listings of ten files each, in which every fourth file has a word for its size."""
    d = F.col("doc_id")
    size = F.when(d % 4 == 1, '"large"').otherwise(text(d))
    entry = F.concat(F.lit('{"name":"'), "arxiv_id", F.lit('_cs_cn.pdf","type":"file","size":'), size, F.lit("}"))
    pages = t.papers.groupBy(F.floor(d / 10).alias("page")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(entry), ","), F.lit("]")).alias("json"))
    good, bad = stores.listing(pages, "json")
    return good.select("name", "size").unionByName(bad.select(F.lit(None).cast("string").alias("name"), F.lit(None).cast("long").alias("size")))


@query("SELECT doc_id, md5(coalesce(text, '')) AS content FROM documents WHERE doc_id % 3 <> 2")
def project_files(t):
    """Files of three suffixes in nested folders, of which the TeX ones are read, whatever their case."""
    folder, d = shared_folder(t.spark), F.col("doc_id")
    lines = t.documents.select(d, F.concat(text(d), F.lit(" "), F.md5(F.coalesce("text", F.lit("")))).alias("line"))
    for part, name, suffix in ((0, "a", "tex"), (1, "a/b/c", "TEX"), (2, "a/d", "txt")):
        lines.filter(d % 3 == part).select("line").write.option("extension", suffix).csv(f"{folder}/{name}")
    files = readers.tex_files(t.spark, folder)
    rows = files.select(F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line")).filter("line <> ''")
    return rows.select(F.split("line", " ")[0].cast("long").alias("doc_id"), F.split("line", " ")[1].alias("content"))
