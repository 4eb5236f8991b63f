"""Repository listings: files grouped to papers, categories, exclusions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.functions import ids

PAPER = r"^(\d{4}\.\d{4,5}(?:v\d+)?)"
KINDS = ("cn", "bilingual", "zip")


def _pivot() -> list:
    kind = ids.file_kind(F.col("name"))
    return [F.max(F.when(kind == k, F.col("name"))).alias(k) for k in KINDS] + [F.max(F.when(kind == k, F.col("download_url"))).alias(f"{k}_url") for k in KINDS]


def papers_of(files: DataFrame) -> DataFrame:
    """One row per paper with the file and URL of each kind; papers without any are left out."""
    own = files.filter("type = 'file'").withColumn("arxiv_id", F.regexp_extract("name", PAPER, 1)).filter("arxiv_id <> ''")
    return own.groupBy("arxiv_id").agg(*_pivot()).filter("cn is not null or bilingual is not null or zip is not null")


def recent(files: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` papers by identifier, largest first, so that a listing does not depend on file order."""
    return papers_of(files).orderBy(F.desc("arxiv_id")).limit(limit)


def search(files: DataFrame, paper_id: str) -> DataFrame:
    """One row for the files whose name starts with the identifier."""
    own = files.filter((F.col("type") == "file") & F.col("name").startswith(paper_id))
    found = own.agg(*_pivot())
    return found.select(F.lit(paper_id).alias("arxiv_id"), F.expr("cn is not null or bilingual is not null or zip is not null").alias("found"), *found.columns)


def by_category(files: DataFrame, categories: DataFrame, limit: int) -> DataFrame:
    """Papers with a file of a wanted category: filtered first, then limited."""
    wanted = categories.select(F.lower("category").alias("category"))
    named = files.withColumn("category", ids.category_from_filename(F.col("name"))).join(wanted, "category", "left_semi")
    chosen = named.select(F.regexp_extract("name", PAPER, 1).alias("arxiv_id")).distinct()
    return papers_of(files).join(chosen, "arxiv_id", "left_semi").orderBy(F.desc("arxiv_id")).limit(limit)


def pending(all_ids: DataFrame, *done: DataFrame, key: str = "id") -> DataFrame:
    """Identifiers of the rows whose ``key`` none of the other lists holds, once each; another key tells papers with one identifier apart."""
    for other in done:
        all_ids = all_ids.join(other.select(key), key, "left_anti")
    return all_ids.select("id").distinct()


def main_files(files: DataFrame) -> DataFrame:
    """The main file of each project among ``files`` (project, path, text) that declare a document class."""
    declared = files.filter(F.col("text").contains("\\documentclass"))
    return declared.groupBy("project").agg(F.min(ids.main_file_rank(F.col("path"))).alias("rank")).select("project", F.col("rank.path").alias("path"))

