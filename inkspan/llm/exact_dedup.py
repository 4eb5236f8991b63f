"""Exact deduplication by content sort.

Sampled splitters range-partition the normalised texts, an external sort places
equal texts side by side, and comparing neighbours over their full content
finds the groups. Splitters hold a text's first characters and hash, not whole
texts, so what the driver samples stays small. A text that would fill more than
a quarter of a partition is dealt out in several runs; its group is aggregated
within each input task first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkspan.llm.columns import normal_space, unused, without

OUTPUTS = ("keep_id", "group_size", "kept", "text_sha256")
#: Characters of a text that take part in the splitters.
PREFIX = 64


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``keep_id``, ``group_size long``, ``kept boolean`` and ``text_sha256 string``.

    Texts are equal when they are identical after each white-space run becomes
    one space; null counts as empty. The row with the smallest id stays; of rows
    that repeat an id and text one stays; a null id comes last. Every row comes
    out once. An empty table gives an empty result. Input columns named like an
    output are replaced by it.

    What is broadcast is one row per hot text: a text is hot if it has over
    1/(4 n) of the rows, n being ``spark.sql.shuffle.partitions``, so there are
    fewer than 4 n of them, and a run of one has at most that many rows.
    """
    spark = docs.sparkSession
    docs = without(docs, *OUTPUTS)
    norm, prefix, digest, runs, run, place, head, size, best = unused(
        docs, "norm", "prefix", "digest", "runs", "run", "place", "head", "run_size", "best"
    )
    pieces = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = docs.count()
    hashed = docs.withColumn(norm, normal_space(text_col))
    hashed = hashed.withColumns({prefix: F.substring(norm, 1, PREFIX), digest: F.xxhash64(norm)})
    hot = hashed.groupBy(digest).agg(F.count("*").alias(size)).filter(F.col(size) * pieces > total)
    hot = F.broadcast(hot.select(digest, F.ceil(F.col(size) * pieces / F.lit(max(total, 1))).alias(runs)))
    spread = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.col(runs))

    rank = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(run).alias("run"))
    in_hot = hashed.join(hot, digest).withColumn(run, spread).groupBy(norm)
    merged = in_hot.agg(F.min(rank).alias(best), F.count("*").alias("group_size"))
    sha = F.coalesce(F.sha2(F.col(norm).cast("binary"), 256), F.lit(""))
    merged = F.broadcast(merged.select(sha.alias("text_sha256"), best, "group_size"))

    dealt = hashed.drop(norm).join(hot, digest, "left").withColumn(run, F.coalesce(spread, F.lit(0)))
    dealt = dealt.repartitionByRange(prefix, digest, run).withColumn(norm, normal_space(text_col))
    group = W.partitionBy(prefix, digest, run, norm)
    ordered = group.orderBy(F.col(id_col).asc_nulls_last())
    rows = dealt.withColumns(
        {
            place: F.row_number().over(ordered),
            head: F.first(id_col).over(ordered),
            size: F.count("*").over(group),
        }
    ).withColumn("text_sha256", sha)

    joined = rows.join(merged, "text_sha256", "left")
    first = F.col(best).isNull() | (F.col(f"{best}.run") == F.col(run))
    return joined.select(
        *[F.col(c) for c in docs.columns],
        F.when(F.col(best).isNull(), F.col(head)).otherwise(F.col(f"{best}.id")).alias("keep_id"),
        F.coalesce(F.col("group_size"), F.col(size)).cast("long").alias("group_size"),
        ((F.col(place) == 1) & first).alias("kept"),
        "text_sha256",
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``mark_duplicates`` keeps, with the columns of ``docs``."""
    return mark_duplicates(docs, id_col, text_col).filter("kept").select(*docs.columns)
