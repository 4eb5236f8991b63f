"""Arrays, maps and ordered folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def keep_disjoint(spans: DataFrame, key: str, start: str, stop: str) -> DataFrame:
    """Greedy choice of intervals of each key: by start, longer first; one that begins before the last kept end goes."""
    items = F.array_sort(F.collect_set(F.struct(F.col(start).alias("start"), (-F.col(stop)).alias("back"))))
    grouped = spans.groupBy(key).agg(items.alias("items"))

    def step(acc: Column, item: Column) -> Column:
        last = F.when(F.size(acc) > 0, -F.element_at(acc, -1)["back"]).otherwise(item["start"])
        return F.when(item["start"] >= last, F.concat(acc, F.array(item))).otherwise(acc)

    kept = F.aggregate("items", F.slice("items", 1, 0), step)
    return grouped.select(key, F.explode(kept).alias("i")).select(key, F.col("i.start").alias("start"), (-F.col("i.back")).alias("stop"))


def mark_nested(spans: DataFrame, key: str, order: str, start: str, stop: str) -> DataFrame:
    """Whether an interval lies within another of its key, apart from both its ends, and the first that holds it.

    The join is keyed, so only intervals of one document meet.
    """
    other = spans.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(start).alias("b"), F.col(stop).alias("f"))
    s, e = F.col(start), F.col(stop)
    holds = (F.col("b") < s) & (F.col("f") > e)
    joined = spans.join(other, (F.col(key) == F.col("k")) & holds, "left")
    return joined.groupBy(key, order).agg(F.min("o").isNotNull().alias("is_nested"), F.min("o").alias("parent"))


def missing_keys(placeholders: Column, text: Column) -> Column:
    """Keys of a map that the text does not hold."""
    return F.filter(F.map_keys(placeholders), lambda k: ~text.contains(k))


def by_number(names: Column) -> Column:
    """Placeholder names in order of their number."""
    number = lambda k: F.regexp_extract(k, r"_(\d+)>>>", 1).cast("long")
    keyed = F.transform(names, lambda k: F.struct(F.coalesce(number(k), F.lit(0)).alias("n"), k.alias("k")))
    return F.transform(F.array_sort(keyed), lambda s: s["k"])


def restore(text: Column, placeholders: Column) -> Column:
    """Text with every key replaced by its value, in key order."""
    return F.aggregate(F.array_sort(F.map_entries(placeholders)), text, lambda acc, e: F.replace(acc, e["key"], e["value"]))


def merge_maps(left: Column, right: Column) -> Column:
    """Union of two maps; the right one wins."""
    own = F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k))
    return F.map_concat(own, right)


def placeholder(kind: Column, number: Column) -> Column:
    return F.format_string("<<<LATEX_%s_%d>>>", kind, number)


def reduce_chunks(chunks: DataFrame, key: str, order: str, text: str, tokens: str) -> DataFrame:
    """Chunks of each key joined in order, with their number and token sum."""
    ordered = F.array_sort(F.collect_list(F.struct(order, text)))
    joined = F.array_join(F.transform(ordered, lambda s: s[text]), "")
    return chunks.groupBy(key).agg(F.count("*").alias("chunks"), F.sum(tokens).cast("long").alias("tokens"), joined.alias("text"))


def recovery_report(attempts: DataFrame) -> DataFrame:
    """Attempts, recoveries and failures by strategy."""
    return attempts.groupBy("strategy").agg(F.count("*").alias("attempts"), F.count_if("success").alias("recovered"), F.count_if(~F.col("success")).alias("failed"))


def categories(spark: SparkSession, count: int) -> DataFrame:
    """Category dimension of a fixed, small number of rows."""
    return spark.range(count).select(F.concat(F.lit("cat"), F.col("id").cast("string")).alias("category"))


def parse_detections(raw: DataFrame, width: int, height: int, stride: int = 6) -> DataFrame:
    """Detections of a flat detector output (x, y, w, h, confidence, class), scaled to pixels."""
    at = F.posexplode(F.transform(F.sequence(F.lit(0), F.floor(F.size("output") / stride).cast("int") - 1), lambda i: F.slice("output", i * stride + 1, F.lit(stride))))
    rows = raw.filter(F.size("output") >= stride).select("doc_id", at.alias("element", "v"))
    get = lambda i: F.col("v")[i]
    return rows.select(
        "doc_id", F.col("element").cast("long").alias("element"), (get(0) * width).alias("x"), (get(1) * height).alias("y"), (get(2) * width).alias("width"),
        (get(3) * height).alias("height"), get(4).alias("confidence"), get(5).cast("long").alias("class_id"),
    )

