"""Page layout: overlap joins, suppression, reading order, batches."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkspan.functions.geometry import box, iou, is_translatable_kind, priority
from inkspan.functions.text import strip

SEPARATOR = "\n---BLOCK_SEPARATOR---\n"


def match_layout(blocks: DataFrame, elements: DataFrame, least: float = 0.3) -> DataFrame:
    """``blocks`` (doc_id, pos, page, box) with the kind of the element they overlap most, or null.

    Joined on document and page, never across pages; of equal overlaps the first
    element counts; an overlap under ``least`` is none. The best element is an
    aggregate, so no block's candidates are gathered.
    """
    e = elements.select("doc_id", "page", "element", F.col("type").alias("e_type"), *[F.col(c).alias(f"e_{c}") for c in ("x", "y", "width", "height")])
    pairs = blocks.join(e, ["doc_id", "page"]).withColumn("overlap", iou(box(), box("e_")))
    best = pairs.filter(F.col("overlap") >= least).groupBy("doc_id", "pos").agg(F.max_by("e_type", F.struct("overlap", -F.col("element"))).alias("match_type"))
    return blocks.join(best, ["doc_id", "pos"], "left")


def merge_layout(blocks: DataFrame, elements: DataFrame) -> DataFrame:
    """``blocks`` whose ``block_type`` is the matched element's kind, where there is one."""
    return match_layout(blocks, elements).withColumn("block_type", F.coalesce("match_type", "block_type")).drop("match_type")


def suppress(detections: DataFrame, keys: list[str], least: float = 0.0, overlap: float = 0.5) -> DataFrame:
    """Greedy non-maximum suppression within each group of ``keys`` (a page and class).

    Best confidence first, ties by ``element``; a detection goes if it overlaps a
    kept one by ``overlap`` or more. A group is one page's detections of a class,
    folded in order inside one array.
    """
    rows = detections.filter(F.col("confidence") >= least)
    item = F.struct((-F.col("confidence")).alias("rank"), "element", "x", "y", "width", "height", "confidence")
    boxed = lambda s: {k: s[k] for k in ("x", "y", "width", "height")}
    sorted_items = F.array_sort(F.collect_list(item))
    grouped = rows.groupBy(*keys).agg(sorted_items.alias("items"))
    empty = F.slice("items", 1, 0)
    kept = F.aggregate(
        "items",
        empty,
        lambda acc, d: F.when(F.exists(acc, lambda k: iou(boxed(k), boxed(d)) >= overlap), acc).otherwise(F.concat(acc, F.array(d))),
    )
    return grouped.select(*keys, F.explode(kept).alias("d")).select(*keys, "d.element", "d.confidence")


def translatable_elements(elements: DataFrame) -> DataFrame:
    """Elements to translate, most important first; ties by place."""
    return elements.filter(is_translatable_kind(F.col("type"))).withColumn("priority", priority(F.col("type"))).orderBy(F.desc("priority"), "doc_id", "element")


def reading_order(blocks: DataFrame, keys: list[str], tolerance: float = 5.0) -> DataFrame:
    """``blocks`` with ``line`` and ``place``: top to bottom, left to right.

    Blocks form a line while each is less than ``tolerance`` below the one
    before; ties keep the input position, so the order is total.
    """
    down = W.partitionBy(*keys).orderBy(F.desc("y"), "pos")
    gap = F.lag("y").over(down) - F.col("y")
    lines = blocks.withColumn("gap", gap).withColumn("line", F.sum(F.when(F.col("gap") >= tolerance, 1).otherwise(0)).over(down))
    across = W.partitionBy(*keys).orderBy("line", "x", "pos")
    return lines.withColumn("place", F.row_number().over(across)).drop("gap")


def pack_batches(blocks: DataFrame, key: str, order: str, window: int = 4000, separator: str = SEPARATOR) -> DataFrame:
    """``(key, order, batch)``: consecutive blocks whose bytes and separators fit the window; a larger block is alone.

    A block's batch depends on all blocks before it, so each document's sizes,
    not its texts, are put in order in one array and walked once.
    """
    gap = len(separator.encode())

    @F.pandas_udf("array<bigint>")
    def walked(sizes: pd.Series) -> pd.Series:
        return pd.Series([_batches(s, window, gap) for s in sizes])

    sizes = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.octet_length("text").cast("long").alias("n"))))
    rows = blocks.groupBy(key).agg(sizes.alias("sizes"))
    rows = rows.select(key, F.transform("sizes", lambda s: s["at"]).alias("at"), walked(F.transform("sizes", lambda s: s["n"])).alias("batch"))
    return rows.select(key, F.inline(F.arrays_zip("at", "batch"))).withColumnRenamed("at", order)


def _batches(sizes: Iterable[int], window: int, gap: int) -> list[int]:
    out, batch, used = [], 0, None  # bytes of the open batch; None if there is none
    for n in sizes:
        grown = n if used is None else used + gap + n
        if out and (used is None or n >= window or grown > window):
            batch, grown = batch + 1, n
        out.append(batch)
        used = None if n >= window else grown
    return out


def batch_texts(blocks: DataFrame, batches: DataFrame, key: str, order: str, separator: str = SEPARATOR) -> DataFrame:
    """``(key, batch, members, text)``: texts of each batch in order, joined by the separator."""
    members = blocks.join(batches, [key, order])
    ordered = F.array_sort(F.collect_list(F.struct(order, "text")))
    return members.groupBy(key, "batch").agg(F.count("*").alias("members"), F.array_join(F.transform(ordered, lambda s: s["text"]), separator).alias("text"))


def split_batch(text: Column, expected: Column, separator: str = SEPARATOR) -> Column:
    """A translated batch as ``expected`` texts: padded with empty ones, surplus joined into the last."""
    parts = F.split(text, separator, -1)
    n = F.size(parts)
    exact = F.transform(F.concat(parts, F.array_repeat(F.lit(""), F.greatest(expected - n, F.lit(0)).cast("int"))), strip)
    last = strip(F.array_join(F.slice(parts, expected, F.greatest(n - expected + 1, F.lit(1))), separator))
    merged = F.concat(F.transform(F.slice(parts, F.lit(1), F.greatest(expected - 1, F.lit(0))), strip), F.array(last))
    return F.when(n <= expected, exact).otherwise(merged)


def text_layout(blocks: DataFrame) -> DataFrame:
    """Elements straight from text blocks, with full confidence."""
    return blocks.select("doc_id", "page", F.col("pos").alias("element"), F.lit("text").alias("type"), "x", "y", "width", "height", F.lit(1.0).alias("confidence"))


def page_blocks(runs: DataFrame) -> DataFrame:
    """Text blocks from glyph runs of a row: box, mean size, joined text in order of x."""
    ordered = F.array_sort(F.collect_list(F.struct("x", "pos", "text")))
    return runs.groupBy("doc_id", "page", "row").agg(
        F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("width")) - F.min("x")).alias("width"),
        F.max("height").alias("height"), F.avg("font_size").alias("font_size"), F.bool_or("is_bold").alias("is_bold"),
        F.array_join(F.transform(ordered, lambda s: s["text"]), " ").alias("text"),
    )


def is_text_pages(blocks: DataFrame, pages: int = 3) -> DataFrame:
    """Per document: pages, blocks, and whether its first pages hold any text but white space."""
    chars = F.length(F.regexp_replace("text", r"(?U)\s", ""))
    return blocks.groupBy("doc_id").agg(
        F.coalesce(F.max("page"), F.lit(0)).alias("pages"), F.count("*").alias("blocks"),
        (F.sum(F.when(F.col("page") <= pages, chars).otherwise(0)) > 0).alias("is_text"),
    )


def placed_runs(runs: DataFrame, width: float = 612.0, height: float = 792.0, margin: float = 72.0) -> DataFrame:
    """``runs`` with usable boxes: where no run of a page has a position, its runs are stacked from the top.

    A stacked run is as wide as the page's text, and as high as its bytes take
    at 80 to a line and 50 lines to a page.
    """
    page = W.partitionBy("doc_id", "page")
    placed = F.bool_or((F.col("x") > 0) | (F.col("y") > 0)).over(page)
    own = F.greatest(F.octet_length("text"), F.lit(80)).cast("long")
    rows = runs.withColumns({"placed": placed, "own": own, "so_far": F.sum(own).over(page.orderBy("pos"))})
    line = height / 50
    stacked = {"x": F.lit(margin), "y": height - margin - F.col("so_far") / 80.0 * line, "width": F.lit(width - 2 * margin), "height": F.col("own") / 80.0 * line}
    return rows.withColumns({c: F.when(F.col("placed"), F.col(c)).otherwise(v) for c, v in stacked.items()}).drop("placed", "own", "so_far")
