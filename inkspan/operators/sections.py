"""Sections of paged documents: detection, matching, completeness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkspan.functions.checks import completeness_score
from inkspan.functions.text import strip, strip_short

# Heading patterns by kind and level, tried in this order, and titles that translate each other.
PATTERNS = [
    (r"^(\d+\.\d+\.\d+)\s*\.?\s+(.+)\z", "subsubsection", 3), (r"^(\d+\.\d+)\s*\.?\s+(.+)\z", "subsection", 2), (r"^(\d+)\s*\.?\s+(.+)\z", "section", 1),
    (r"^Section\s+(\d+)[:\s]*(.*)\z", "section", 1), (r"^([A-Z]\.\d+)\s*\.?\s+(.+)\z", "appendix_subsection", 2), (r"^Appendix\s+([A-Z])[:\s]*(.*)\z", "appendix", 1),
    (r"^([A-Z])\s*\.\s*Appendix[:\s]*(.*)\z", "appendix", 1), (r"^附录\s*([A-Z]?)[:\s]*(.*)\z", "appendix", 1), (r"^()()(?:Abstract|摘要)\z", "abstract", 0),
    (r"^()()(?:Introduction|引言)\z", "introduction", 1), (r"^()()(?:Conclusions?|结论)\z", "conclusion", 1), (r"^()()(?:References?|参考文献)\z", "references", 1),
    (r"^()()(?:Acknowledgments?|致谢)\z", "acknowledgments", 1),
]
SYNONYMS = {
    "introduction": ["引言", "介绍", "简介"], "background": ["背景", "研究背景"], "related work": ["相关工作", "相关研究"], "method": ["方法", "方法论"],
    "methodology": ["方法论", "研究方法"], "experiment": ["实验", "实验设置"], "experiments": ["实验", "实验结果"], "results": ["结果", "实验结果"],
    "discussion": ["讨论", "分析讨论"], "conclusion": ["结论", "总结"], "conclusions": ["结论", "总结"], "abstract": ["摘要"], "references": ["参考文献", "引用"],
    "acknowledgments": ["致谢", "鸣谢"], "appendix": ["附录"], "evaluation": ["评估", "评价"], "analysis": ["分析"], "implementation": ["实现", "实施"],
    "limitations": ["局限性", "限制"], "future work": ["未来工作", "展望"],
}
NUMBERED = ["section", "subsection", "subsubsection", "appendix", "appendix_subsection"]


def headings(blocks: DataFrame) -> DataFrame:
    """Blocks that read as headings (type, level, number, title) or only mention an appendix (type null), row by row.

    A block is 2 to 150 bytes; unnumbered kinds also need a size of 11 or the
    heading type. Few blocks are left, so what follows shuffles and sorts few.
    """
    t, size = F.col("t"), F.octet_length("t")
    likely = (F.col("font_size") >= 11) | (F.col("block_type") == "heading")
    fits = [t.rlike(pattern) & (F.lit(kind in NUMBERED) | likely) for pattern, kind, _ in PATTERNS]
    pick = lambda values: reduce(lambda a, i: a.when(F.col("fit") == i, values[i]), range(1, len(values)), F.when(F.col("fit") == 0, values[0]))
    group = lambda g: pick([F.regexp_extract(t, pattern, g) if kind in NUMBERED else F.lit("") for pattern, kind, _ in PATTERNS])
    fit = reduce(lambda a, i: a.when(fits[i], i), range(1, len(fits)), F.when(fits[0], 0))
    rows = blocks.withColumn("t", strip_short(F.col("text"))).filter((size >= 2) & (size <= 150))
    rows = rows.withColumns({"fit": fit, "mention": F.lower(t).contains("appendix") | t.contains("附录")}).filter(F.col("fit").isNotNull() | F.col("mention"))
    rows = rows.withColumns({"type": pick([F.lit(k) for _, k, _ in PATTERNS]), "level": pick([F.lit(n) for _, _, n in PATTERNS]), "number": group(1), "title": strip(group(2))})
    return rows.select("doc_id", "page", "pos", "type", "level", "number", F.when(F.col("title") == "", t).otherwise(F.col("title")).alias("title"), "mention")


def first_sections(rows: DataFrame, versions: list[str]) -> DataFrame:
    """Headings that count as sections of a version; a boolean column for each version tells its rows, and afterwards its sections.

    From the first mention of an appendix in a version on, all of it is appendix
    (``<version>_appendix``). Of sections that repeat a type and number (or
    title, without case, if unnumbered) the first counts.
    """
    so_far = W.partitionBy("doc_id").orderBy("page", "pos").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({f"{v}_appendix": F.max(F.col("mention") & F.col(v)).over(so_far) | F.col("type").contains("appendix") for v in versions})
    rows = rows.filter("type is not null").withColumn("key", section_key(F.col("type"), F.col("number"), F.col("title")))
    of_key = W.partitionBy("doc_id", "key").orderBy("page", "pos").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({f"{v}_nth": F.count_if(v).over(of_key) for v in versions})
    rows = rows.withColumns({v: F.col(v) & (F.col(f"{v}_nth") == 1) for v in versions})
    return rows.filter(reduce(lambda a, b: a | b, [F.col(v) for v in versions])).drop("mention", "key", *[f"{v}_nth" for v in versions])


def extract_sections(blocks: DataFrame) -> DataFrame:
    """``(doc_id, page, pos, type, level, number, title, is_appendix)`` of the blocks that read as headings, the first of each key."""
    return first_sections(headings(blocks).withColumn("own", F.lit(True)), ["own"]).withColumnRenamed("own_appendix", "is_appendix").drop("own")


def section_key(kind: Column, number: Column, title: Column) -> Column:
    return F.concat(kind, F.lit(":"), F.when(number != "", number).otherwise(F.lower(title)))


def titles_similar(a: Column, b: Column) -> Column:
    """Equal without case, or a title and its translation by the fixed list."""
    alike = F.lower(a) == F.lower(b)
    for english, others in SYNONYMS.items():
        for other in others:
            alike = alike | (F.lower(a).contains(english) & b.contains(other)) | (a.contains(other) & F.lower(b).contains(english))
    return alike


def mark_missing(rows: DataFrame) -> DataFrame:
    """Adds ``missing``: a section ``in_original`` without a counterpart ``in_translated``, by key, then by type, nearby page and similar title.

    Both versions lie in one frame, so their rows meet in windows of a document
    without a join; the second looks at five pages and one type at a time.
    """
    c = F.col
    same = W.partitionBy("doc_id", "key")
    near = W.partitionBy("doc_id", "type").orderBy("page").rangeBetween(-2, 2)
    keyed = rows.withColumn("key", section_key(c("type"), c("number"), c("title"))).withColumn("has_key", F.max("in_translated").over(same))
    keyed = keyed.withColumn("near", F.collect_list(F.when(c("in_translated") & c("page").isNotNull(), c("title"))).over(near))
    return keyed.withColumn("missing", c("in_original") & ~c("has_key") & ~F.exists("near", lambda t: titles_similar(c("title"), t))).drop("key", "has_key", "near")


def missing_sections(original: DataFrame, translated: DataFrame) -> DataFrame:
    """Sections of the original without a counterpart among those of the translation."""
    both = original.withColumns({"in_original": F.lit(True), "in_translated": F.lit(False)}).unionByName(
        translated.withColumns({"in_original": F.lit(False), "in_translated": F.lit(True)}), allowMissingColumns=True
    )
    return mark_missing(both).filter("missing").drop("missing", "in_original", "in_translated")


def page_loss(pages: DataFrame, threshold: float = 0.15) -> DataFrame:
    """Pages of both versions (doc_id, original_pages, translated_pages) and whether too many were lost."""
    difference = F.col("original_pages") - F.col("translated_pages")
    share = F.coalesce(F.try_divide(difference, F.col("original_pages")), F.lit(0.0))
    return pages.withColumns({"difference": difference, "diff_percent": share, "is_suspicious": share > threshold})


def page_difference(original: DataFrame, translated: DataFrame, threshold: float = 0.15) -> DataFrame:
    """``page_loss`` of two tables (doc_id, pages)."""
    joined = original.select("doc_id", F.col("pages").alias("original_pages")).join(translated.select("doc_id", F.col("pages").alias("translated_pages")), "doc_id")
    return page_loss(joined, threshold)


def validate_content(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """Per document of ``pages`` (of ``page_loss``): completeness score, and complete if nothing is missing and it is 70 or more.

    ``rows`` are the headings of both versions, told by ``in_original`` and
    ``in_translated``; one that both have stands once or twice.
    """
    c = F.col
    found = mark_missing(first_sections(rows, ["in_original", "in_translated"]))
    tally = found.groupBy("doc_id").agg(
        F.count_if("in_original").alias("total"), F.count_if(c("in_original") & c("in_original_appendix")).alias("appendices"),
        F.count_if(c("in_translated") & c("in_translated_appendix")).alias("kept_appendices"), F.count_if("missing").alias("missing"),
    )
    rows = pages.join(tally, "doc_id", "left").fillna(0, ["total", "appendices", "kept_appendices", "missing"])
    score = completeness_score(c("is_suspicious"), c("diff_percent"), c("total"), c("missing"), c("appendices"), c("kept_appendices"))
    return rows.withColumn("score", score).withColumn("is_complete", (c("missing") == 0) & (c("score") >= 70)).select("doc_id", "total", "missing", "score", "is_complete")
