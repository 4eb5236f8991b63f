"""Small rules over values: options, expiry, retries, detections, completeness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkspan.functions import tex
from inkspan.functions.text import han_count, strip

# Text that shows a translation to be a template.
TEMPLATES = [
    "This document contains the translated content", "Please add your paper content here", "Add related work section here",
    "Add methodology section here", "Add experiments section here", "Add conclusion section here", "NeurIPS 2025 Paper Translation",
    "Anonymous Authors", "此处应放置", "此处应填写", "请在此处添加", "翻译内容", "论文翻译", "本文档是", "的翻译版本",
]


def option_errors(o: dict[str, Column]) -> Column:
    """Messages for options out of range."""
    size, overlap, low, high, han = (o[k] for k in ("max_chunk_size", "chunk_overlap", "min_length_ratio", "max_length_ratio", "min_chinese_ratio"))
    rules = [
        F.when(size <= 0, "max_chunk_size must be greater than 0").when(size > 100_000, "max_chunk_size must not exceed 100000"),
        F.when(overlap < 0, "chunk_overlap must be non-negative").when(overlap >= size, "chunk_overlap must be less than max_chunk_size"),
        F.when(low <= 0, "min_length_ratio must be greater than 0").when(low >= 1, "min_length_ratio must be less than 1.0"),
        F.when(high <= 1, "max_length_ratio must be greater than 1.0").when(high > 100, "max_length_ratio must not exceed 100.0"),
        F.when(low >= high, "min_length_ratio must be less than max_length_ratio"),
        F.when(han < 0, "min_chinese_ratio must be non-negative").when(han > 1, "min_chinese_ratio must not exceed 1.0"),
    ]
    return F.array_compact(F.array(*rules))


def merge_options(base: dict[str, Column], over: dict[str, Column]) -> dict[str, Column]:
    """Each option of ``over`` that is not zero, else that of ``base``."""
    return {k: F.coalesce(F.nullif(over[k], F.lit(0)), base[k]) if k in over else base[k] for k in base}


def _expiry(stamp: Column) -> Column:
    return F.try_to_timestamp(F.nullif(stamp, F.lit("")), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))


def is_expired(stamp: Column, now: Column) -> Column:
    """Missing or malformed times are expired."""
    return F.coalesce(now > _expiry(stamp), F.lit(True))


def days_until_expiry(stamp: Column, now: Column) -> Column:
    """Whole days, toward zero; -1 for a missing or malformed time."""
    seconds = _expiry(stamp).cast("double") - now.cast("double")
    return F.coalesce((seconds / 86_400).cast("long"), F.lit(-1).cast("long"))


def backoff_seconds(attempt: Column, base: int = 2, most: int = 30) -> Column:
    """Delay before a retry: doubling from ``base``, up to ``most``."""
    return F.least(F.lit(most), base * F.pow(F.lit(2), attempt - 1)).cast("long")


def is_retryable(code: Column, detail: Column) -> Column:
    """Error of a batch call that is worth another try."""
    final = detail.rlike("authentication failed|invalid API key|unauthorized|invalid API request")
    passing = detail.rlike("rate limit|status 5|server error|connection|timeout|network|EOF|reset by peer")
    return ~final & (passing | (code == "API_FAILED"))


def is_retryable_call(code: Column, detail: Column) -> Column:
    """Error of a single call that is worth another try: network, rate limit, or a server's fault."""
    return code.isin("NETWORK", "API_RATE_LIMIT") | ((code == "API_CALL") & detail.contains("status 5"))


def detection_out_of_range(b: dict[str, Column], confidence: Column, class_id: Column, width: float, height: float) -> Column:
    outside = (b["x"] < 0) | (b["y"] < 0) | (b["x"] + b["width"] > width) | (b["y"] + b["height"] > height)
    return outside | (confidence < 0) | (confidence > 1) | (class_id < 0)


def has_template_text(c: Column) -> Column:
    found = F.lit(False)
    for phrase in TEMPLATES:
        found = found | c.contains(phrase)
    return found


def structure_preserved(original: Column, translated: Column) -> Column:
    """One class name holds the other, and at least half of the sections are left."""
    a, b = tex.document_class(original), tex.document_class(translated)
    classes = (a == "") | (b == "") | a.contains(b) | b.contains(a)
    before, after = tex.major_section_count(original), tex.major_section_count(translated)
    return classes & ~((before > 0) & (after < F.floor(before / 2)))


def translation_errors(original: Column, translated: Column, low: float = 0.3, han: float = 0.05) -> Column:
    """Messages for a translation that cannot be right; lengths are bytes."""
    a, b = F.octet_length(original), F.octet_length(translated)
    ratio = F.coalesce(F.try_divide(b, a), F.lit(0.0))
    share = F.coalesce(F.try_divide(han_count(translated), b), F.lit(0.0))
    least = F.when(b < 10_000, 0.02).otherwise(han)
    command = "\\documentclass"
    rules = [
        F.when(ratio < low, "too short"),
        F.when((share < least) & (b > 1000), "too few Han characters"),
        F.when(original.contains(command) & ~translated.contains(command), "required structure lost"),
        F.when(has_template_text(translated), "template text"),
    ]
    return F.when(strip(translated) == "", F.array(F.lit("empty"))).otherwise(F.array_compact(F.array(*rules)))


def translation_warnings(original: Column, translated: Column, high: float = 3.0) -> Column:
    ratio = F.coalesce(F.try_divide(F.octet_length(translated), F.octet_length(original)), F.lit(0.0))
    rules = [F.when(ratio > high, "too long"), F.when(~structure_preserved(original, translated), "structure differs")]
    return F.when(strip(translated) == "", F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*rules)))


def chunk_errors(original: Column, translated: Column) -> Column:
    """Like ``translation_errors``, lenient for one chunk."""
    ratio = F.coalesce(F.try_divide(F.octet_length(translated), F.octet_length(original)), F.lit(0.0))
    rules = [F.when(ratio < 0.1, "too short"), F.when(has_template_text(translated), "template text")]
    empty = (strip(translated) == "") & (strip(original) != "")
    return F.when(empty, F.array(F.lit("empty"))).otherwise(F.array_compact(F.array(*rules)))


def completeness_score(suspicious: Column, page_difference: Column, total: Column, missing: Column, appendices: Column, kept_appendices: Column) -> Column:
    """0 to 100 from page count, sections and appendices."""
    base = F.when(suspicious, 80.0).otherwise(100.0)
    sections = F.try_divide((total - missing) * 80.0, total) + 20.0
    score = F.when(total > 0, F.least(base, sections)).when(suspicious, F.greatest(100.0 - page_difference * 100, F.lit(0.0))).otherwise(base)
    gone = F.when((appendices > 0) & (kept_appendices == 0), 15.0).when(appendices > kept_appendices, (appendices - kept_appendices) * 5.0).otherwise(0.0)
    return score - gone
