"""Identifiers, inputs, URLs and file names of papers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkspan.functions.text import strip

SOURCE_BASE = "https://arxiv.org/e-print/"
STRICT = r"^(\d{4}\.\d{4,5}|[a-z-]+/\d{7})\z"
# Names a project's main file usually has, best first.
MAIN_NAMES = ["main.tex", "paper.tex", "article.tex", "manuscript.tex", "document.tex", "thesis.tex", "report.tex"]


def is_paper_id(c: Column) -> Column:
    """Strict identifier: dddd.dddd(d), or archive/ddddddd."""
    return c.rlike(STRICT)


def is_paper_id_lenient(c: Column) -> Column:
    """Ten bytes or more: a dot at index 4 asks for digits elsewhere; else a slash is enough."""
    dotted = F.substring(c, 5, 1) == "."
    long = F.octet_length(c) >= 10
    return F.when(long & dotted, c.rlike(r"^\d{4}\.\d+\z")).otherwise(long & c.contains("/"))


def classify_input(c: Column) -> Column:
    """``url``, ``arxiv_id``, ``local_zip`` or ``local_pdf``, in this order of priority; else null."""
    t = strip(c)
    low = F.lower(t)
    return (
        F.when(low.rlike("^https?://") & low.contains("arxiv"), "url")
        .when(is_paper_id(t), "arxiv_id")
        .when(low.endswith(".zip"), "local_zip")
        .when(low.endswith(".pdf"), "local_pdf")
    )


def extract_paper_id(c: Column) -> Column:
    """Identifier from a URL or a bare lenient identifier; else empty."""
    t = strip(c)
    after = F.regexp_extract(t, r"(?:^|/)(?:abs|pdf)/([^/]*)", 1)
    from_url = F.regexp_replace(after, r"\.pdf\z", "")
    has = t.contains("arxiv.org") & t.rlike(r"(?:^|/)(?:abs|pdf)/")
    return F.when(has, from_url).when(is_paper_id_lenient(t), t).otherwise("")


def feed_paper_id(c: Column) -> Column:
    """Identifier after ``/abs/`` in a feed entry's URL, cut at the first later ``v``."""
    parts = F.split(c, "/abs/", -1)
    return F.when(F.size(parts) < 2, "").otherwise(F.regexp_replace(F.get(parts, F.lit(1)), r"(?s)^(.[^v]*)v.*\z", "$1"))


def canonical_url(c: Column) -> Column:
    """Abstract and PDF pages become the source archive's URL; query and last slash go; other URLs stay."""
    after_pdf = F.when(c.contains("/pdf/"), F.regexp_replace(F.substring_index(c, "/pdf/", -1), r"\.pdf\z", ""))
    after_abs = F.when(c.contains("/abs/"), F.substring_index(c, "/abs/", -1))
    ident = F.regexp_replace(F.substring_index(F.coalesce(after_pdf, after_abs), "?", 1), r"/\z", "")
    named = F.coalesce(after_pdf, after_abs, F.lit("")) != ""
    return F.when(c.contains("arxiv.org") & named, F.concat(F.lit(SOURCE_BASE), ident)).otherwise(c)


def filename_from_url(c: Column) -> Column:
    """Archive name for a URL: its identifier with slashes replaced, else its last segment."""
    safe = lambda x: F.concat(F.translate(x, "/", "_"), F.lit(".tar.gz"))
    name = F.lit(None).cast("string")
    for mark in ("/pdf/", "/abs/", "/src/", "/e-print/"):
        tail = F.substring_index(c, mark, -1)
        if mark == "/pdf/":
            tail = F.regexp_replace(tail, r"\.pdf\z", "")
        name = F.when(c.contains("arxiv.org") & c.contains(mark), safe(tail)).otherwise(name)
    last = F.substring_index(c, "/", -1)
    plain = F.when(last == "", "download.tar.gz").when(last.contains("."), last).otherwise(F.concat(last, F.lit(".tar.gz")))
    return F.coalesce(name, plain)


def sanitise_id(c: Column) -> Column:
    return F.translate(c, "/:\\", "___")


def category_from_filename(c: Column) -> Column:
    """Token before ``_cn.pdf`` or ``_bilingual.pdf``, lower-cased; empty if there is none."""
    return F.regexp_extract(F.lower(c), r"(?s)_([^_]*)_(?:cn|bilingual)\.pdf\z", 1)


def category_strict(c: Column) -> Column:
    """Like ``category_from_filename``, letters and digits only; null if there is none. Check it against the categories."""
    return F.nullif(F.regexp_extract(F.lower(c), r"_([a-z0-9]+)_(?:cn|bilingual)\.pdf\z", 1), F.lit(""))


def synthetic_id(paper_id: Column, md5: Column) -> Column:
    """The identifier, or one made from the source's MD5 where it is empty."""
    return F.coalesce(F.nullif(paper_id, F.lit("")), hash_directory(md5))


def hash_directory(md5: Column) -> Column:
    return F.concat(F.lit("md5_"), F.substring(md5, 1, 16))


def file_kind(name: Column) -> Column:
    """``cn``, ``bilingual`` or ``zip`` by a repository file's name; else null."""
    low = F.lower(name)
    stem = F.regexp_replace(low, r"\.[^.]*\z", "")
    return (
        F.when(low.endswith(".pdf") & stem.rlike("[_-]cn|_chinese"), "cn")
        .when(low.endswith(".pdf") & stem.rlike("[_-]bilingual|_bi"), "bilingual")
        .when(low.endswith(".zip"), "zip")
    )


def is_safe_path(c: Column) -> Column:
    """Archive entry that stays below its folder: not absolute, and never above the top while walking its parts."""
    parts = F.filter(F.split(c, "/", -1), lambda p: (p != "") & (p != "."))
    lowest = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low")),
        lambda s, p: F.struct(
            (s["depth"] + F.when(p == "..", -1).otherwise(1)).alias("depth"),
            F.least(s["low"], s["depth"] + F.when(p == "..", -1).otherwise(1)).alias("low"),
        ),
        lambda s: s["low"],
    )
    return ~c.startswith("/") & ~c.startswith("\\") & (lowest >= 0)


def main_file_rank(path: Column) -> Column:
    """Tier and place of a main-file candidate; the least of a project wins, ties by path."""
    base = F.lower(F.substring_index(path, "/", -1))
    root = ~path.contains("/") & ~path.contains("\\")
    place = F.array_position(F.array(*[F.lit(n) for n in MAIN_NAMES]), base)
    tier = F.when(root & (place > 0), 0).when(root, 1).when(place > 0, 2).otherwise(3)
    return F.struct(tier.alias("tier"), F.when(place > 0, place).otherwise(0).cast("int").alias("place"), path.alias("path"))


def is_serial(c: Column) -> Column:
    return c.rlike(r"^[A-Z0-9]{4}(-[A-Z0-9]{4}){3}\z")
