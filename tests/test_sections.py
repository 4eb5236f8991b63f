"""Content validation: one pass over the blocks of both versions gives what a plain walk gives."""

import random
import re
import sys
import unicodedata

from pyspark.sql import functions as F

from inkspan.functions.text import BLANKS, strip, strip_short
from inkspan.operators import sections
from inkspan.plans import catalog

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, page long, pos long, text string, font_size double, block_type string, in_original boolean, in_translated boolean"
TEXTS = [
    "Abstract", "摘要", " 1. Intro　", "1.1 Back", "2 Back", "1.1.1 Deep", "Section 3: X", "Appendix A: More", "see the APPENDIX", "附录 B", "A.1 Details", "A. Appendix", "References", "plain words", "x", None, "",
    "3 " + "long " * 30, "Introduction", "引言", "4 Introduction", "5 引言", "7 intro", "8 INTRO",
]


def plain_sections(blocks: list[tuple]) -> dict[str, tuple]:
    """Key of each section to (type, page, title, is_appendix), in reading order."""
    found, inside = {}, False
    for _, page, _, text, size, kind, *_ in sorted(blocks, key=lambda b: b[1:3]):
        t = (text or "").strip()
        if not 2 <= len(t.encode()) <= 150:
            continue
        inside = inside or "appendix" in t.lower() or "附录" in t
        for pattern, name, _ in sections.PATTERNS:
            m = re.match(pattern.replace(r"\z", r"\Z"), t, re.A)
            if m and (name in sections.NUMBERED or size >= 11 or kind == "heading"):
                number, title = m.group(1), m.group(2).strip() or t
                found.setdefault(f"{name}:{number or title.lower()}", (name, page, title, inside or "appendix" in name))
                break
    return found


def plain_similar(a: str, b: str) -> bool:
    pairs = [(e, o) for e, others in sections.SYNONYMS.items() for o in others]
    return a.lower() == b.lower() or any((e in a.lower() and o in b) or (o in a and e in b.lower()) for e, o in pairs)


def plain_tally(own: list[tuple], other: list[tuple]) -> tuple:
    a, b = plain_sections(own), plain_sections(other)
    missing = [k for k, s in a.items() if k not in b and not any(s[0] == o[0] and abs(s[1] - o[1]) <= 2 and plain_similar(s[2], o[2]) for o in b.values())]
    total, app, kept = len(a), sum(s[3] for s in a.values()), sum(s[3] for s in b.values())
    score = min(100.0, (total - len(missing)) * 80 / total + 20) if total else 100.0
    return total, len(missing), score - (15 if app and not kept else 5 * max(app - kept, 0))


def test_versions_in_one_pass_equal_a_plain_walk(spark):
    rng = random.Random(26)
    rows = []
    for doc in range(150):
        for pos in range(rng.choice([1, 4, 12, 40])):
            in_original = rng.random() < 0.7
            rows.append((doc, 1 + pos // 4, pos, rng.choice(TEXTS), rng.choice([9.0, 12.0]), rng.choice(["paragraph", "heading"]), in_original, not in_original or rng.random() < 0.6))
    frame = spark.createDataFrame(rows, SCHEMA)
    pages = sections.page_loss(frame.groupBy("doc_id").agg(F.lit(1).alias("original_pages"), F.lit(1).alias("translated_pages")))
    marked = frame.select("doc_id", "page", "pos", "in_original", "in_translated")
    found = sections.validate_content(pages, sections.headings(frame).join(marked, ["doc_id", "page", "pos"]))
    want = {d: plain_tally([r for r in rows if r[0] == d and r[6]], [r for r in rows if r[0] == d and r[7]]) for d in range(150)}
    got = {r.doc_id: (r.total, r.missing, r.score) for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[d][2] - want[d][2]) < 1e-9 and got[d][:2] == want[d][:2] for d in want)
    assert any(w[1] for w in want.values()) and any(w[0] and not w[1] for w in want.values())
    # Each version in a table of its own: the same sections are missing.
    own, other = (sections.extract_sections(frame.filter(v)) for v in ("in_original", "in_translated"))
    missing = sections.missing_sections(own, other).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in missing} == {d: w[1] for d, w in want.items() if w[1]}


def test_content_validation_reads_its_table_twice(spark):
    """Once for the headings of both versions, once for their pages; it was seven times."""
    plan = catalog.queries()["content_validation"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 2 and plan.count("Exchange hashpartitioning") <= 2


def test_stripping_by_the_ends_equals_the_pattern(spark):
    points = [c for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and (c < 0x3100 or unicodedata.category(chr(c))[0] in "ZC" and c < 0x20000)]
    rows = [(chr(c) * 2 + "a" + chr(c) + "b" + chr(c),) for c in points] + [(BLANKS,), ("",), (None,), (" a\n",)]
    frame = spark.createDataFrame(rows, "t string")
    assert frame.filter(~strip(F.col("t")).eqNullSafe(strip_short(F.col("t")))).count() == 0
