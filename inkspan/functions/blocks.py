"""Predicates and classifiers of text blocks on a page.

Two families disagree on order and thresholds, so each has its own name: the
``parsed_`` ones belong to the row-grouped scan, the ``glyph_`` ones to the
glyph-run scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkspan.functions.text import count, is_all_upper, lower_contains, strip

# Symbol sets and keyword lists of the predicates below.
SYMBOLS = "∫∑∏√∂∇±×÷≤≥≠≈∞∈∉⊂⊃∪∩∧∨¬∀∃αβγδεζηθικλμνξοπρστυφχψω"
SCRIPTS = "²³⁰¹⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉"
BIG = "[∫∑∏√∂∇]"
POSTSCRIPT_SHORT = "currentpoint|gsave|grestore|newpath|closepath|setrgbcolor|setgray|setlinewidth|showpage|moveto|lineto"
POSTSCRIPT = POSTSCRIPT_SHORT + "|curveto|stroke|fill"
CAPTIONS = ("figure", "table", "fig.", "tab.", "图", "表")
PARSED_HEADINGS = ("chapter", "section", "appendix", "abstract", "introduction", "conclusion", "references", "bibliography", "acknowledgment")
GLYPH_HEADINGS = "chapter|section|appendix|abstract|introduction|conclusion|references|bibliography|background|method|result|discussion"
SHORT_WORDS = "an as at be by do go he if in is it me my no of on or so to up us we".split()


def is_postscript(c: Column) -> Column:
    """Looks like PostScript: definitions, markers, operators, or three names in slash form outside URLs."""
    low = F.lower(c)
    defines = (c.contains(" def ") | c.endswith(" def")) & c.contains("/")
    names = count(c, r"(?<!\S)/[A-Za-z0-9_@]+(?!\S)")
    many = c.contains("/") & ~c.contains("://") & ~low.contains("http") & (names >= 3)
    return defines | lower_contains(c, "null def", "/burl", "burl@") | c.contains("@stx") | c.contains("@etx") | lower_contains(c, *POSTSCRIPT.split("|")) | many


def is_postscript_short(c: Column) -> Column:
    return ((c.contains(" def ") | c.endswith(" def")) & c.contains("/")) | lower_contains(c, *POSTSCRIPT_SHORT.split("|"))


def is_unprintable(c: Column) -> Column:
    """Control characters make up over a tenth of the bytes."""
    bad = count(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")
    return F.coalesce(F.try_divide(bad, F.octet_length(c)) > 0.1, F.lit(False))


def is_formula_parsed(c: Column) -> Column:
    operators = count_chars(c, "-+*/=<>^_~()[]{}" + SYMBOLS)
    ratio = F.coalesce(F.try_divide(operators, F.length(c)) > 0.3, F.lit(False))
    equation = c.contains("=") & c.rlike(r"[(+-]") & (word_count(c) <= 5) & (F.octet_length(c) < 100)
    indexed = (count(c, "[_^]") > 2) & (F.octet_length(c) < 100)
    return ratio | equation | c.rlike(BIG) | indexed


def is_formula_glyph(c: Column) -> Column:
    symbols = count_chars(c, "-+*/=<>^_" + SYMBOLS + SCRIPTS)
    ratio = F.coalesce(F.try_divide(symbols, F.length(c)) > 0.25, F.lit(False))
    function = c.contains("=") & c.rlike("[()]") & (F.octet_length(c) < 50) & (count_class(c, "[A-Za-z]") < 10) & (symbols > 2)
    return ratio | c.rlike(BIG) | c.rlike("[²³¹⁰⁴-⁹₀-₉]") | function


def is_formula_bytes(c: Column) -> Column:
    symbols = count_chars(c, "-+*/=<>^_" + SYMBOLS)
    return F.coalesce(F.try_divide(symbols, F.octet_length(c)) > 0.25, F.lit(False)) | c.rlike(BIG)


def count_chars(c: Column, chars: str) -> Column:
    """Characters of a text that are in a set. Those beyond Latin-1 are behind a range, so that common characters are told by two tests."""
    latin, rest = (sorted(x for x in set(chars) if (x < "\u0100") is near) for near in (True, False))
    far = f"[{rest[0]}-{rest[-1]}&&[{''.join(rest)}]]" if rest else ""
    return count_class(c, "[" + "".join("\\" + x if x < "\x80" and not x.isalnum() else x for x in latin) + far + "]")


def count_class(c: Column, pattern: str) -> Column:
    """Characters of a text in a class; runs of them are matched whole."""
    return (F.length(c) - F.length(F.regexp_replace(c, pattern + "+", ""))).cast("long")


def word_count(c: Column) -> Column:
    return count(c, r"(?U)\S+")


def is_caption(c: Column) -> Column:
    return F.lower(c).rlike("^(?:" + "|".join(x.replace(".", r"\.") for x in CAPTIONS) + ")")


def is_list_item(t: Column) -> Column:
    """Stripped text that starts with a bullet, or with a letter or digit and ``)`` or ``.``, or ``(x)``."""
    bullet = t.rlike("^[•◦▪▫●○■□*–—-]")
    marked = t.rlike(r"(?s)^[0-9a-z][).].") | (t.rlike(r"(?s)^\(.(\)|.\))") & (F.octet_length(t) >= 3))
    return (F.octet_length(t) >= 2) & (bullet | marked)


def is_numbered_heading(t: Column) -> Column:
    """Stripped text that starts with a heading word, or with dotted or bracketed numbering and under 80 bytes of title."""
    number = F.regexp_extract(t, r"^[0-9A-Z][0-9.A-Z]{0,14}", 0)
    after = F.substr(t, F.length(number) + 1)
    dotted = number.contains(".") & after.rlike("^[ \t]") & (F.octet_length(strip(after)) < 80)
    closed = ~number.contains(".") & after.rlike(r"^[.)][ \t]") & (F.octet_length(strip(F.substr(after, F.lit(2)))) < 80)
    worded = F.lower(t).rlike("^(?:" + "|".join(PARSED_HEADINGS) + ")")
    return worded | (t.rlike("^[0-9A-Z].") & (dotted | closed))


def is_heading_glyph(t: Column, size: Column, bold: Column) -> Column:
    """A heading word at the start or after a space, numbering before a short title, or bold, large and short.

    Of several marks among the first ten characters the last leaves the shortest
    title, and all leave the same end, so the last one decides.
    """
    worded = F.lower(t).rlike(f"(?:^| )(?:{GLYPH_HEADINGS})")
    mark = r"(?s)^[0-9A-Z].{0,8}[.)](?=[ \t])"
    tail = strip(F.substr(t, F.length(F.regexp_extract(t, mark, 0)) + 1))
    numbered = t.rlike(mark) & (F.octet_length(tail) < 80) & ~tail.endswith(".")
    return worded | (bold & (F.octet_length(t) < 100) & (size > 12)) | numbered


def block_type_parsed(t: Column, size: Column, bold: Column) -> Column:
    """formula, heading, caption, footnote, list_item or paragraph, in this order, of a stripped text."""
    bytes_ = F.octet_length(t)
    short, large = bytes_ < 100, size > 12
    heading = (bold & short & (large | (is_all_upper(t) & (bytes_ > 2)))) | (large & short & ~t.contains(".")) | is_numbered_heading(t)
    footnote = t.rlike("^[0-9]") & (bytes_ < 200) & t.contains(".") & ~t.endswith(".")
    return (
        F.when(t == "", "paragraph")
        .when(is_formula_parsed(t), "formula")
        .when(heading, "heading")
        .when(is_caption(t), "caption")
        .when(footnote, "footnote")
        .when(is_list_item(t), "list_item")
        .otherwise("paragraph")
    )


def block_type_glyph(t: Column, size: Column, bold: Column) -> Column:
    """formula, caption, heading or paragraph, in this order, of a stripped text."""
    return (
        F.when(t == "", "paragraph")
        .when(is_formula_glyph(t), "formula")
        .when(is_caption(t), "caption")
        .when(is_heading_glyph(t, size, bold), "heading")
        .otherwise("paragraph")
    )


def is_line_numbers(c: Column) -> Column:
    """Three lines or more, over 0.7 of them digits alone."""
    lines = F.split(strip(c), "\n", -1)
    digits = F.size(F.filter(lines, lambda x: strip(x).rlike(r"^[0-9]+\z")))
    return (F.size(lines) >= 3) & (digits / F.size(lines) > 0.7)


def should_translate(t: Column) -> Column:
    """Stripped text of three bytes or more, neither line numbers nor formula, and 0.3 of its bytes ASCII letters."""
    letters = F.coalesce(F.try_divide(count_class(t, "[A-Za-z]"), F.octet_length(t)), F.lit(0.0))
    return (F.octet_length(t) >= 3) & ~is_line_numbers(t) & ~is_formula_bytes(t) & (letters >= 0.3)


def is_translatable_block(text: Column, kind: Column, x: Column, y: Column, width: Column) -> Column:
    """Not a formula, blank, misplaced, tiny, or a page mark."""
    low = F.lower(strip(text))
    placed = ~((x == 0) & (y == 0)) & (y >= 0)
    tiny = (F.octet_length(text) < 3) & (width < 20)
    return (kind != "formula") & (strip(text) != "") & placed & ~tiny & (low != "preprint") & ~low.startswith("arxiv:")


def is_word_boundary(prev: Column, curr: Column) -> Column:
    """Whether two glyph runs of a line need a space between them."""
    last, first = F.right(prev, F.lit(1)), F.left(curr, F.lit(1))
    empty = (prev == "") | (curr == "")
    glued = (last == "-") | first.rlike(r"^[,.;:)\]}']") | last.rlike(r"[(\[{]\z")
    single = prev.rlike(r"^[a-z]\z") | curr.rlike(r"^[a-z]\z")
    two = prev.rlike(r"^[a-z]{2}\z") & first.rlike("^[a-z]")
    known = prev.isin(*SHORT_WORDS)
    return F.when(empty | glued | single, False).when(two & ~known, False).otherwise((F.octet_length(prev) >= 2) & (F.octet_length(curr) >= 2))
