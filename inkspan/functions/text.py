"""Scalar text functions. Lengths are bytes where a name says so, else characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code-point ranges that layout widths treat as wide; not the same set as the Han script.
WIDE = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{F900}-\x{FAFF}\x{3000}-\x{303F}]"
# Unicode white space.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# Misspelt commands and their corrections.
TYPOS = {"\\begn{": "\\begin{", "\\ened{": "\\end{", "\\docmentclass": "\\documentclass", "\\usepackge": "\\usepackage"}
# Signs of text decoded with the wrong charset.
GARBLED = ["鎮ㄧ殑", "锟斤拷", "�"]
# Words that make a comment worth keeping.
MARKERS = "TODO|FIXME|NOTE|XXX|HACK|BUG|WARNING"


def strip(c: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def strip_short(c: Column) -> Column:
    """``strip`` that looks at the ends only; for values of a line's size."""
    return F.btrim(c, F.lit(BLANKS))


def lower_contains(c: Column, *needles: str) -> Column:
    low = F.lower(c)
    found = F.lit(False)
    for n in needles:
        found = found | low.contains(n)
    return found


def any_prefix(c: Column, *prefixes: str) -> Column:
    found = F.lit(False)
    for p in prefixes:
        found = found | c.startswith(p)
    return found


def count(c: Column, pattern: str) -> Column:
    """Matches of a pattern, as long."""
    return F.regexp_count(c, F.lit(pattern)).cast("long")


def count_literal(c: Column, literal: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(literal), F.lit("")))) / len(literal)).cast("long")


def han_count(c: Column) -> Column:
    return count(c, r"\p{IsHan}")


def has_han(c: Column) -> Column:
    return c.rlike(r"\p{IsHan}")


def wide_count(c: Column) -> Column:
    return count(c, WIDE)


def truncate(c: Column, limit: int) -> Column:
    """At most ``limit`` characters, with an ellipsis if cut. Cuts characters, never inside one."""
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.substring(c, 1, limit), F.lit("...")))


def line_count(c: Column) -> Column:
    """Lines of a text; a newline at the end starts no further line."""
    return (F.size(F.split(c, "\n", -1)) - F.when(c.endswith("\n"), 1).otherwise(0)).cast("long")


def nonblank_line_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, "\n", -1), lambda x: strip(x) != "")).cast("long")


def clean_feed_text(c: Column) -> Column:
    """Newlines to spaces, trimmed, runs of spaces to one."""
    return F.regexp_replace(strip(F.replace(c, F.lit("\n"), F.lit(" "))), " {2,}", " ")


def tidy_lines(c: Column) -> Column:
    """Blanks at line ends go; four or more newlines become three."""
    return F.regexp_replace(F.regexp_replace(c, r"(?m)[ \t]+$", ""), "\n{4,}", "\n\n\n")


def collapse_blank_lines(c: Column) -> Column:
    """One empty line for each run of blank ones."""
    lines = F.transform(F.split(c, "\n", -1), lambda x: F.when(strip(x) == "", F.lit("")).otherwise(x))
    pairs = F.arrays_zip(lines.alias("line"), F.concat(F.array(F.lit("-")), lines).alias("before"))
    kept = F.filter(pairs, lambda p: p["line"].isNotNull() & ~((p["line"] == "") & (p["before"] == "")))
    return F.array_join(F.transform(kept, lambda p: p["line"]), "\n")


def fix_typos(c: Column) -> Column:
    for wrong, right in TYPOS.items():
        c = F.replace(c, F.lit(wrong), F.lit(right))
    return c


def is_garbled(c: Column) -> Column:
    found = F.lit(False)
    for sign in GARBLED:
        found = found | c.contains(sign)
    return found


def is_important_comment(c: Column) -> Column:
    return F.upper(c).rlike(MARKERS)


def is_all_upper(c: Column) -> Column:
    """Has letters, and every letter is upper case."""
    return c.rlike(r"\p{L}") & ~c.rlike(r"[\p{L}&&[^\p{Lu}]]")


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix, by bisection over the shorter text's length."""
    steps = F.sequence(F.lit(30), F.lit(0), F.lit(-1))
    longest = F.least(F.length(a), F.length(b))

    def longer(so_far: Column, power: Column) -> Column:
        tried = so_far + F.pow(F.lit(2), power).cast("int")
        return F.when((tried <= longest) & (F.left(a, tried) == F.left(b, tried)), tried).otherwise(so_far)

    return F.aggregate(steps, F.lit(0), longer)


def is_similar(a: Column, b: Column) -> Column:
    """Without spaces: one holds the other, or they share over half of the shorter one as a prefix."""
    x, y = F.replace(strip(a), F.lit(" "), F.lit("")), F.replace(strip(b), F.lit(" "), F.lit(""))
    shorter = F.least(F.length(x), F.length(y))
    alike = x.contains(y) | y.contains(x) | (F.try_divide(common_prefix(x, y), shorter) > 0.5)
    return F.when((x == "") | (y == ""), False).otherwise(alike)


def utf8_bom(content: Column) -> Column:
    return F.hex(F.substring(content, 1, 3)) == "EFBBBF"


def strip_bom(content: Column) -> Column:
    """Bytes without a leading UTF-8 byte-order mark."""
    return F.when(utf8_bom(content), F.substring(content, 4, 2147483647)).otherwise(content)


def sniff_archive(content: Column) -> Column:
    """``gzip`` or ``zip`` by the first bytes, else null."""
    head = F.hex(F.substring(content, 1, 4))
    return F.when(head.startswith("1F8B"), "gzip").when(head == "504B0304", "zip")
