"""Boxes, positions and text widths of page layout."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkspan.functions.text import WIDE, count, wide_count

# Classes of the layout detector by number, priorities of element kinds, and kinds never translated.
CLASSES = ["title", "text", "page_footer", "picture", "caption", "table", "caption", "footnote", "formula", "caption"]
PRIORITY = {"title": 100, "section_header": 90, "text": 80, "caption": 70, "list_item": 60, "footnote": 50}
UNTRANSLATED = ["formula", "picture", "table", "page_header", "page_footer"]


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of two boxes with x, y, width and height; 0 where they are apart or empty."""
    x1, y1 = F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"])
    x2 = F.least(a["x"] + a["width"], b["x"] + b["width"])
    y2 = F.least(a["y"] + a["height"], b["y"] + b["height"])
    shared = (x2 - x1) * (y2 - y1)
    union = a["width"] * a["height"] + b["width"] * b["height"] - shared
    return F.when((x2 < x1) | (y2 < y1) | (union == 0), 0.0).otherwise(F.try_divide(shared, union))


def box(prefix: str = "") -> dict[str, Column]:
    return {k: F.col(prefix + k) for k in ("x", "y", "width", "height")}


def class_name(class_id: Column) -> Column:
    """Element kind of a detector class; numbers out of range are text."""
    names = F.array(*[F.lit(c) for c in CLASSES])
    return F.coalesce(F.when(class_id >= 0, F.try_element_at(names, (class_id + 1).cast("int"))), F.lit("text"))


def priority(kind: Column) -> Column:
    found = F.lit(0)
    for name, value in PRIORITY.items():
        found = F.when(kind == name, value).otherwise(found)
    return found


def is_translatable_kind(kind: Column) -> Column:
    return ~kind.isin(*UNTRANSLATED)


def within_tolerance(dx: Column, dy: Column, tolerance: float) -> Column:
    limit = tolerance if tolerance > 0 else 10.0
    return (F.abs(dx) < limit) & (F.abs(dy) < limit)


def string_width(text: Column, size: Column) -> Column:
    """Width at a font size: wide characters 1, blanks a quarter, others a half."""
    wide, blank = wide_count(text), count(text, "[ \t]")
    return (wide * 1.0 + blank * 0.25 + (F.length(text) - wide - blank) * 0.5) * size


def text_metrics(text: Column) -> dict[str, Column]:
    wide, blank, newline = wide_count(text), count(text, "[ \t]"), count(text, "[\n\r]")
    total = F.length(text).cast("long")
    other = total - wide - blank - newline
    mean = F.try_divide(wide * 1.0 + other * 0.5 + blank * 0.25, total - newline)
    return {"total_chars": total, "wide_chars": wide, "space_chars": blank, "newline_chars": newline, "latin_chars": other, "avg_width": mean}


def shrink_to_width(text: Column, size: Column, width: Column, height: Column) -> Column:
    """Font size at which one line of the text fits the width, 6 at least."""
    wide, total = wide_count(text), F.length(text)
    need = ((total - wide) * 0.5 + wide) * size
    return F.when((width <= 0) | (height <= 0) | (total == 0) | (need <= width), size).otherwise(F.greatest(size * F.try_divide(width, need), F.lit(6.0)))


def lines_needed(text: Column, size: Column, width: Column) -> Column:
    """Lines a text takes when characters wrap at the width.

    A character becomes a letter for each quarter of the size it is wide, ``l``
    and then ``c``; a line is the longest run of them that ends with a character.
    Where a line may be too narrow for a character, characters are folded over.
    """
    room = F.floor(F.least(F.try_divide(4.0 * width, size), F.lit(1e9))).cast("int")
    line = F.concat(F.lit("[lc]{1,"), room.cast("string"), F.lit("}(?!c)"))
    bound = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))

    def units(bare: Column) -> Column:
        others, far = r"[^ \t\n\u3000-\x{3FFFF}]", r"[\u3000-\x{3FFFF}]"
        wide = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, others, "lc"), WIDE, "lccc"), far, "lc")
        made = F.when(bare.rlike(far), wide).otherwise(F.regexp_replace(bare, r"[^ \t\n]", "lc"))
        return F.replace(F.replace(made, F.lit(" "), F.lit("l")), F.lit("\t"), F.lit("l"))

    def wrapped(made: Column) -> Column:
        return (1 + F.length(made) - F.length(F.replace(made, F.lit("\n"), F.lit(""))) + F.regexp_count(made, line) - F.regexp_count(made, F.lit("[lc]+"))).cast("long")

    lines = bound(bound(F.replace(text, F.lit("\r"), F.lit("")), units), wrapped)
    folded = _lines_folded(text, size, width)
    return F.when((width <= 0) | (size <= 0), F.lit(1).cast("long")).when(room >= 4, lines).otherwise(folded)


def _lines_folded(text: Column, size: Column, width: Column) -> Column:
    chars = F.filter(F.split(text, ""), lambda c: (c != "") & (c != "\r"))

    def step(state: Column, c: Column) -> Column:
        w = F.when(c.rlike(WIDE), 1.0).when(c.isin(" ", "\t"), 0.25).otherwise(0.5) * size
        over = state["used"] + w > width
        return F.struct(
            (state["lines"] + F.when((c == "\n") | over, 1).otherwise(0)).cast("long").alias("lines"),
            F.when(c == "\n", 0.0).when(over, w).otherwise(state["used"] + w).alias("used"),
        )

    start = F.struct(F.lit(1).cast("long").alias("lines"), F.lit(0.0).alias("used"))
    return F.aggregate(chars, start, step, lambda s: s["lines"])


def fits_bounds(text: Column, size: Column, width: Column, height: Column, line_ratio: float = 1.2, lines: Column | None = None) -> Column:
    """The text's lines fit the height, and its mean line the width. ``lines``: what ``lines_needed`` gives, where it is at hand."""
    most = F.greatest(F.floor(F.try_divide(height, size * line_ratio)), F.lit(1))
    lines = lines_needed(text, size, width) if lines is None else lines
    newline = count(text, "[\n\r]")
    total = string_width(text, size) - newline * 0.5 * size
    return F.when(size <= 0, False).otherwise((lines <= most) & (F.try_divide(total, lines) <= width))


def font_size(text: Column, width: float, height: float, low: float = 6.0, high: float = 72.0, step: float = 0.5, line_ratio: float = 1.2) -> Column:
    """Largest font size at which the wrapped text fits the box, found by halving; ``low`` if none does.

    A character is as wide as the size, half of it, or a quarter, by its kind; a
    carriage return has no width. Widths are whole quarters of the size, so no
    sum is rounded. Each of a fixed number of halvings folds over the characters
    at most once; lines and the quarters used in the last one share a number. Where
    the quarters of all lines, full ones or as empty as wrapping can leave them,
    decide by themselves, nothing is folded.
    """
    quarters = lambda c: F.when(c == "\n", -1).when(c.isin(" ", "\t"), 1).when(c < "\u3000", 2).when(c.rlike(WIDE), 4).otherwise(2).cast("long")
    chars = F.transform(F.regexp_extract_all(F.replace(F.coalesce(text, F.lit("")), F.lit("\r"), F.lit("")), F.lit("(?s)."), F.lit(0)), quarters)
    bits, line = 31, 1 << 31

    def fits(t: Column, size: Column) -> Column:
        room = F.lit(4.0 * width) / size

        def wrap(s: Column, u: Column) -> Column:
            below = F.shiftleft(F.shiftright(s, bits) + 1, bits)
            return F.when(u < 0, below).when(s.bitwiseAND(F.lit(line - 1)) + u > room, below + u).otherwise(s + u)

        most = F.greatest(F.lit(1), (F.lit(height) / (size * line_ratio)).cast("int"))

        def inside(s: Column) -> Column:
            lines = F.shiftright(s, bits)
            return (lines <= most) & (t["total"] * size / 4 / lines <= width)

        folded = F.aggregate(t["chars"], F.lit(line).cast("long"), wrap, inside)
        # No line holds more than the room; one that is wrapped lacks less than a wide character (4) of it.
        over, under = t["total"] > most * room * (1 + 1e-9), t["total"] < (most - 1 - t["newlines"]) * (room - 4) * (1 - 1e-9)
        return F.when((room > 4) & over, False).when((room > 4) & (most > t["newlines"]) & under, True).otherwise(folded)

    def halve(t: Column):
        def once(s: Column, _: Column) -> Column:
            middle = (s["low"] + s["high"]) / 2
            state = lambda lo, hi, best: F.struct(lo.alias("low"), hi.alias("high"), best.alias("best"))
            higher, lower = state(middle + step, s["high"], middle), state(s["low"], middle - step, s["best"])
            return F.when(s["high"] - s["low"] < step, s).when(fits(t, middle), higher).otherwise(lower)

        return once

    steps = F.sequence(F.lit(1), F.lit(max(1, math.ceil(math.log2(max(2.0, (high - low) / step))) + 1)))
    start = F.struct(F.lit(low).alias("low"), F.lit(high).alias("high"), F.lit(low).alias("best"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, u: n + F.greatest(u, F.lit(0).cast("long")))
    newlines = count(F.coalesce(text, F.lit("")), "\n")
    texts = F.transform(F.array(chars), lambda c: F.struct(c.alias("chars"), total(c).alias("total"), newlines.alias("newlines")))
    return F.get(F.transform(texts, lambda t: F.aggregate(steps, start, halve(t), lambda s: s["best"])), F.lit(0))


def valid_block(page: Column, text: Column, kind: Column, b: dict[str, Column]) -> Column:
    return (page > 0) & (text != "") & (kind != "") & (b["x"] >= 0) & (b["y"] >= 0) & (b["width"] >= 0) & (b["height"] >= 0)
