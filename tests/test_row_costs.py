"""What row-wise queries spend on a row: no expression is worked out once for each of its uses, no fold over characters."""

import random
import re
import time

from pyspark.sql import functions as F

from inkspan.functions import geometry
from inkspan.functions.text import WIDE
from inkspan.plans import catalog

SF = "/root/testdata/sf0.001"


def plain_lines(text: str, size: float, width: float) -> int:
    wide = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: f"\\U{int(m.group(1), 16):08x}", WIDE))
    lines, used = 1, 0.0
    for c in text.replace("\r", ""):
        w = (1.0 if wide.match(c) else 0.25 if c in " \t" else 0.5) * size
        lines, used = (lines + 1, 0.0) if c == "\n" else (lines + 1, w) if used + w > width else (lines, used + w)
    return lines


def test_wrapped_lines_equal_a_plain_walk(spark):
    rng = random.Random(4)
    made = [("".join(rng.choice("ab lc\t\n\r漢　｡é\U00020000\U0001d11e") for _ in range(rng.choice([0, 1, 5, 40, 300]))), rng.choice([0.5, 9.0, 14.0, 50.0, 99.0, 150.0, 300.0])) for _ in range(400)]
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(made)], "i int, t string, s double")
    found = {r.i: r.n for r in rows.select("i", geometry.lines_needed(F.col("t"), F.col("s"), F.lit(200.0)).alias("n")).collect()}
    assert [found[i] for i in range(len(made))] == [plain_lines(t, s, 200.0) for t, s in made]


def test_wrapping_does_not_fold_over_characters(spark):
    start = time.time()
    rows = spark.range(1).select(F.repeat(F.lit("some words "), 300_000).alias("t"))
    assert rows.select(geometry.lines_needed(F.col("t"), F.lit(10.0), F.lit(200.0)).alias("n")).first().n > 1000
    assert time.time() - start < 8


def times(spark, name: str, pattern: str) -> int:
    """How often an expression stands in a query's optimised plan."""
    return catalog.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().count(pattern)


def test_lines_are_stripped_once_for_each_predicate(spark):
    assert times(spark, "document_predicates", r"\s+\z") <= 2


def test_words_of_a_line_are_made_once_for_a_text(spark):
    assert times(spark, "repair_cells", "[^A-Za-z0-9]+") <= 1 and times(spark, "repair_line_signs", "[^A-Za-z0-9]+") <= 2


def test_sets_of_characters_are_no_long_alternatives(spark):
    """Symbols are told from common characters by a class with a range; PostScript's words are sought as they are, words of a text are not split."""
    plan = catalog.queries()["block_predicates"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(" not in plan and "moveto|" not in plan and "split(text#" not in plan.split("Generate")[0].split("line_numbers")[0]
