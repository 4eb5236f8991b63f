"""Invariants and examples of the rules over one text."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkspan.functions import blocks, checks, ids, tex, text
from inkspan.functions.rules import chunks, repairs, spans, validators
from inkspan.operators import layout, rules, sections

WORDS = "alpha beta gamma delta epsilon".split()


def document(rng):
    parts = []
    for _ in range(rng.randint(1, 25)):
        w = " ".join(rng.choices(WORDS, k=rng.randint(1, 8)))
        parts.append(
            rng.choice(
                [
                    w + ". ", f"${w}$", f"\\[ {w} \\]", f"\\begin{{equation}}{w}\\end{{equation}}", f"\n% {w}\n", f"\\textbf{{{w}}}", "\n\n", f"\\section{{{w}}}\n", f"\\cite{{{w[:3]}}}",
                    f"\\begin{{table}}\\begin{{tabular}}{{cc}} {w} & 1 \\\\ \\hline\\end{{tabular}}\\end{{table}}", "5\\% ", f"\\author{{{w} \\thanks{{x}}}}", "$$ x $$", "汉字。", "\\{ ", f"\\begin{{itemize}}\\item {w}\\end{{itemize}}",
                ]
            )
        )
    return "".join(parts)


@pytest.mark.parametrize("seed", range(100))
def test_invariants_of_random_documents(seed):
    rng = random.Random(seed)
    t = document(rng)
    for kind in spans.PROTECTED:
        made, table = spans.protect_kind(t, kind)
        assert spans.restore(made, table) == t and all(k in made for k in table)
    made, table = spans.protect_all(t)
    assert spans.restore(made, table) == t
    limit = rng.choice([20, 60, 100, 400])
    pieces = chunks.split_chunks(t, limit)
    assert "".join(pieces) == t and all(pieces) or not t
    whole = chunks.boundaries(t)
    at = 0
    for piece in pieces[:-1]:
        at += len(piece)
        assert not chunks.within(at, whole) or chunks.size(piece) > limit or any(b - a > limit // 2 for a, b in whole)
    kept = spans.commands(t)
    assert all(a.end <= b.start for a, b in zip(kept, kept[1:]))
    assert repairs.insert_missing_ends(t) == t
    assert not any(r[2] == "environment" for r in validators.syntax(t))


def test_missing_ends_are_restored_innermost_first():
    assert repairs.restore_environments("\\begin{a}\\begin{b}x") == "\\begin{a}\\begin{b}x\n\\end{b}\n\\end{a}\n"
    assert repairs.fix_nesting("\\begin{a}\\begin{b}\\end{a}") == "\\begin{a}\\begin{b}\n\\end{b}\n\\end{a}"


@pytest.mark.parametrize("t,lacking", [("a{b", 1), ("{{x}", 1), ("x}}", 0), ("\\{ {", 1), ("% {\n}", 0)])
def test_braces_balance_after_repair(t, lacking):
    assert repairs.brace_difference(repairs.restore_braces(t)) == 0


def test_comments_come_back():
    original = "% \\begin{figure}\ntext here stays\n% \\end{figure}\nmore"
    broken = "\\begin{figure}\ntext here stays\n\\end{figure}\nmore"
    assert repairs.restore_comments(broken, original) == original
    assert repairs.fix_by_lines(broken, original) == original


def test_lost_includes_come_back_in_place():
    original = "\\begin{document}\n\\input{a}\n\\input{b}\n\\include{c}\n\\end{document}"
    assert repairs.restore_inputs("\\begin{document}\n\\input{a}\n\\include{c}\n\\end{document}", original) == original
    assert repairs.restore_inputs("\\begin{document}\nx", "\\begin{document}\n\\input{a}\n") == "\\begin{document}\n\\input{a}\nx"


def test_quick_fix_rules():
    assert repairs.quick_fix("\\引用{a}") == "\\cite{a}"
    assert "\\end{itemize}\n\\item b" in repairs.rewrite("\\end{itemize}\\item b", repairs.BREAKS)
    assert repairs.strip_end_braces("\\end{figure}}}") == "\\end{figure}"
    assert repairs.strip_end_braces("\\newcommand{\\x}{\\begin{a}\\end{a}}") == "\\newcommand{\\x}{\\begin{a}\\end{a}}"
    assert repairs.lonely_items("\\item a\n\nb") == "\\begin{itemize}\n\\item a\n\\end{itemize}\n\nb"
    assert repairs.quick_fix("a\n\\end{document}\n}}") == "a\n\\end{document}\n"
    wide = "\\begin{table}[!t]\n\\begin{tabular}{" + "c" * 14 + "}\n\\end{tabular}\n\\end{table}"
    assert repairs.widen_tables(wide).startswith("\\begin{table*}[!t]\n") and repairs.widen_tables(wide).endswith("\\end{table*}")
    assert "\\scalebox{0.7}{%" in repairs.fix_table_layout(wide.replace("c" * 14, "c" * 10))
    assert repairs.fix_figure_layout("\\begin{figure*}[t]\n\\includegraphics[width=1.0\\textwidth]{a}\n\\end{figure}") == "\\begin{figure*}[!htbp]\n\\includegraphics[width=0.85\\textwidth]{a}\n\\end{figure*}"
    assert repairs.close_resizebox("\\resizebox{1}{!}{\\begin{tabular}{c}\\end{tabular}\n\\end{table}").count("}\n\\end{table}") == 1
    assert repairs.simple_fix("\\begn{a}{\\end{document} junk") == "\\begin{a}{}\n\\end{document}\n"


def test_recovery_strategies():
    table = {"<<<LATEX_CMD_0>>>": "\\cite{a}", "<<<LATEX_CMD_1>>>": "zz", "<<<LATEX_CMD_2>>>": "qq"}
    made, done = repairs.recover_placeholders("x \\cite{b} y\nline", "x y\nzz line", table)
    assert dict(done) == {"<<<LATEX_CMD_0>>>": "pattern_match", "<<<LATEX_CMD_1>>>": "line_based", "<<<LATEX_CMD_2>>>": "append"}
    assert all(k in made for k in table)


def test_encodings():
    for name in ("UTF-8", "GBK", "UTF-16LE", "UTF-16BE", "UTF-8-BOM"):
        content = repairs.convert("汉字 text".encode(), name)
        assert repairs.detect_encoding(content) == name and repairs.to_text(content) == "汉字 text"
    assert repairs.detect_encoding(b"\xff\xff\xff") == "UNKNOWN"


def test_font_and_log():
    assert repairs.fit_font("x" * 10_000, 50, 10) == 6.0 and 6 < repairs.fit_font("short", 300, 40) <= 72
    log = "\n".join(["noise"] * 500 + ["! Error here", "l.5 x"] + ["noise"] * 500)
    assert repairs.log_excerpt(log, 400).startswith("! Error here\nl.5 x") and repairs.log_excerpt("a", 10) == "a"


def rows(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, c string")


def evaluate(spark, values, column):
    return [r.v for r in rows(spark, values).select("i", column.alias("v")).orderBy("i").collect()]


def test_brace_counts_of_examples(spark):
    values = ["{}", "{{}", "% {{{\n{}", "\\{ {", "a % {\n", ""]
    assert evaluate(spark, values, tex.brace_counts(F.col("c"))[0]) == [1, 2, 1, 1, 1, 0]
    assert evaluate(spark, values, tex.brace_counts_inline(F.col("c"))[0]) == [1, 2, 1, 1, 0, 0]
    assert evaluate(spark, values, tex.brace_counts_plain(F.col("c"))[0]) == [1, 2, 1, 2, 0, 0]
    assert evaluate(spark, ["{{}{{}}}", "}}{", ""], tex.max_brace_depth(F.col("c"))) == [3, 1, 0]


def test_nesting_of_examples(spark):
    values = ["\\begin{a}\\end{a}", "\\end{a}", "\\begin{a}\\begin{b}\\end{a}", "\\begin{a}", ""]
    assert evaluate(spark, values, tex.nesting_error(F.col("c"))) == [None, "unexpected end a", "expected end b but found a", "unclosed a", None]


def test_identifiers(spark):
    values = ["2301.00001", "2301.00001\n", "hep-th/9901001", "2301.1/2345", "abcd/123456"]
    assert evaluate(spark, values, ids.is_paper_id(F.col("c"))) == [True, False, True, False, False]
    assert evaluate(spark, values, ids.is_paper_id_lenient(F.col("c"))) == [True, False, True, False, True]
    urls = ["https://arxiv.org/abs/2301.00001v2?x=1", "https://arxiv.org/pdf/2301.00001.pdf", "https://other.org/abs/1", "https://arxiv.org/abs/x/"]
    base = ids.SOURCE_BASE
    assert evaluate(spark, urls, ids.canonical_url(F.col("c"))) == [base + "2301.00001v2", base + "2301.00001", urls[2], base + "x"]
    paths = ["a/b.tex", "../x", "a/../../x", "/etc", "a/./b", "a/..", "\\x"]
    assert evaluate(spark, paths, ids.is_safe_path(F.col("c"))) == [True, False, False, False, True, True, False]


def test_text_examples(spark):
    assert evaluate(spark, ["汉字a", "", "ABC 1", "Abc"], text.han_count(F.col("c"))) == [2, 0, 0, 0]
    assert evaluate(spark, ["ABC 1", "Abc", "1", "É"], text.is_all_upper(F.col("c"))) == [True, False, False, True]
    assert evaluate(spark, ["a\n", "a\nb", "", "\n"], text.line_count(F.col("c"))) == [1, 2, 1, 1]
    assert evaluate(spark, ["abcdef", "ab", ""], text.common_prefix(F.col("c"), F.lit("abcxyz"))) == [3, 2, 0]
    assert evaluate(spark, ["\u3000 x \u00a0"], text.strip(F.col("c"))) == ["x"]
    assert evaluate(spark, ["1\n2\n3", "1\n2\nx", "1\n2"], blocks.is_line_numbers(F.col("c"))) == [True, False, False]


def test_translation_ratio_examples(spark):
    a, b = F.lit("x" * 100), F.col("c")
    assert evaluate(spark, ["x" * 29, "x" * 30, "  "], checks.translation_errors(a, b)) == [["too short"], [], ["empty"]]
    assert evaluate(spark, ["x" * 301, "x" * 300], checks.translation_warnings(a, b)) == [["too long"], []]


def test_batches_respect_the_window(spark):
    rng = random.Random(1)
    values = [(d, i, "x" * rng.choice([0, 5, 40, 90, 150])) for d in range(5) for i in range(40)]
    frame = spark.createDataFrame(values, "doc_id long, pos long, text string")
    found = {(r.doc_id, r.pos): r.batch for r in layout.pack_batches(frame, "doc_id", "pos", window=120).collect()}
    gap = len(layout.SEPARATOR)
    for d in range(5):
        batch, used, expected = 0, None, {}
        for _, i, t in sorted(v for v in values if v[0] == d):
            if i and (len(t) >= 120 or used is None or used + gap + len(t) > 120):
                batch, used = batch + 1, None
            used = None if len(t) >= 120 else len(t) if used is None else used + gap + len(t)
            expected[d, i] = batch
        assert {k: v for k, v in found.items() if k[0] == d} == expected


def test_suppression_matches_plain_version(spark):
    rng = random.Random(2)
    values = [(0, i, rng.randint(0, 60) / 2.0, rng.randint(0, 60) / 2.0, 20.0, 20.0, rng.randint(0, 15) / 16) for i in range(60)]
    frame = spark.createDataFrame(values, "doc_id long, element long, x double, y double, width double, height double, confidence double")
    kept = []
    for v in sorted(values, key=lambda v: (-v[6], v[1])):
        over = lambda a, b: max(0, min(a[2], b[2]) + 20 - max(a[2], b[2])) * max(0, min(a[3], b[3]) + 20 - max(a[3], b[3]))
        if all(over(v, k) / (800 - over(v, k)) < 0.5 for k in kept):
            kept.append(v)
    assert {r.element for r in layout.suppress(frame, ["doc_id"]).collect()} == {k[1] for k in kept}


def test_sections(spark):
    values = [(1, 1, i, t, 12.0, "paragraph") for i, t in enumerate(["Abstract", "1. Intro", "1.1 Back", "1. Intro", "plain words", "Appendix A: More", "A.1 Details", "References"])]
    frame = spark.createDataFrame(values, "doc_id long, page long, pos long, text string, font_size double, block_type string")
    found = sections.extract_sections(frame).orderBy("pos").collect()
    assert [(r.type, r.number, r.is_appendix) for r in found] == [
        ("abstract", "", False), ("section", "1", False), ("subsection", "1.1", False), ("appendix", "A", True), ("appendix_subsection", "A.1", True), ("references", "", True),
    ]
    other = spark.createDataFrame([(1, 2, 0, "摘要", 12.0, "paragraph"), (1, 1, 1, "1 引言", 9.0, "paragraph")], frame.schema)
    missing = sections.missing_sections(sections.extract_sections(frame), sections.extract_sections(other))
    assert {r.type for r in missing.collect()} == {"subsection", "appendix", "appendix_subsection", "references"}


def test_rule_operators_on_nulls_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, None), (2, ""), (2, "\\begin{a}{")], "doc_id long, text string")
    assert {r.doc_id for r in rules.validate(frame, "doc_id", "text").collect()} == {2}
    assert rules.restore(rules.protect(frame, "text")).count() == 3
    for made in (rules.chunk(frame.limit(0), "doc_id", "text"), rules.structures(frame.limit(0), "doc_id", "text"), rules.protect(frame.limit(0), "text")):
        assert made.count() == 0


def plain_open(text_):
    """Environments left open, by walking the list of open ones at every end."""
    left = []
    for m in spans.TAG.finditer(text_):
        if m.group(1) == "begin":
            left.append((m.group(2), m.start()))
        else:
            for i in reversed(range(len(left))):
                if left[i][0] == m.group(2):
                    del left[i]
                    break
    return left


def test_open_environments_and_braces_match_plain_walks():
    rng = random.Random(5)
    for _ in range(300):
        made = "".join(rng.choice(["\\begin{a}", "\\begin{b}", "\\end{a}", "\\end{b}", "\\end{c}", "{", "}", "x ", "\\author{", "\\author {n}", "\n"]) for _ in range(rng.randint(0, 30)))
        assert repairs._tag_stack(made) == plain_open(made)
        ends = spans.closings(made)
        assert all(ends.get(i, 0) == spans.balanced(made, i) for i, c in enumerate(made) if c == "{")
        assert plain_open(repairs.insert_missing_ends(made)) == []


def test_unmatched_tags_and_braces_take_linear_time():
    import time

    start = time.time()
    tags = "\\begin{a}\n" * 40_000 + "\\end{b}\n" * 40_000
    repairs.insert_missing_ends(tags), repairs.fix_nesting(tags), spans.authors("\\author{" * 100_000)
    assert time.time() - start < 20


def test_batches_are_worked_on_in_pieces_of_bounded_size():
    """Arrow's batches count rows; what is unpacked at once is bounded by bytes, and no row is lost or comes twice."""
    batch = pa.RecordBatch.from_pydict({"n": list(range(2000)), "text": ["x" * 10_000] * 2000})
    found = list(rules.pieces(batch))
    assert max(p.num_rows for p in found) * 10_000 <= rules.PIECE and [n for p in found for n in p.column(0).to_pylist()] == list(range(2000))
    assert [p.num_rows for p in rules.pieces(pa.RecordBatch.from_pydict({"n": [1, 2]}))] == [2] and not list(rules.pieces(batch.slice(0, 0)))
