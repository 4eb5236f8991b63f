"""Arguments, crossing closers and aligned lines: given examples, and plain versions on random texts."""

import random
import re

import pytest

from inkspan.functions.rules import groups, repairs
from inkspan.functions.rules.alignment import align, line_key, rising
from inkspan.functions.rules.groups import close_arguments, drop_repeated_ends, uncross


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("\\multirow{3}{*}{\\textbf{Method} &", "\\multirow{3}{*}{\\textbf{Method}} &"),
        ("\\multicolumn{3}{|c}{\\textbf{GSM8K} &", "\\multicolumn{3}{|c}{\\textbf{GSM8K}} &"),
        ("\\multirow{3}{*}{\\textbf{Method &", "\\multirow{3}{*}{\\textbf{Method}} &"),
        ("\\multicolumn{2}{c}{\\textbf{Title &", "\\multicolumn{2}{c}{\\textbf{Title}} &"),
        ("\\textbf{\\textsc{Title} &", "\\textbf{\\textsc{Title}} &"),
        ("\\multicolumn{2}{l}{\\textit{Hardware}&", "\\multicolumn{2}{l}{\\textit{Hardware}}&"),
        ("\\multicolumn{2}{|c}{\\textbf{Overall} \\\\", "\\multicolumn{2}{|c}{\\textbf{Overall}} \\\\"),
        ("\\multicolumn{2}{c}{\\textbf{\\textsc{x}} \\\\", "\\multicolumn{2}{c}{\\textbf{\\textsc{x}}} \\\\"),
        ("\\multirow{2}{*}{\\textbf{A}\n\\midrule", "\\multirow{2}{*}{\\textbf{A}}\n\\midrule"),
        ("\\multirow [t] {2} {*} {a \\& b % no & here\n  & c", "\\multirow [t] {2} {*} {a \\& b} % no & here\n  & c"),
        ("\\caption{A \\emph{b}\n\\begin{tabular}{l}\nx\n\\end{tabular}", "\\caption{A \\emph{b}}\n\\begin{tabular}{l}\nx\n\\end{tabular}"),
        ("\\caption{A\n\nText", "\\caption{A}\n\nText"),
    ],
)
def test_open_arguments_are_closed(text, wanted):
    assert close_arguments(text) == wanted
    assert close_arguments(wanted) == wanted
    assert repairs.postprocess(text, wanted) == wanted == repairs.reference_fixes(text, wanted)


@pytest.mark.parametrize(
    "text",
    [
        "\\multirow{3}{*}{\\textbf{Method}} &", "\\multicolumn{2}{|c}{\\textbf{Overall}} \\\\", "\\multirow{2}{*}{a \\\\ b} & c", "", "a & b \\\\ {c & d",
        "\\multirow{2}{*}{\\begin{tabular}{c}a & b \\\\ c\\end{tabular}} & d", "\\textbf{line \\\\ next}", "\\scalebox{0.8}{\\begin{tabular}{l} a & b \\end{tabular}}", "\\multirow{2 & x",
    ],
)
def test_sound_arguments_stay(text):
    assert close_arguments(text) == text


def cells(rng):
    """A sound table row and the same with some braces of its cell commands lost at the cells' ends."""
    sound, damaged = [], []
    for _ in range(rng.randint(1, 6)):
        depth = rng.randint(0, 3)
        fonts = [rng.choice(groups.FONT_COMMANDS) for _ in range(depth)]
        head = rng.choice(["\\multirow{2}{*}{", "\\multicolumn{2}{c}{"]) + "".join(f"\\{f}{{" for f in fonts) + rng.choice(["x", "a \\% b", "\\{k", "\\alpha"])
        lost = rng.randint(0, depth + 1)
        sound.append(head + "}" * (depth + 1))
        damaged.append(head + "}" * (depth + 1 - lost))
    gaps = [rng.choice([" & ", "&", " &\n", " \\\\\n", "\n\\hline\n"]) for _ in sound]
    return "".join(map("".join, zip(sound, gaps))), "".join(map("".join, zip(damaged, gaps)))


@pytest.mark.parametrize("seed", range(40))
def test_lost_braces_of_cells_come_back(seed):
    sound, damaged = cells(random.Random(seed))
    assert close_arguments(sound) == sound and close_arguments(damaged) == sound


def test_reference_examples_of_crossing_tags():
    crossed = "\\begin{sidewaystable}\n\\scalebox{0.82}{\n\\end{sidewaystable}\n\\begin{tabular}{l}a\\end{tabular}\n}\nrest"
    sound = "\\begin{sidewaystable}\n\\scalebox{0.82}{\n\\begin{tabular}{l}a\\end{tabular}\n}\n\\end{sidewaystable}\nrest"
    assert uncross(crossed) == sound == uncross(sound) and repairs.reference_fixes(crossed, sound) == sound
    assert uncross("\\resizebox{1}{!}{\\begin{tabular}{l}x}\\end{tabular}") == "\\resizebox{1}{!}{\\begin{tabular}{l}x\\end{tabular}}"
    twice = "\\begin{document}\na\n\\end{document}\nb\n\\end{document}\n"
    assert drop_repeated_ends(twice) == "\\begin{document}\na\n\\end{document}\nb\n"
    assert "\\end{document}" in repairs.reference_fixes(twice, twice[:33]) and repairs.reference_fixes(twice, twice[:33]).count("\\end{document}") == 1


def marks(text):
    return [m.group() for m in re.finditer(r"\\(?:begin|end)\{\w+\}|[{}](?!\w*\})|[xyz]", text)]


def nested(rng, depth):
    """A properly nested text and its tokens; names differ along a path."""
    if depth == 0:
        return [rng.choice("xyz")]
    out = []
    for _ in range(rng.randint(1, 2)):
        inner = nested(rng, depth - 1)
        out += [rng.choice("xyz")] if rng.random() < 0.3 else [f"\\begin{{e{depth}}}", *inner, f"\\end{{e{depth}}}"] if rng.random() < 0.5 else ["{", *inner, "}"]
    return out


def properly_nested(text):
    stack = []
    for kind, value, *_ in groups.tokens(text):
        if kind in ("{", "begin"):
            stack.append(value)
        elif kind in ("}", "end") and (not stack or stack.pop() != value):
            return False
    return not stack


@pytest.mark.parametrize("seed", range(60))
def test_closers_out_of_order_are_put_in_order(seed):
    rng = random.Random(seed)
    parts = nested(rng, 4)
    assert uncross("".join(parts)) == "".join(parts) and properly_nested("".join(parts))
    closers = lambda i: i < len(parts) and (parts[i] == "}" or parts[i].startswith("\\end"))
    pairs = [i for i in range(len(parts)) if closers(i) and closers(i + 1) and parts[i] != parts[i + 1]]
    if not pairs:
        return
    swapped = parts[:]
    i = rng.choice(pairs)
    swapped[i], swapped[i + 1] = swapped[i + 1], swapped[i]
    mended = uncross("".join(swapped))
    assert properly_nested(mended) and sorted(mended) == sorted("".join(parts))
    # the only other way is another pairing of equal braces: without one, the old text comes back
    if parts[i] != "}" and parts[i + 1] != "}":
        assert mended == "".join(parts)


def test_commented_tags_go_in_pairs():
    original = "% \\begin{table}\nx\n% \\end{table}\n\\begin{figure}\n\\end{figure}"
    assert repairs.pair_commented_tags("% \\begin{table}\nx\n\\end{table}", original) == "% \\begin{table}\nx\n% \\end{table}"
    assert repairs.pair_commented_tags("% \\begin{figure}\nx\n\\end{figure}", original) == "\\begin{figure}\nx\n\\end{figure}"
    assert repairs.pair_commented_tags("\\begin{figure}\n% \\end{figure}", original) == "\\begin{figure}\n\\end{figure}"


def test_small_repairs_around_tables():
    assert repairs.drop_braces_after_tables("\\begin{table}\n\\end{table}\n}\nx") == "\\begin{table}\n\\end{table}\nx"
    assert repairs.drop_braces_after_tables("{\n\\begin{table}\n\\end{table}\n}\nx") == "{\n\\begin{table}\n\\end{table}\n}\nx"
    assert repairs.free_comment_braces("% note{\n\\setlength{\\a}{1pt}") == "% note\n\n{\n\\setlength{\\a}{1pt}"
    assert repairs.free_comment_braces("% note{\ntext") == "% note{\ntext"
    assert repairs.drop_styled_metadata("a\n<𝑐𝑜𝑛𝑐𝑒𝑝𝑡𝑖𝑑>10</𝑐𝑜𝑛𝑐𝑒𝑝𝑡𝑖𝑑>\n𝑥 is fine\n<conceptid>") == "a\n𝑥 is fine\n<conceptid>"
    assert repairs.rewrite("\\end{table}Text", repairs.TABLE_ENDS) == "\\end{table}\n\nText"


def longest(x, y):
    table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x)):
        for j in range(len(y)):
            table[i + 1][j + 1] = table[i][j] + 1 if x[i] == y[j] else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("seed", range(30))
def test_alignment_equals_the_longest_common_subsequence_of_unique_lines(seed):
    rng = random.Random(seed)
    x = [f"\\label{{{i}}}" for i in range(rng.randint(0, 60))]
    y = [f"\\ref{{{rng.random()}}}" if rng.random() < 0.2 else line for line in x if rng.random() < 0.8]
    if rng.random() < 0.5 and len(y) > 3:
        i = rng.randrange(len(y) - 1)
        y[i], y[i + 1] = y[i + 1], y[i]
    found = sorted(align(y, x).items())
    assert all(a < c and b < d for (a, b), (c, d) in zip(found, found[1:]))
    assert sum(y[i] == x[j] for i, j in found) == longest(y, x)


def test_rising_runs_are_longest():
    rng = random.Random(1)
    for _ in range(200):
        places = rng.sample(range(30), rng.randint(0, 12))
        run = [places[i] for i in rising(places)]
        assert run == sorted(run) and len(run) == longest(places, sorted(places))


def test_repeated_lines_without_unique_ones_and_short_texts():
    assert align([], ["a"]) == {} and align(["a"], []) == {}
    assert align(["a", "b", "a", "b"], ["x", "a", "b", "a", "b", "y"]) == {0: 1, 1: 2, 2: 3, 3: 4}
    assert align(["p q"], ["r s"]) == {0: 0}
    assert line_key("%  \\section{A} \\label{k}") == line_key("\\section{B} \\label{k}") != line_key("\\section{A} \\label{m}")


def test_an_inserted_line_does_not_switch_repairs_off():
    original = "\n".join(["\\documentclass{a}", "% \\bibliography{x}", "% note on it", "\\begin{document}", "\\textbf{a}", "text \\ref{b}", "\\end{document}"])
    text = original.replace("% note", "note").replace("% \\bib", "\\bib").replace("\\textbf{a}", "\\textbf{a")
    moved = "\\section{New}\n" * 5 + text
    assert repairs.restore_comments(moved, original) == "\\section{New}\n" * 5 + original.replace("\\textbf{a}", "\\textbf{a")
    assert repairs.restore_braces("\\section{New}\n" + original.replace("\\textbf{a}", "\\textbf{a"), original) == "\\section{New}\n" + original
    assert repairs.fix_by_lines(moved, original).count("% ") == 2


def test_quick_rules_on_definitions_boxes_and_lists():
    assert repairs.close_definitions("\\newenvironment{a}[1]%\n {\\begin{list}{}{}}\n {\\end{list}\n\\makeatother") == "\\newenvironment{a}[1]%\n {\\begin{list}{}{}}\n {\\end{list}}\n\\makeatother"
    assert repairs.close_definitions("{\\end{list}\nmore}") == "{\\end{list}\nmore}"
    for have in ("", "}", "}}", "}}}"):
        assert repairs.close_repeated_theorems("{\\end{rep@theorem}" + have + "\n\\makeatother") == "{\\end{rep@theorem}}}\n\\makeatother"
    box = "\\resizebox{\\textwidth}{!}{"
    assert repairs.merge_resizeboxes(f"a {box}{box}x {{y}}}}}} b") == f"a {box}x {{y}}}} b"
    assert repairs.merge_resizeboxes(f"{box}%\n{box} {box}x}}}}}}") == f"{box}x}}" and repairs.merge_resizeboxes(f"{box}x}} {box}y}}") == f"{box}x}} {box}y}}"
    orphan = "a\n\\begin{itemize}\n% \\item x\n\n% \\end{itemize}\nb"
    assert repairs.comment_orphaned_lists(orphan) == orphan.replace("\\begin", "% \\begin")
    sound = "\\begin{itemize}\n% note\n\\item x\n\\end{itemize}"
    assert repairs.comment_orphaned_lists(sound) == sound
    assert repairs.quick_fix(orphan).count("% \\begin{itemize}") == 1 and "\n\\end{itemize}" not in repairs.quick_fix(orphan)


def test_braces_behind_end_tags_take_linear_time():
    import time

    assert repairs.strip_end_braces("\\end{a}}} b") == "\\end{a} b"
    assert repairs.strip_end_braces("\\newcommand{\\x}{\\begin{a}\\end{a}} \\end{b}}") == "\\newcommand{\\x}{\\begin{a}\\end{a}} \\end{b}"
    start = time.time()
    repairs.strip_end_braces("\\end{x}} word" * 20_000)
    repairs.strip_end_braces("\\newcommand{\\end{x}} word" * 20_000)
    assert time.time() - start < 5
