"""Column functions over marked-up (TeX) text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkspan.functions.text import count, is_important_comment, strip

# Command and environment lists that decide the results.
SECTIONS = ["part", "chapter", "section", "subsection", "subsubsection", "paragraph", "subparagraph"]
COMMANDS = "cite citep citet ref eqref pageref label caption footnote includegraphics input include bibliography bibliographystyle title author date maketitle tableofcontents listoffigures listoftables".split()
CRITICAL_ENVIRONMENTS = "document figure table equation align theorem lemma proof abstract itemize enumerate description".split()
CRITICAL_COMMANDS = "cite citep citet ref eqref label caption includegraphics".split()
ADDED_PACKAGES = ["ctex", "xeCJK", "fontspec", "CJKutf8"]
CLASS_FAMILIES = [["article", "ctexart"], ["report", "ctexrep"], ["book", "ctexbook"]]
DEFINITIONS = "newcommand renewcommand def let DeclareMathOperator newlength setlength newcounter setcounter DeclareOption ProcessOptions RequirePackage ProvidesPackage ProvidesClass".split()
TABLE_MARKS = ["begin{tabular", "end{tabular", "begin{table", "end{table", "toprule", "midrule", "bottomrule", "hline", "cline", "multicolumn", "resizebox", "centering", "caption", "label"]
DRAWING = ["draw", "node", "path", "coordinate", "fill", "shade"]
UNICODE_LOADS = [
    "\\usepackage{fontspec}", "\\usepackage{xeCJK}", "\\usepackage{ctex}", "\\usepackage[ctex]",
    "\\RequirePackage{fontspec}", "\\RequirePackage{xeCJK}", "\\RequirePackage{ctex}",
]
ENV_TAG = r"\\(begin|end)\{([^}]+)\}"


def is_comment(line: Column) -> Column:
    """First character after blanks is a percent sign."""
    return line.rlike("^[ \t]*%")


def env_tags(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(ENV_TAG), F.lit(0))


def cut_comment(line: Column) -> Column:
    """Line up to its first percent sign that is not escaped."""
    masked = F.regexp_replace(line, r"(?s)\\.", "\ue000\ue000")
    at = F.locate("%", masked)
    return F.when(at > 0, F.substr(line, F.lit(1), at - 1)).otherwise(line)


def strip_inline_comment(line: Column) -> Column:
    """``cut_comment`` without the blanks before the comment; lines without one stay as they are."""
    cut = cut_comment(line)
    return F.when(cut == line, line).otherwise(F.regexp_replace(cut, r"[ \t]+\z", ""))


def strip_line_comment(line: Column, keep_important: bool = True) -> Column:
    """Comment lines become empty (important ones may stay), inline comments go."""
    whole = strip(line).startswith("%")
    kept = F.when(is_important_comment(line), line).otherwise("") if keep_important else F.lit("")
    return F.when(whole, kept).otherwise(strip_inline_comment(line))


def percent_position(line: Column) -> Column:
    """0-based position of the first percent sign that is not escaped, or -1."""
    cut = cut_comment(line)
    return F.when(F.length(cut) < F.length(line), F.length(cut)).otherwise(-1).cast("long")


def document_class(c: Column) -> Column:
    return F.regexp_extract(c, r"\\documentclass(?:\[[^\]]*\])?\{([^}]+)\}", 1)


def packages(c: Column) -> Column:
    """Sorted distinct packages."""
    lists = F.regexp_extract_all(c, F.lit(r"\\usepackage(?:\[[^\]]*\])?\{([^}]+)\}"), F.lit(1))
    names = F.flatten(F.transform(lists, lambda x: F.transform(F.split(x, ",", -1), strip)))
    return F.array_sort(F.array_distinct(F.filter(names, lambda n: n != "")))


def section_counts(c: Column) -> dict[str, Column]:
    """Counts of each section command, starred and with an optional argument too."""
    return {s: count_named(c, s, rf"\\{s}\*?(?:\[[^\]]*\])?\s*\{{") for s in SECTIONS}


def count_named(c: Column, name: str, pattern: str) -> Column:
    """Matches of a command's pattern; only texts that hold the command at all are searched."""
    return F.when(c.contains("\\" + name), count(c, pattern)).otherwise(F.lit(0).cast("long"))


def command_counts(c: Column) -> dict[str, Column]:
    return {x: count_named(c, x, rf"\\{x}\*?(?:\[[^\]]*\])?(?:\{{|\z|\s)") for x in COMMANDS}


def major_section_count(c: Column) -> Column:
    """Section and chapter commands without a star."""
    return count(c, r"\\(?:section|subsection|subsubsection|chapter)\s*[\[{]")


def compatible_class(a: Column, b: Column) -> Column:
    same = a == b
    for family in CLASS_FAMILIES:
        same = same | (a.isin(*family) & b.isin(*family))
    return same


def without_comment_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"(?m)^[ \t]*%.*$", "")


def brace_counts(c: Column) -> tuple[Column, Column]:
    """Open and closing braces outside full-line comments, not after a backslash."""
    t = without_comment_lines(c)
    return count(t, r"(?<!\\)\{"), count(t, r"(?<!\\)\}")


def brace_counts_inline(c: Column) -> tuple[Column, Column]:
    """Like ``brace_counts``, but inline comments are cut too."""
    t = F.array_join(F.transform(F.split(c, "\n", -1), cut_comment), "\n")
    return count(t, r"(?<!\\)\{"), count(t, r"(?<!\\)\}")


def brace_counts_plain(c: Column) -> tuple[Column, Column]:
    """Every brace before a line's first percent sign, escaped or not."""
    t = F.regexp_replace(c, r"(?m)%.*$", "")
    return count(t, r"\{"), count(t, r"\}")


def max_brace_depth(c: Column) -> Column:
    """Deepest nesting of braces; a closing brace without an open one does not count."""
    marks = F.regexp_extract_all(without_comment_lines(c), F.lit(r"(?<!\\)[{}]"), F.lit(0))
    start = F.struct(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("most"))

    def step(s: Column, mark: Column) -> Column:
        depth = F.when(mark == "{", s["depth"] + 1).otherwise(F.greatest(s["depth"] - 1, F.lit(0)))
        return F.struct(depth.cast("long").alias("depth"), F.greatest(s["most"], depth).cast("long").alias("most"))

    return F.aggregate(marks, start, step, lambda s: s["most"])


def nesting_error(c: Column) -> Column:
    """First environment tag that breaks the nesting, as text; null if the nesting holds.

    The stack is an array that tags push to and pop from; the first failure stays.
    """
    tags = env_tags(c)
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.lit(None).cast("string").alias("error"))

    def step(s: Column, tag: Column) -> Column:
        name = F.regexp_extract(tag, ENV_TAG, 2)
        top = F.element_at(s["stack"], -1)
        depth = F.size(s["stack"])
        opens = tag.startswith("\\begin")
        error = F.when(opens, F.lit(None)).when(depth == 0, F.concat(F.lit("unexpected end "), name)).when(
            top != name, F.concat(F.lit("expected end "), top, F.lit(" but found "), name)
        )
        stack = F.when(opens, F.array_append(s["stack"], name)).when(depth > 0, F.slice(s["stack"], F.lit(1), depth - 1)).otherwise(s["stack"])
        return F.when(s["error"].isNotNull(), s).otherwise(F.struct(stack.alias("stack"), error.cast("string").alias("error")))

    def finish(s: Column) -> Column:
        return F.coalesce(s["error"], F.when(F.size(s["stack"]) > 0, F.concat(F.lit("unclosed "), F.element_at(s["stack"], -1))))

    return F.aggregate(tags, start, step, finish)


def line_class(line: Column) -> Column:
    """``definition``, ``table``, ``markup``, ``prose`` or ``other`` by a line's content; null for blanks and comments."""
    return _class_of_stripped(strip(line))


def _class_of_stripped(t: Column) -> Column:
    defines = t.rlike(r"^\\(?:" + "|".join(DEFINITIONS) + ")")
    marked = F.lit(False)
    for mark in TABLE_MARKS:
        marked = marked | t.contains("\\" + mark)
    table = t.startswith("&") | t.endswith("\\\\") | (t.contains("\\") & marked)
    prose = count(t, "[a-zA-Z]{3,}") >= 3
    return (
        F.when((t == "") | t.startswith("%"), None)
        .when(defines, "definition")
        .when(table, "table")
        .when(t.rlike(r"^[\\{}&$]"), "markup")
        .when(prose, "prose")
        .otherwise("other")
    )


def _stripped_lines(c: Column) -> Column:
    return F.transform(F.split(c, "\n", -1), strip)


def needs_translation(c: Column) -> Column:
    """Three prose lines at least, and five where tables or definitions prevail.

    Each line is stripped and classed once: a column that is used several times inside a lambda is worked out each time.
    """
    has_table = c.contains("\\begin{table") | c.contains("\\begin{tabular")

    def decided(classes: Column) -> Column:
        prose, table, defs = (F.size(F.filter(classes, lambda k: k.eqNullSafe(name))) for name in ("prose", "table", "definition"))  # noqa: B023
        return F.struct(prose.alias("prose"), (table + defs).alias("rest"))

    def judged(n: Column) -> Column:
        ratio = F.coalesce(F.try_divide(n["rest"], n["rest"] + n["prose"]), F.lit(0.0))
        return ~(has_table & (n["prose"] < 5)) & ~((ratio > 0.8) & (n["prose"] < 5)) & (n["prose"] >= 3)

    classes = F.transform(_stripped_lines(c), _class_of_stripped)
    return F.get(F.transform(F.transform(F.array(classes), decided), judged), F.lit(0))


def is_mostly_code(c: Column) -> Column:
    """Over 0.8 of the lines that say something are commands, drawing or letterless."""
    drawing = r"\\(?:" + "|".join(DRAWING) + ")"
    says = lambda t: (t != "") & ~t.startswith("%")
    code = lambda t: t.startswith("\\") | t.rlike(drawing) | ~t.rlike("[a-zA-Z]")
    kinds = F.transform(_stripped_lines(c), lambda t: F.when(says(t), code(t)))
    share = lambda k: F.when(F.size(k) == 0, True).otherwise(F.try_divide(F.size(F.filter(k, lambda x: x)), F.size(k)) > 0.8)
    return F.get(F.transform(F.transform(F.array(kinds), F.array_compact), share), F.lit(0))


def has_translatable_text(c: Column) -> Column:
    """A letter is left once labels, references, citations and maths go and styles are unwrapped."""
    for pattern, by in (
        (r"\\label\{[^}]*\}", ""),
        (r"\\(?:ref|eqref|pageref|autoref|cref|Cref)\{[^}]*\}", ""),
        (r"\\cite\w*(\[[^\]]*\])*\{[^}]*\}", ""),
        (r"\$[^$]+\$", ""),
        (r"\\(?:textbf|textit|texttt|emph)\{([^}]*)\}", "$1"),
    ):
        c = F.regexp_replace(c, pattern, by)
    return c.rlike("[a-zA-Z]")


def labels(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"\\label\{([^}]*)\}"), F.lit(1)))


def includes(c: Column) -> Column:
    """Targets of input and include commands, with ``.tex`` added where it lacks."""
    found = F.regexp_extract_all(c, F.lit(r"\\(?:input|include)\s*\{([^}]+)\}"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.when(strip(x).endswith(".tex"), strip(x)).otherwise(F.concat(strip(x), F.lit(".tex")))))


def line_and_column(c: Column, at: Column) -> tuple[Column, Column]:
    """1-based line and column of a 0-based character position."""
    before = F.left(c, at)
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    return line.cast("long"), (F.length(F.substring_index(before, "\n", -1)) + 1).cast("long")


def separate_commands(c: Column) -> Column:
    """Environment tags and items on lines of their own."""
    for pattern in (
        r"([^\n\s])\s*(\\begin\{[^}]+\})",
        r"(\\begin\{[^}]+\}(?:\[[^\]]*\])?)\s*([^\n\s\[\\])",
        r"([^\n\s])\s*(\\end\{[^}]+\})",
        r"(\\end\{[^}]+\})\s*([^\n\s\\])",
        r"([^\n\s])\s*(\\item\b)",
        *[r"(\\item\s+[^\n]*[^\s])\s+(\\item\b)"] * 5,
    ):
        c = F.regexp_replace(c, pattern, "$1\n$2")
    return c


def split_merged_commands(c: Column) -> Column:
    """Structural commands that ran together get a newline, sections a blank line."""
    lists = "itemize|enumerate|description|quote|quotation|center|flushleft|flushright|figure|table|equation|align"
    for pattern, gap in (
        (r"(\\end\{[^}]+\})\s*(\\begin\{[^}]+\})", "\n"),
        (r"(\\end\{[^}]+\})\s*(\\(?:section|subsection|subsubsection|paragraph|chapter)\*?\{)", "\n\n"),
        (rf"(\}})\s*(\\begin\{{(?:{lists})\*?\}})", "\n"),
        (r"(\\item[^\n]*[^\s])\s*(\\begin\{[^}]+\})", "\n"),
        (r"(\\end\{[^}]+\})\s*(\\item\b)", "\n"),
    ):
        c = F.regexp_replace(c, pattern, f"$1{gap}$2")
    return c


def inline_bibliography(c: Column, bibliography: Column) -> Column:
    """Replace the bibliography command by the rendered bibliography, unless there is one or it stands before the body."""
    command = r"(?m)^([^%\n]*)\\bibliography\{[^}]+\}[^\n]*"
    body, at = F.locate("\\begin{document}", c), F.regexp_instr(c, F.lit(command))
    usable = (at > 0) & ~c.contains("\\begin{thebibliography}") & ~((body > 0) & (at < body))
    literal = F.replace(F.replace(bibliography, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    return F.when(usable, F.regexp_replace(c, F.lit(command), F.concat(F.lit("$1"), literal))).otherwise(c)


def needs_unicode_compiler(c: Column) -> Column:
    """A main file or class file loads one of the packages that only the Unicode compiler serves."""
    found = F.lit(False)
    for load in UNICODE_LOADS:
        found = found | c.contains(load)
    return found


def needs_bibliography(aux: Column) -> Column:
    return aux.contains("\\citation{") | aux.contains("\\bibdata{")


def _ascii(pattern: str) -> str:
    """A pattern of the line rules for the JVM: a word ends before anything but ASCII word characters."""
    return re.sub(r"\\(.)", lambda m: "(?![A-Za-z0-9_])" if m.group(1) == "b" else m.group(), pattern)


def break_lines(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Line rules (pattern of two groups, what goes between them) one after another."""
    for pattern, gap in rules:
        c = F.regexp_replace(c, _ascii(pattern), "$1" + gap + "$2")
    return c


def _split_lines(text: Column, original: Column, pattern: str) -> Column:
    lines = lambda c: F.split(c, "\n", -1)
    having = lambda c: F.size(F.filter(lines(c), lambda x: x.rlike(pattern)))

    def parted(line: Column) -> Column:
        head = F.regexp_extract(line, f"(?s)^(.*?{pattern})", 1)
        tail = F.regexp_replace(F.substr(line, F.length(head) + 1), f"[ \\t]*({pattern})", "\n$1")
        return F.when(line.rlike(pattern), F.concat(head, tail)).otherwise(line)

    return F.when(having(text) < having(original), F.array_join(F.transform(lines(text), parted), "\n")).otherwise(text)


def split_merged(text: Column, original: Column, patterns: tuple[str, ...]) -> Column:
    """Lines with several matches of a pattern are split, if fewer lines have one than in the original.

    Texts whose numbers of lines differ by more than a fifth and more than five are left alone.
    """
    count_lines = lambda c: F.size(F.split(c, "\n", -1))
    near = F.abs(count_lines(original) - count_lines(text)) <= F.greatest(F.lit(5), F.floor(count_lines(original) / 5))
    made = text
    for pattern in patterns:
        made = F.get(F.transform(F.array(made), lambda x: _split_lines(x, original, _ascii(pattern))), F.lit(0))  # noqa: B023
    return F.when(near, made).otherwise(text)


def restore_line_structure(text: Column, original: Column, spaced: list, breaks: list, single: tuple[str, ...]) -> Column:
    """Line breaks back around tags and items; merged ones are split where the original has them apart."""
    spread = lambda c: F.get(F.transform(F.array(break_lines(c, spaced)), lambda x: split_merged(x, original, single)), F.lit(0))
    return break_lines(spread(text), breaks)
