"""Queries of the repairs that read a text as groups, arguments or aligned lines, and of the repair with acceptance."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from inkspan.functions.rules import groups, repairs
from inkspan.operators import rules
from inkspan.plans.catalog import query
from inkspan.plans.rules import EDITOR, SPANS, _levels, _marks, _replaced


def _mended(rows, rule, *columns):
    made = rules.with_text(rows.select("doc_id", *columns), "fixed", rule, *columns)
    return made.select("doc_id", F.md5("fixed").alias("fixed"), (F.col("fixed") != F.col("translated")).alias("changed"))


@query("SELECT doc_id, md5(original) AS fixed, damaged AS changed FROM cell_tables")
def repair_cells(t):
    return _mended(t.cell_tables, groups.close_arguments, "translated")


@query("SELECT doc_id, md5(original) AS fixed, damaged AS changed FROM crossed_groups")
def repair_crossed(t):
    return _mended(t.crossed_groups, lambda x: groups.drop_repeated_ends(groups.uncross(x)), "translated")


@query("SELECT doc_id, md5(wanted) AS fixed, damaged AS changed FROM shifted_pairs")
def repair_aligned(t):
    return _mended(t.shifted_pairs, repairs.restore_comments, "translated", "original")


# The simple repair in SQL: misspelt commands, the end of the document, then braces by levels: lacking ones at the end, excess ones out.
def _typos(text: str) -> str:
    from inkspan.functions.text import TYPOS

    for wrong, right in TYPOS.items():
        text = f"replace({text}, '{wrong}', '{right}')"
    return text


SIMPLE = rf"""spelt AS (SELECT doc_id, translated AS before, {_typos("BARE")} AS text FROM tex_pairs),
ended AS (SELECT doc_id, before, CASE WHEN contains(text, '\end{{document}}') THEN substr(text, 1, strpos(text, '\end{{document}}') + 13) || chr(10) ELSE text END AS text FROM spelt),
pieces AS (SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM ended)),
cut AS (SELECT doc_id, line_no, line, regexp_replace(line, '(^|[^\\])%.*$', '\1') AS live FROM pieces),
{_marks("cut", "{}", "marks")},
marks_d AS (SELECT *, CASE ch WHEN '{{' THEN 1 ELSE -1 END AS d FROM marks), {_levels("marks_d", "braces", "doc_id", "line, col")},
lacking AS (SELECT doc_id, CAST(sum(d) AS BIGINT) AS n FROM marks_d GROUP BY doc_id),
stray AS (SELECT doc_id, line, list(col) AS cols FROM braces WHERE stray GROUP BY doc_id, line),
bare AS (SELECT doc_id, string_agg(CASE WHEN cols IS NULL THEN line_text ELSE array_to_string(list_transform(range(1, length(line_text) + 1), lambda i: CASE WHEN list_contains(cols, i) THEN '' ELSE substr(line_text, i, 1) END), '') END, chr(10) ORDER BY line_no) AS text
  FROM (SELECT p.doc_id, p.line_no, p.line AS line_text, s.cols FROM pieces p LEFT JOIN stray s ON s.doc_id = p.doc_id AND s.line = p.line_no + 1) GROUP BY doc_id),
mended AS (SELECT e.doc_id, e.before, CASE WHEN coalesce(n, 0) <= 0 THEN b.text
  WHEN contains(e.text, '\end{{document}}') THEN substr(e.text, 1, strpos(e.text, '\end{{document}}') - 1) || repeat('}}', n) || chr(10) || '\end{{document}}' || chr(10)
  ELSE e.text || repeat('}}', n) END AS after FROM ended e JOIN bare b USING (doc_id) LEFT JOIN lacking USING (doc_id))"""


UNMARKED = SIMPLE.replace("BARE", "CASE WHEN starts_with(translated, chr(65279)) THEN substr(translated, 2) ELSE translated END")
SIMPLE = SIMPLE.replace("BARE", "translated")
FIXED = "SELECT doc_id, md5(after) AS fixed, after <> before AS changed FROM mended"


def _editor_of(lines: str, texts: str) -> str:
    body = re.sub(r"\btex_lines\b", lines, EDITOR)
    body = re.sub(r"\btex\b", texts, body)
    head, tail = body.removeprefix("WITH ").split("\nSELECT", 1)
    return head.replace("\nmarks", "\neditor_marks") + f",\nissues AS (SELECT{tail})"


WORKFLOW = rf"""WITH {UNMARKED},
both_tex AS (SELECT doc_id * 2 AS doc_id, before AS text FROM mended UNION ALL SELECT doc_id * 2 + 1, after FROM mended),
both_lines AS (SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM both_tex)),
{_editor_of("both_lines", "both_tex").replace("cut AS (", "tag_cut AS (").replace("FROM cut)", "FROM tag_cut)")},
counted AS (SELECT doc_id, count(*) AS n FROM issues GROUP BY doc_id)
SELECT m.doc_id, coalesce(b.n, 0) AS issues_before, coalesce(a.n, 0) AS issues_after,
  CASE WHEN before = after THEN 'unchanged' WHEN coalesce(a.n, 0) > coalesce(b.n, 0) THEN 'rejected' ELSE 'accepted' END AS decision,
  md5(CASE WHEN coalesce(a.n, 0) > coalesce(b.n, 0) THEN before ELSE after END) AS kept
FROM mended m LEFT JOIN counted b ON b.doc_id = m.doc_id * 2 LEFT JOIN counted a ON a.doc_id = m.doc_id * 2 + 1"""


@query(WORKFLOW)
def repair_workflow(t):
    found = rules.repair_workflow(t.tex_pairs, "translated")
    return found.select("doc_id", "issues_before", "issues_after", "decision", F.md5("kept").alias("kept"))


@query(f"WITH {UNMARKED} {FIXED}")
def repair_auto(t):
    return _mended(t.tex_pairs, repairs.auto_fix, "translated")


@query(f"WITH {SIMPLE} {FIXED}")
def repair_simple(t):
    return _mended(t.tex_pairs, repairs.simple_fix, "translated")


MISSING = "<<<LATEX_CMD_[0-9]*[147]>>>"


@query(_replaced(SPANS["commands"], "'<<<LATEX_CMD_' || n || '>>>'", f"md5(text) AS text, len(regexp_extract_all(text, '{MISSING}')) AS recovered"))
def placeholder_order(t):
    """Placeholders whose number ends in 1, 4 or 7 are lost and put back at their places."""
    made = rules.protect(t.tex, "text", "commands").select("doc_id", "protected.*").toDF("doc_id", "whole", "placeholders")
    lossy = made.withColumn("text", F.regexp_replace("whole", MISSING, ""))
    found = rules.recover_in_order(lossy, "text", "whole", "placeholders")
    return found.select("doc_id", F.md5("recovered.text").alias("text"), F.size("recovered.attempts").alias("recovered"))


# Repairs whose sound result is known from how the text was made: every line of a document becomes a piece of mark-up, a function of
# k = doc_id + line_no and of the line's words, and SQL writes what the repair has to make of it.
def _pieces(name: str, rule, made, wanted: str, changed: str, around: tuple[str, str] = ("", ""), original=None):
    """Register ``name``: ``made(k, w)`` repaired by ``rule``, against ``wanted`` (SQL over k and w); ``original`` gives a reference text."""
    head, tail = around
    quoted = lambda s: " || chr(10) || ".join("'" + p + "'" for p in s.split("\n"))

    def build(t):
        sides = lambda k, w: (original(k, w) if original else made(k, w), made(k, w))
        pairs = t.damaged(lambda d: [F.lit(head)] * 2, sides, lambda d: [F.lit(tail)] * 2)
        return _mended(pairs, rule, *(("translated", "original") if original else ("translated",)))

    build.__name__ = name
    whole = f"md5({quoted(head)} || string_agg({wanted}, chr(10) ORDER BY line_no) || {quoted(tail)})"
    query(f"WITH pieces AS (SELECT doc_id, line_no, doc_id + line_no AS k, w FROM plain_lines) SELECT doc_id, {whole} AS fixed, bool_or({changed}) AS changed FROM pieces GROUP BY doc_id")(build)


def _text(*parts):
    """Strings and columns one behind the other."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


_number = lambda c: c.cast("string")
_sound_brace = lambda k, w: _text("\\textbf{", w, "}")
_pieces(
    "repair_line_braces", repairs.restore_braces, lambda k, w: F.when(k % 3 == 0, _text("\\textbf{", w)).otherwise(_sound_brace(k, w)),
    r"'\textbf{' || w || '}'", "k % 3 = 0", original=_sound_brace,
)


def _reference_line(k, w):
    return F.when(k % 3 == 0, _text("% note ", w)).when(k % 3 == 1, _text("\\caption{\\emph{", w, "}}")).otherwise(_text("\\label{", _number(k), "} ", w))


_pieces(
    "repair_line_signs", repairs.fix_by_lines,
    lambda k, w: F.when(k % 3 == 0, _text("note ", w)).when(k % 3 == 1, _text("\\caption{\\emph{", w, "}}}")).otherwise(_reference_line(k, w)),
    r"CASE k % 3 WHEN 0 THEN '% note ' || w WHEN 1 THEN '\caption{\emph{' || w || '}}' ELSE '\label{' || k || '} ' || w END", "k % 3 < 2", original=_reference_line,
)
_include = lambda k, w: _text("\\input{part", _number(k), "}")
_pieces(
    "repair_lost_inputs", lambda text, original: repairs.restore_inputs(re.sub("\n+", "\n", text), original), lambda k, w: F.when(k % 3 == 0, "").otherwise(_include(k, w)),
    r"'\input{part' || k || '}'", "k % 3 = 0", ("\\begin{document}\n", "\n\\end{document}"), original=_include,
)
_pieces(
    "repair_resized_tables", repairs.close_resizebox,
    lambda k, w: _text("\\begin{table}\n\\resizebox{\\columnwidth}{!}{\n\\begin{tabular}{l}", w, "\\end{tabular}", F.when(k % 2 == 0, "").otherwise("}"), "\n\\end{table}"),
    r"'\begin{table}' || chr(10) || '\resizebox{\columnwidth}{!}{' || chr(10) || '\begin{tabular}{l}' || w || '\end{tabular}}' || chr(10) || '\end{table}'", "k % 2 = 0",
)
_grid = lambda k: F.repeat(F.lit("c"), (4 + k % 12).cast("int"))
_pieces(
    "repair_many_columns", repairs.widen_tables, lambda k, w: _text("\\begin{table}[!t]\n\\begin{tabular}{", _grid(k), "}\n", w, "\n\\end{tabular}\n\\end{table}"),
    r"'\begin{table' || CASE WHEN k % 12 >= 10 THEN '*' ELSE '' END || '}[!t]' || chr(10) || '\begin{tabular}{' || repeat('c', 4 + k % 12) || '}' || chr(10) || w || chr(10) || '\end{tabular}' || chr(10) || '\end{table' || CASE WHEN k % 12 >= 10 THEN '*' ELSE '' END || '}'",
    "k % 12 >= 10",
)
_pieces(
    "repair_figure_frames", repairs.fix_figure_layout,
    lambda k, w: F.when(k % 2 == 0, _text("\\begin{figure}[h]\n\\includegraphics[width=1.2\\columnwidth]{", w, "}\n\\end{figure*}")).otherwise(_text("\\begin{figure*}[!t]\n\\includegraphics[width=0.5\\textwidth]{", w, "}\n\\end{figure}")),
    r"CASE WHEN k % 2 = 0 THEN '\begin{figure}[!htbp]' || chr(10) || '\includegraphics[width=0.9\columnwidth]{' || w || '}' || chr(10) || '\end{figure}' ELSE '\begin{figure*}[!htbp]' || chr(10) || '\includegraphics[width=0.85\textwidth]{' || w || '}' || chr(10) || '\end{figure*}' END",
    "true",
)
_star = lambda k: F.when(k % 5 == 0, "*").otherwise("")
_pieces(
    "repair_table_frames", repairs.fix_table_layout,
    lambda k, w: _text("\\begin{table", _star(k), "}[t]\n\\centering\n\\begin{tabular}{", _grid(k), "}\n", w, "\n\\end{tabular}\n\\end{table", _star(k), "}"),
    r"""'\begin{table' || CASE WHEN k % 5 = 0 THEN '*' ELSE '' END || '}[!htbp]' || chr(10) || '\setlength{\tabcolsep}{1.5pt}' || chr(10) || '\centering' || chr(10)
  || CASE WHEN k % 5 = 0 THEN CASE WHEN k % 12 >= 10 THEN '\scalebox{0.65}{%' || chr(10) WHEN k % 12 >= 8 THEN '\scalebox{0.7}{%' || chr(10) WHEN k % 12 >= 4 THEN '\resizebox{\textwidth}{!}{%' || chr(10) ELSE '' END
     ELSE CASE WHEN k % 12 >= 6 THEN '\scalebox{0.7}{%' || chr(10) WHEN k % 12 >= 4 THEN '\scalebox{0.75}{%' || chr(10) WHEN k % 12 >= 2 THEN '\resizebox{\columnwidth}{!}{%' || chr(10) ELSE '' END END
  || '\begin{tabular}{' || repeat('c', 4 + k % 12) || '}' || chr(10) || w || chr(10) || '\end{tabular}'
  || CASE WHEN k % 12 >= CASE WHEN k % 5 = 0 THEN 4 ELSE 2 END THEN chr(10) || '}% end scaling' ELSE '' END || chr(10) || '\end{table' || CASE WHEN k % 5 = 0 THEN '*' ELSE '' END || '}'""",
    "true",
)
_pieces(
    "repair_skipped_ends", repairs.fix_nesting, lambda k, w: _text("\\begin{center}\\begin{small}", w, F.when(k % 3 == 0, "").otherwise("\\end{small}"), "\\end{center}"),
    r"'\begin{center}\begin{small}' || w || CASE WHEN k % 3 = 0 THEN chr(10) || '\end{small}' || chr(10) ELSE '\end{small}' END || '\end{center}'", "k % 3 = 0",
)
