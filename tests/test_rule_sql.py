"""Rules with a stack or a cursor against their SQL, which counts levels with windows, on hostile random texts."""

import collections
import hashlib
import random

import duckdb
import pytest

from inkspan.functions.rules import chunks, repairs, spans, validators
from inkspan.plans import catalog
from inkspan.plans.views import sql

PIECES = (
    "{ } [ ] ( ) \\{ \\} \\[ \\] \\( \\) $ $$ \\$ % \\% \\\\ \\\\% \\\\\\ & . ? ! 。 汉字 é ﻿ 锟斤拷 word Error ! x.tex \\item \\caption{c} \\label{l} \\centering \\hline \\maketitle \\footnotesize "
    "\\begin{table} \\end{table} \\begin{tabular} \\end{tabular} \\begin{itemize} \\end{itemize} \\begin{figure} \\end{figure} \\begin{foo} \\end{foo} \\begin{document} \\end{document} "
    "\\begn{a} \\documentclass{a} \\newcommand{\\x}{ \\renewcommand{\\y}{1} \\section{s} \\input{a} \\include{b} "
    "\\author{ \\author {A} \\cite[p]{k} \\cite汉{k} \\textbf{b} \\textbf \\multirow{2}{*}{x} \\multicolumn{2}{c}{y} \\cline{1-2} \\toprule[1pt] \\hline汉 \\begin{equation} \\end{equation} \\begin{align} \\end{align} \\\\[2pt] \\&"
).split()


def hostile(rng):
    parts = []
    for _ in range(rng.choice([0, 1, 5, 30, 120, 400])):
        parts += [rng.choice(PIECES), rng.choice(["", " ", " ", "\n", "\n", "\n\n", "  \n"])]
    if rng.random() < 0.1:
        parts += ["{" * rng.randint(95, 120), "x", "}" * rng.randint(90, 125)]
    return "".join(parts)


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def found(name, tex, pairs, logs):
    checks = {"syntax_validation": validators.syntax, "editor_validation": validators.editor, "project_validation": validators.project}
    if name in checks:
        return ["doc_id", "line", "column", "type", "message"], [(d, *r) for d, t in tex for r in checks[name](t)]
    if name == "log_excerpts":
        return ["doc_id", "n", "excerpt"], [(d, len(x), md5(x)) for d, t in logs for x in [repairs.log_excerpt(t, 500)]]
    if name == "chunk_break_points":
        return ["doc_id", "at"], [(d, chunks.break_point(t, 400)) for d, t in tex]
    if name == "environment_boundaries":
        return ["doc_id", "start", "stop"], [(d, *r) for d, t in tex for r in chunks.boundaries(t)]
    if name.startswith("protect_"):
        return ["doc_id", "placeholders", "text"], [(d, len(p), md5(x)) for d, t in tex for x, p in [spans.protect_kind(t, name[8:])]]
    if name == "command_extraction":
        return ["doc_id", "type", "name", "start", "stop"], [(d, s.kind, s.name, s.start, s.end) for d, t in tex for s in spans.commands(t)]
    if name == "structure_identification":
        return ["doc_id", "type", "name", "start", "stop", "is_nested", "parent_type"], [(d, *r) for d, t in tex for r in spans.structures(t)]
    if name == "plain_text_extraction":
        return ["doc_id", "plain"], [(d, spans.plain_text(t)) for d, t in tex]
    if name == "repair_workflow":
        rows = []
        for d, t in pairs:
            fixed = repairs.auto_fix(t)
            before, after = len(validators.CHECKS["editor"](t)), len(validators.CHECKS["editor"](fixed))
            decision = "unchanged" if fixed == t else "rejected" if after > before else "accepted"
            rows.append((d, before, after, decision, md5(t if after > before else fixed)))
        return ["doc_id", "issues_before", "issues_after", "decision", "kept"], rows
    rule = {
        "repair_simple": repairs.simple_fix, "repair_auto": repairs.auto_fix, "repair_missing_ends": repairs.insert_missing_ends, "repair_environments": repairs.restore_environments,
        "repair_final_lines": repairs.fix_line_structure, "repair_line_structure": repairs.restore_line_structure,
    }[name]
    if name == "repair_line_structure":
        whole = dict(tex)
        return ["doc_id", "fixed", "changed"], [(d, md5(x), x != t) for d, t in pairs for x in [rule(t, whole[d])]]
    return ["doc_id", "fixed", "changed"], [(d, md5(rule(t)), rule(t) != t) for d, t in pairs]


@pytest.fixture(scope="module")
def duck():
    rng = random.Random(11)
    rows = [(i, hostile(rng)) for i in range(400)] + [(400, ""), (401, None), (402, "}" * 50 + "{"), (403, "x" * 100_000), (404, "$"), (405, "$"), (406, "\\end{a}" * 200)]
    connection = duckdb.connect()
    connection.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    connection.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    return connection


@pytest.mark.parametrize(
    "name",
    "syntax_validation editor_validation project_validation log_excerpts chunk_break_points environment_boundaries repair_missing_ends repair_environments repair_final_lines repair_line_structure "
    "protect_math protect_tables protect_table_commands protect_cells protect_authors protect_commands command_extraction plain_text_extraction structure_identification "
    "repair_simple repair_auto repair_workflow".split(),
)
def test_rule_matches_its_sql(duck, name):
    tex = duck.execute(sql("SELECT doc_id, text FROM tex")).fetchall()
    pairs = duck.execute(sql("SELECT doc_id, translated FROM tex_pairs")).fetchall()
    logs = duck.execute(sql("SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) FROM log_lines GROUP BY doc_id")).fetchall()
    columns, rows = found(name, tex, pairs, logs)
    result = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(columns)
    wanted = collections.Counter(tuple(r[names.index(c)] for c in columns) for r in result.fetchall())
    assert collections.Counter(rows) == wanted and wanted


def test_line_rules_are_the_same_in_columns(spark):
    from pyspark.sql import functions as F

    from inkspan.functions import tex

    rng = random.Random(5)
    rows = [(i, hostile(rng), hostile(rng)) for i in range(150)]
    rows += [(900 + i, "x\n" * 9 + "\\begin{a}\\begin{b}\\begin{c}\\item a \\item b\\end{c}\\end{b}\\end{a}", "x\n" * 5 + "\\begin{a}\n\\begin{b}\n\\begin{c}\n\\item a\n\\item b\n\\end{c}\n\\end{b}\n\\end{a}") for i in range(2)]
    df = spark.createDataFrame(rows, "i int, t string, o string")
    found = df.select("i", tex.break_lines(F.col("t"), repairs.LINE_BREAKS).alias("a"), tex.restore_line_structure(F.col("t"), F.col("o"), repairs.SPACED, repairs.BREAKS, repairs.SINGLE).alias("b"))
    for r in found.collect():
        _, t, o = next(x for x in rows if x[0] == r.i)
        assert r.a == repairs.fix_line_structure(t) and r.b == repairs.restore_line_structure(t, o)
    assert repairs.restore_line_structure(rows[-1][1], rows[-1][2]).endswith("\\end{c}\n\\end{b}\n\\end{a}")


@pytest.mark.parametrize("limit", [60, 300, 1000])
def test_chunks_match_their_sql(duck, limit):
    from inkspan.plans.rules import chunks_sql

    rng = random.Random(limit)
    rows = [(i, hostile(rng) + rng.choice(["", "\n\\section{a} b\n\n\\begin{table} c\n\n d\n\\end{table}\n\\section*{n}\n\\subsection{e} f. g"]) * rng.randint(0, 9)) for i in range(120)]
    made = duck.cursor()
    made.execute("CREATE OR REPLACE TEMP TABLE tex AS SELECT * FROM (VALUES (0, '')) t(doc_id, text) LIMIT 0")
    made.execute("ALTER TABLE tex ALTER doc_id TYPE BIGINT")
    made.executemany("INSERT INTO tex VALUES (?, ?)", rows)
    wanted = collections.Counter((d, i, len(c.encode()), md5(c)) for d, t in rows for i, c in enumerate(chunks.split_chunks(t, limit)))
    assert collections.Counter(made.execute(chunks_sql(limit)).fetchall()) == wanted and len(wanted) > 150
