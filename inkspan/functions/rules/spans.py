"""Typed spans of marked-up text, and placeholders that stand for them."""

from __future__ import annotations

import re
from typing import NamedTuple

# Environments and commands by what they protect.
MATH = "equation equation* align align* alignat alignat* gather gather* multline multline* flalign flalign* eqnarray eqnarray* math displaymath split subequations cases matrix pmatrix bmatrix vmatrix Vmatrix Bmatrix smallmatrix".split()
TABLES = "table table* tabular tabular* tabularx tabulary longtable longtable* supertabular array".split()
TABLE_COMMANDS = (
    r"\\multirow\s*(?:\[[^\]]*\])?\s*\{[^}]*\}\s*(?:\[[^\]]*\])?\s*\{[^}]*\}\s*(?:\[[^\]]*\])?\s*\{[^}]*\}", r"\\multicolumn\s*\{[^}]*\}\s*\{[^}]*\}\s*\{[^}]*\}",
    r"\\cline\s*\{[^}]*\}", r"\\hline\b", r"\\(?:toprule|midrule|bottomrule)(?:\s*\[[^\]]*\])?",
)
COMMANDS = (
    r"\\(?:section|subsection|subsubsection|chapter|part|paragraph)\*?(?=[\[{])", r"\\(?:cite\w*|ref|eqref|pageref|autoref|cref|Cref|label)(?:\[[^\]]*\])*\{[^}]*\}",
    r"\\(?:textbf|textit|texttt|emph|underline|textsc)(?=\{)", r"\\(?:documentclass|usepackage|input|include|bibliography|bibliographystyle|includegraphics)(?:\[[^\]]*\])?\{[^}]*\}",
    r"\\(?:begin|end)\{[^}]*\}(?:\[[^\]]*\])?", r"\\[a-zA-Z]+\*?",
)
TAG = re.compile(r"\\(begin|end)\{([^}]+)\}")


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    name: str


def tags(text: str) -> list[tuple[str, int, int]]:
    """Environment tags with their position from 0 and line from 1."""
    found, at, line = [], 0, 1
    for m in TAG.finditer(text):
        line += text.count("\n", at, m.start())
        at = m.start()
        found.append((m.group(), at, line))
    return found


def environments(text: str, names: set[str] | None = None, kind: str = "environment") -> list[Span]:
    """Balanced environments, outermost of each name first met; one pass over the tags with a stack per name."""
    open_at: dict[str, list[int]] = {}
    found = []
    for m in TAG.finditer(text):
        name = m.group(2)
        if names is not None and name not in names:
            continue
        if m.group(1) == "begin":
            open_at.setdefault(name, []).append(m.start())
        elif open_at.get(name):
            found.append(Span(open_at[name].pop(), m.end(), kind, name))
    return sorted(found)


def matches(text: str, pattern: str, kind: str, name: str = "") -> list[Span]:
    return [Span(m.start(), m.end(), kind, name or m.group()) for m in re.finditer(pattern, text, re.A) if m.end() > m.start()]


def inline_math(text: str) -> list[Span]:
    """Spans between single unescaped dollar signs; doubled ones are skipped, empty ones are none."""
    found, start = [], None
    for m in re.finditer(r"\\.|\$\$|\$", text, re.S):
        if m.group() == "$":
            if start is None:
                start = m.start()
            else:
                if m.end() - start > 2:
                    found.append(Span(start, m.end(), "inline", "$"))
                start = None
    return found


def math(text: str) -> list[Span]:
    display = matches(text, r"(?s)\$\$.*?\$\$", "display", "$$") + matches(text, r"(?s)\\\[.*?\\\]", "display", "\\[\\]")
    return environments(text, set(MATH), "environment") + display + matches(text, r"(?s)\\\(.*?\\\)", "inline", "\\(\\)") + inline_math(text)


def comments(text: str) -> list[Span]:
    """From the first unescaped percent sign of a line to its end."""
    found = []
    for line in re.finditer(r"[^\n]+", text):
        m = re.match(r"((?:[^%\\]|\\.)*)%", line.group(), re.S)
        if m:
            whole = not m.group(1).strip()
            found.append(Span(line.start() + m.end() - 1, line.end(), "comment", "comment" if whole else "inline_comment"))
    return found


def authors(text: str) -> list[Span]:
    starts = list(re.finditer(r"\\author\s*\{", text))
    ends = closings(text) if starts else {}
    return [Span(m.start(), ends[m.end() - 1], "author", "author") for m in starts if m.end() - 1 in ends]


def closings(text: str) -> dict[int, int]:
    """For every opening brace that is closed, the position after the brace that closes it, in one pass."""
    found, opened = {}, []
    for m in re.finditer("[{}]", text):
        if m.group() == "{":
            opened.append(m.start())
        elif opened:
            found[opened.pop()] = m.end()
    return found


def balanced(text: str, start: int) -> int:
    """Position after the brace that closes the one at ``start``; 0 if none does."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, start):
        depth += 1 if m.group() == "{" else -1
        if not depth:
            return m.end()
    return 0


def disjoint(spans: list[Span]) -> list[Span]:
    """Greedy: by start, longer first; a span that begins inside a kept one goes."""
    kept: list[Span] = []
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if not kept or s.start >= kept[-1].end:
            kept.append(s)
    return kept


def protect(text: str, spans: list[Span], kind: str) -> tuple[str, dict[str, str]]:
    """Text with each span replaced by a numbered placeholder, and what each stands for."""
    parts, table, at = [], {}, 0
    for i, s in enumerate(disjoint(spans)):
        key = f"<<<LATEX_{kind}_{i}>>>"
        table[key] = text[s.start : s.end]
        parts += [text[at : s.start], key]
        at = s.end
    return "".join([*parts, text[at:]]), table


def restore(text: str, table: dict[str, str]) -> str:
    """Placeholders back to what they stand for, until none is left."""
    known = re.compile(r"<<<LATEX_[A-Z]+_\d+>>>")
    for _ in range(1 + len(table)):
        new = known.sub(lambda m: table.get(m.group(), m.group()), text)
        if new == text:
            break
        text = new
    return text


def cells(text: str) -> list[Span]:
    ends = matches(text, r"(?<!\\)\\\\(?:\s*\[[^\]]*\])?", "separator", "\\\\")
    taken = [Span(m.start(1), m.end(1), "separator", "&") for m in re.finditer(r"(?<!\\)(?:\\\\)*(&)", text)]
    return ends + taken


PROTECTED = {
    "math": ("MATH", math),
    "tables": ("TABLE", lambda t: environments(t, set(TABLES), "table")),
    "table_commands": ("TBLCMD", lambda t: [s for p in TABLE_COMMANDS for s in matches(t, p, "command")]),
    "cells": ("SEP", cells),
    "authors": ("AUTHOR", authors),
    "commands": ("CMD", lambda t: [s for p in COMMANDS for s in matches(t, p, "command")]),
}


def protect_kind(text: str, kind: str) -> tuple[str, dict[str, str]]:
    label, find = PROTECTED[kind]
    return protect(text, find(text), label)


def protect_all(text: str) -> tuple[str, dict[str, str]]:
    """Authors, then tables, then maths, then commands; later placeholders may stand inside earlier text only."""
    table: dict[str, str] = {}
    for kind in ("authors", "tables", "math", "commands"):
        text, own = protect_kind(text, kind)
        table |= own
    return text, table


def commands(text: str) -> list[Span]:
    """Environments that are protected, maths and commands, without overlaps."""
    return disjoint(environments(text, set(TABLES + ["figure", "figure*", "verbatim", "lstlisting", "tikzpicture"])) + math(text) + [s for p in COMMANDS for s in matches(text, p, "command")])


def plain_text(text: str) -> str:
    """What is left between commands and maths."""
    parts, at = [], 0
    for s in commands(text):
        parts.append(text[at : s.start])
        at = s.end
    return "".join([*parts, text[at:]])


def structures(text: str) -> list[tuple[str, str, int, int, bool, str]]:
    """(type, name, start, end, is_nested, parent type) by start; the parent is the first that begins before it and ends after it."""
    tables, maths = set(TABLES), set(MATH)
    found = comments(text) + [s for s in math(text) if s.kind != "environment"]
    for s in environments(text):
        kind = "table" if s.name in tables else "display" if s.name in maths else "environment"
        found.append(s._replace(kind=kind))
    found += matches(text, r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?(?:\{[^{}]*\})?", "command")
    found.sort(key=lambda s: (s.start, -s.end))
    out, holders = [], []
    for s in found:
        holders = [h for h in holders if h.end > s.start]
        parent = next((h for h in holders if h.start < s.start and h.end > s.end), None)
        out.append((s.kind, s.name, s.start, s.end, parent is not None, parent.kind if parent else ""))
        holders.append(s)
    return out


def title(text: str) -> str:
    """Title command's content without commands, 200 characters at most."""
    at = re.search(r"\\title(?:\{| \[)", text)
    brace = text.find("{", at.start()) if at else -1
    end = balanced(text, brace) if brace >= 0 else 0
    if not end:
        return ""
    found = re.sub(r"\\[a-zA-Z]*", "", text[brace + 1 : end - 1].replace("\n", " ").replace("\r", "").strip()).strip()
    return found[:200] + "..." if len(found) > 200 else found
