"""Validation of one text: rows of (line, column, kind, message), 1-based; line 0 is the whole text."""

from __future__ import annotations

import re

from inkspan.functions.rules.spans import TAG

Row = tuple[int, int, str, str]


LIVE = re.compile(r"((?:[^%\\]++|\\.)*+)%", re.S)


def live(line: str) -> str:
    """A line up to its first unescaped percent sign."""
    m = LIVE.match(line) if "%" in line else None
    return m.group(1) if m else line


def line_column(text: str, at: int) -> tuple[int, int]:
    return text.count("\n", 0, at) + 1, at - text.rfind("\n", 0, at)


def pairs(text: str, opening: str, closing: str, kind: str) -> list[Row]:
    """Closing marks without an open one, then marks left open; escaped marks and comments do not count."""
    stack, found = [], []
    for number, line in enumerate(text.split("\n"), 1):
        for m in re.finditer(rf"(?<!\\)[{re.escape(opening + closing)}]", live(line)):
            if m.group() == opening:
                stack.append((number, m.start() + 1))
            elif stack:
                stack.pop()
            else:
                found.append((number, m.start() + 1, kind, f"unmatched closing {closing}"))
    return found + [(line, column, kind, f"unmatched opening {opening}") for line, column in stack]


def inline_math(text: str) -> list[Row]:
    start = None
    for number, line in enumerate(text.split("\n"), 1):
        for m in re.finditer(r"(?<!\\)\$\$?", live(line)):
            if len(m.group()) == 1:
                start = None if start else (number, m.start() + 1)
    return [(*start, "math", "unmatched $")] if start else []


def display_math(text: str) -> list[Row]:
    found = [m.start() for m in re.finditer(r"\$\$", text)]
    return [(*line_column(text, found[-1]), "math", "unmatched $$")] if len(found) % 2 else []


def counted_math(text: str, opening: str, closing: str) -> list[Row]:
    """Marks beyond the number of their counterparts."""
    a, b = ([m.start() for m in re.finditer(re.escape(x), text)] for x in (opening, closing))
    extra = [(x, f"unmatched {opening}") for x in a[len(b) :]] + [(x, f"unmatched {closing}") for x in b[len(a) :]]
    return [(*line_column(text, at), "math", message) for at, message in extra]


def environments(text: str) -> list[Row]:
    """Ends without a begin anywhere below on the stack, then begins left open; crossing is tolerated."""
    stack, found = [], []
    for m in TAG.finditer(text):
        place = line_column(text, m.start())
        if m.group(1) == "begin":
            stack.append((m.group(2), place))
            continue
        below = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == m.group(2)), None)
        if below is None:
            found.append((*place, "environment", f"end of {m.group(2)} without begin"))
        else:
            del stack[below]
    return found + [(*place, "environment", f"begin of {name} without end") for name, place in stack]


def strict_environments(text: str, skip_comments: bool = False) -> list[Row]:
    """Every end pops the stack, matching or not."""
    stack, found = [], []
    for number, line in enumerate(text.split("\n"), 1):
        if skip_comments and line.strip().startswith("%"):
            continue
        for m in TAG.finditer(line):
            name = m.group(2)
            if m.group(1) == "begin":
                stack.append(name)
            elif not stack:
                found.append((number, 0, "structure", f"end of {name} without begin"))
            elif (last := stack.pop()) != name:
                found.append((number, 0, "structure", f"begin of {last} ends as {name}"))
    return found + ([(0, 0, "structure", "unclosed: " + ", ".join(stack))] if stack else [])


def brace_depth(text: str, deep: int = 100) -> list[Row]:
    """Excess closing braces, suspicious depth, and braces left open; a closing excess starts again at depth 0."""
    depth, found = 0, []
    for number, line in enumerate(text.split("\n"), 1):
        for m in re.finditer(r"(?<!\\)[{}]", re.sub(r"(?<!\\)%.*", "", line)):
            depth += 1 if m.group() == "{" else -1
            if depth > deep:
                found.append((number, m.start() + 1, "warning", "deep nesting"))
            if depth < 0:
                found.append((number, m.start() + 1, "error", "extra closing brace"))
                depth = 0
    return found + ([(0, 0, "error", f"{depth} unclosed braces")] if depth else [])


def definitions(text: str, ahead: int = 10) -> list[Row]:
    """Command definitions whose braces do not balance within the next lines."""
    lines, found = text.split("\n"), []
    surplus = lambda x: x.count("{") - x.count("\\{") - x.count("}") + x.count("\\}")
    for i, line in enumerate(lines):
        if line.strip().startswith("%") or not re.search(r"\\(?:re)?newcommand", line) or surplus(line) <= 0:
            continue
        open_, closed = surplus(line), False
        for other in lines[i + 1 : i + 1 + ahead]:
            open_ += surplus(other)
            if not open_:
                closed = True
                break
        if not closed:
            found.append((i + 1, 1, "warning", "incomplete command definition"))
    return found


def common_errors(text: str) -> list[Row]:
    """Misspelt commands, odd dollars, triple backslashes, and what the document's ends lack."""
    from inkspan.functions.text import TYPOS

    found = []
    for number, line in enumerate(text.split("\n"), 1):
        line = line.split("%", 1)[0]
        found += [(number, line.index(w) + 1, "syntax", f"{w} for {r}") for w, r in TYPOS.items() if w in line]
        if line.count("$") % 2:
            found.append((number, 0, "warning", "odd number of $"))
        if line.strip().endswith("\\\\\\"):
            found.append((number, len(line), "warning", "triple backslash"))
    return found + document_ends(text)


def document_ends(text: str) -> list[Row]:
    end = "\\end{document}"
    found = [(0, 0, "structure", f"missing {m}") for m in ("\\begin{document}", end) if m not in text]
    after = text[text.find(end) + len(end) :] if end in text else ""
    if any(x.strip() and not x.strip().startswith("%") for x in after.split("\n")):
        found.append((0, 0, "structure", "content after the document"))
    return found


def document_structure(text: str) -> list[Row]:
    return ([] if "\\documentclass" in text else [(0, 0, "structure", "missing \\documentclass")]) + document_ends(text)


def plain_braces(text: str) -> list[Row]:
    """Closing braces beyond the open ones so far, and uneven totals; comments are cut at the first percent sign."""
    found, n = [], dict.fromkeys("{}[]()", 0)
    for number, line in enumerate(text.split("\n"), 1):
        for column, ch in enumerate(line.split("%", 1)[0], 1):
            if ch in n:
                n[ch] += 1
                if ch == "}" and n["}"] > n["{"]:
                    found.append((number, column, "syntax", "unexpected }"))
    for a, b, kind in (("{", "}", "syntax"), ("[", "]", "warning"), ("(", ")", "warning")):
        if n[a] != n[b]:
            found.append((0, 0, kind, f"{n[a]} {a} and {n[b]} {b}"))
    return found


def encoding(text: str) -> list[Row]:
    from inkspan.functions.text import GARBLED

    found = [(i, line.index(s) + 1, "encoding", "garbled text") for i, line in enumerate(text.split("\n"), 1) for s in [next((g for g in GARBLED if g in line), None)] if s]
    return found + ([(0, 0, "warning", "byte-order mark inside")] if "\ufeff" in text[1:] else [])


def syntax(text: str) -> list[Row]:
    """All syntax checks of a text."""
    return (
        pairs(text, "{", "}", "brace") + pairs(text, "[", "]", "bracket") + inline_math(text) + display_math(text)
        + counted_math(text, "\\(", "\\)") + counted_math(text, "\\[", "\\]") + environments(text)
    )


def editor(text: str) -> list[Row]:
    return plain_braces(text) + strict_environments(text) + common_errors(text) + encoding(text)


def project(text: str) -> list[Row]:
    return brace_depth(text) + document_structure(text) + definitions(text) + strict_environments(text, skip_comments=True)


CHECKS = {"syntax": syntax, "editor": editor, "project": project}
