"""Braces and environments of a text read on one stack, by the command and argument that each brace belongs to."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

# Commands whose last argument is one table cell, font commands, and what ends a table's line.
CELL_COMMANDS = ("multirow", "multicolumn")
FONT_COMMANDS = ("textbf", "textit", "textsc", "texttt", "textrm", "textsf", "emph", "underline")
ROW_RULES = ("hline", "cline", "toprule", "midrule", "bottomrule", "cmidrule")
#: Arguments of a cell command; the last one holds the cell.
CELL_ARGUMENT = 3
#: The first character stands before the choice, so that a search passes over all others without trying it. A mark is that character.
TOKEN = re.compile(
    r"[%\\{}&\n](?:(?<=%)(?P<comment>[^\n]*)|(?<=\\)(?:(?P<row>\\)|(?P<tag>begin|end)\{(?P<name>[^{}\n]+)\}|(?P<command>[a-zA-Z]+)\*?|(?P<escaped>[\s\S]))"
    r"|(?P<mark>(?<=[{}&]))|(?<=\n)(?P<blank>[ \t]*(?=\n)))"
)
#: Between the arguments of a command stands white space or an optional argument.
BETWEEN = re.compile(r"\s*(?:\[[^\]]*\]\s*)*\Z")


def tokens(text: str):
    """(kind, value, start, end, owner) of tags, braces, cell and row ends, rules and blank lines; comments and escapes are passed over.

    ``owner`` of an opening brace is (command, number of the argument).
    """
    pending, behind, owners = None, 0, []
    for m in TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "comment":
            continue
        if pending and not BETWEEN.match(text, behind, m.start()):
            pending = None
        owner = ("", 0)
        if kind == "name":
            yield m["tag"], m["name"], m.start(), m.end(), owner
            pending = None
        elif kind == "command":
            if m["command"] in ROW_RULES:
                yield "rule", m["command"], m.start(), m.end(), owner
            pending = (m["command"], 0)
        elif kind == "mark" and m.group() == "{":
            if pending:
                owner = (pending[0], pending[1] + 1)
            owners.append(owner)
            yield "{", "", m.start(), m.end(), owner
            pending = None
        elif kind == "mark" and m.group() == "}":
            yield "}", "", m.start(), m.end(), owner
            pending = owners.pop() if owners else None
        elif kind == "mark":
            yield "&", "", m.start(), m.end(), owner
            pending = None
        elif kind in ("row", "blank"):
            yield kind, "", m.start(), m.end(), owner
            pending = None
        else:
            pending = None
        behind = m.end()


def _content_end(text: str, start: int, stop: int) -> int:
    """Behind the last character of text[start:stop] that is neither white space nor in a comment."""
    end = start
    for line in re.finditer(r"[^\n]+", text[start:stop]):
        live = re.match(r"(?:[^%\\]|\\[\s\S])*", line.group()).group().rstrip()
        if live:
            end = start + line.start() + len(live)
    return end


def _closes_on_line(text: str, at: int, depth: int) -> bool:
    """Whether ``depth`` open groups are closed on the rest of the line."""
    stop = text.find("\n", at)
    for m in TOKEN.finditer(text, at, stop if stop >= 0 else len(text)):
        if m.group() == "&" or m["row"]:
            return False
        if m.lastgroup == "mark":
            depth += 1 if m.group() == "{" else -1
            if depth == 0:
                return True
    return False


def close_arguments(text: str) -> str:
    """Closing braces for the arguments of cell, font and caption commands that are still open where they cannot go on.

    A cell ends at ``&``; at a row's end, unless the argument is closed further
    along that line; at a rule, a blank line and the end of its environment. A
    caption ends at a blank line and at the begin or end of an environment. The
    braces go behind the last character of the cell's content, before white
    space and comments. Braces of other commands are left alone.
    """
    stack: list[str] = []
    held: dict[str, list[int]] = {"cell": [], "font": [], "caption": [], "environment": []}  # places in the stack
    names: Counter = Counter()  # open environments
    pieces, written, last = [], 0, 0

    def cut(size: int) -> None:
        names.subtract(stack[size:])
        del stack[size:]
        for places in held.values():
            while places and places[-1] >= size:
                places.pop()

    def first(*kinds: str) -> int | None:
        """The outermost open group of these kinds inside the innermost environment."""
        low = held["environment"][-1] + 1 if held["environment"] else 0
        found = [held[k][i] for k in kinds if (i := bisect_left(held[k], low)) < len(held[k])]
        return min(found, default=None)

    def close(before: int, *kinds: str) -> None:
        nonlocal written
        place = first(*kinds)
        if place is not None:
            end = _content_end(text, max(written, last), before)
            pieces.append(text[written:end] + "}" * (len(stack) - place))
            written = end
            cut(place)

    for kind, value, start, end, owner in tokens(text):
        if kind == "&":
            close(start, "cell", "font")
        elif kind == "row" and (place := first("cell")) is not None and not _closes_on_line(text, end, len(stack) - place):
            close(start, "cell")
        elif kind in ("rule", "blank", "end"):
            close(start, "cell")
        if kind in ("blank", "begin", "end"):
            close(start, "caption")
        if kind == "{":
            command, argument = owner
            cell, font = command in CELL_COMMANDS and argument == CELL_ARGUMENT, command in FONT_COMMANDS
            group = "cell" if cell else "font" if font else "caption" if command == "caption" else None
            if group:
                held[group].append(len(stack))
            stack.append("{")
        elif kind == "}":
            if stack and stack[-1] == "{":
                cut(len(stack) - 1)
        elif kind == "begin":
            held["environment"].append(len(stack))
            stack.append("\\" + value)
            names["\\" + value] += 1
        elif kind == "end" and names["\\" + value]:
            cut(next(i for i in reversed(held["environment"]) if stack[i] == "\\" + value))
        last = end
    return "".join([*pieces, text[written:]])


def _partners(found: list[tuple]) -> dict[int, int]:
    """Closer of each opener, by token number: braces among braces, tags among the tags of their name."""
    open_at: dict[str, list[int]] = {}
    pairs = {}
    for i, (kind, value, *_) in enumerate(found):
        key = "{" if kind in "{}" else value
        if kind in ("{", "begin"):
            open_at.setdefault(key, []).append(i)
        elif kind in ("}", "end") and open_at.get(key):
            pairs[open_at[key].pop()] = i
    return pairs


def uncross(text: str) -> str:
    """Where a brace and an environment cross, the closer that comes too early moves behind the one it has to wait for.

    Of ``\\begin{x} { \\end{x} }`` the end, and of ``{ \\begin{x} } \\end{x}`` the
    brace goes to the end. Openers without a closer, and closers without an
    opener, are left where they are.
    """
    found = [t for t in tokens(text) if t[0] in ("{", "}", "begin", "end")]
    pairs = _partners(found)
    opener = {c: o for o, c in pairs.items()}
    stack, late, moved = [], set(), {}  # moved: token -> tokens that follow it
    gone = set()
    for i in range(len(found)):
        if i in pairs:
            stack.append(i)
        elif i in opener:
            if stack[-1] != opener[i]:
                late.add(opener[i])
                gone.add(i)
                continue
            stack.pop()
            while stack and stack[-1] in late:
                moved.setdefault(i, []).append(pairs[stack.pop()])
    if not gone:
        return text
    out, at, own_line = [], 0, set()
    for i, (_, _, start, end, _) in enumerate(found):
        if i in gone:
            out.append(text[at:start])
            at = end
            head, tail = text.rfind("\n", 0, start) + 1, re.compile(r"[ \t]*(?:\n|\Z)").match(text, end)
            if tail and not text[head:start].strip(" \t"):  # it had its own line
                out[-1] = out[-1].rstrip(" \t")
                at = tail.end()
                own_line.add(i)
        elif i in moved:
            out.append(text[at:end])
            at = end
            for j in moved[i]:
                out.append(("\n" if j in own_line else "") + text[found[j][2] : found[j][3]])
    return "".join([*out, text[at:]])


def drop_repeated_ends(text: str, names: tuple[str, ...] = ("document",)) -> str:
    """Ends of environments in ``names`` that close nothing, after one that did, with the line they stand on alone."""
    found = [t for t in tokens(text) if t[0] in ("begin", "end") and t[1] in names]
    closers, seen, out, at = set(_partners(found).values()), set(), [], 0
    for i, (kind, name, start, end, _) in enumerate(found):
        if kind == "end" and i not in closers and name in seen:
            head, tail = text.rfind("\n", 0, start) + 1, re.compile(r"[ \t]*(?:\n|\Z)").match(text, end)
            alone = tail and not text[head:start].strip(" \t")
            out.append(text[at : max(at, head) if alone else start])
            at = tail.end() if alone else end
        if kind == "end":
            seen.add(name)
    return "".join([*out, text[at:]])


def unopened(text: str) -> list[int]:
    """Places of closing braces that close nothing."""
    found, depth = [], 0
    for kind, _, start, _, _ in tokens(text):
        if kind == "{":
            depth += 1
        elif kind == "}" and depth:
            depth -= 1
        elif kind == "}":
            found.append(start)
    return found
