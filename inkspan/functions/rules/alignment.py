"""Lines, or words, of a text matched to those of its original, by what both keep: commands, keys, numbers and untouched wording."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

COMMAND = re.compile(r"\\([a-zA-Z]+)\*?(?:\[[^\]]*\])?(?:\{[^{}]*\})?")
#: Commands whose argument is a key or a name and survives a translation; of the others only the name does.
KEYED = ("begin", "end", "label", "ref", "eqref", "cite", "input", "include", "includegraphics", "usepackage", "documentclass", "bibliography", "bibliographystyle")
#: Entries of the table up to which a stretch without unique lines is compared in full.
FULL = 1 << 16


def line_key(line: str) -> str:
    """What is compared of a line, without its comment sign: its commands with their keys, or the wording if it has none."""
    bare = line.strip().removeprefix("%").strip()
    found = []
    for m in COMMAND.finditer(bare):
        found.append(m.group() if m[1] in KEYED else "\\" + m[1])
    return "\n".join(found) if found else bare


def rising(places: list[int]) -> list[int]:
    """Indexes of a longest strictly rising run of ``places``."""
    ends, at, before = [], [], []
    for i, p in enumerate(places):
        k = bisect_left(ends, p)
        if k == len(ends):
            ends.append(p)
            at.append(i)
        else:
            ends[k], at[k] = p, i
        before.append(at[k - 1] if k else -1)
    found, i = [], at[-1] if at else -1
    while i >= 0:
        found.append(i)
        i = before[i]
    return found[::-1]


def _full(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence, by the whole table."""
    table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            table[i][j] = table[i + 1][j + 1] + 1 if x[i] == y[j] else max(table[i + 1][j], table[i][j + 1])
    found, i, j = [], 0, 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        elif table[i + 1][j] >= table[i][j + 1]:
            i += 1
        else:
            j += 1
    return found


def _within(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Pairs of x's items with the first places in y that they can take in order."""
    found, j = [], 0
    for i, key in enumerate(x):
        while j < len(y) and y[j] != key:
            j += 1
        if j == len(y):
            break
        found.append((i, j))
        j += 1
    return found


def align(text: list[str], original: list[str]) -> dict[int, int]:
    """Line of the original for the lines of a text, rising on both sides.

    Lines whose key is unique on both sides are anchors, as many as can be taken
    in order; between anchors the same is done again. Equal lines at the ends of
    a stretch are matched first. What is left between two matches is paired line
    by line if both sides have equally many, matched in order if one side lacks
    lines only, else compared in full if it is short.
    """
    return align_keys([line_key(t) for t in text], [line_key(t) for t in original])


def align_keys(x: list[str], y: list[str]) -> dict[int, int]:
    """``align`` over any keys."""
    pairs: dict[int, int] = {}
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and x[a] == y[c]:
            pairs[a] = c
            a, c = a + 1, c + 1
        while a < b and c < d and x[b - 1] == y[d - 1]:
            b, d = b - 1, d - 1
            pairs[b] = d
        if a == b or c == d:
            continue
        counted, here = Counter(x[a:b]), Counter(y[c:d])
        place = {key: c + k for k, key in enumerate(y[c:d]) if here[key] == 1}
        anchors = [(i, place[x[i]]) for i in range(a, b) if counted[x[i]] == 1 and x[i] in place]
        if anchors:
            for k in rising([j for _, j in anchors]):
                i, j = anchors[k]
                pairs[i] = j
                todo.append((a, i, c, j))
                a, c = i + 1, j + 1
            todo.append((a, b, c, d))
        elif b - a == d - c:
            pairs.update(zip(range(a, b), range(c, d)))
        elif len(part := _within(x[a:b], y[c:d])) == b - a:
            pairs.update((a + i, c + j) for i, j in part)
        elif (b - a) * (d - c) <= FULL:
            pairs.update((a + i, c + j) for i, j in _full(x[a:b], y[c:d]))
    return pairs
