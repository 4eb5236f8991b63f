"""Chunking that keeps environments whole. Sizes are bytes; chunks join to the input."""

from __future__ import annotations

import re

from inkspan.functions.rules.spans import environments

# Environments that no cut may fall into.
WHOLE = set(
    "table table* tabular tabular* tabularx figure figure* equation equation* align align* gather gather* tikzpicture algorithm algorithmic lstlisting verbatim minted itemize enumerate description theorem lemma proof definition corollary abstract quote quotation".split()
)
ENDS = [". ", ".\n", "? ", "?\n", "! ", "!\n", "。", "？", "！"]


def size(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass"))


def boundaries(text: str) -> list[tuple[int, int]]:
    """Outermost spans of environments that stay whole."""
    found: list[tuple[int, int]] = []
    for s in environments(text, WHOLE):
        if not found or s.start >= found[-1][1]:
            found.append((s.start, s.end))
    return found


def within(at: int, spans: list[tuple[int, int]]) -> tuple[int, int] | None:
    return next((s for s in spans if s[0] < at < s[1]), None)


def fitting(text: str, limit: int) -> int:
    """Characters from the start that fit the limit in bytes, one at least."""
    if size(text) <= limit:
        return len(text)
    return max(1, len(text[:limit].encode("utf-8", "surrogatepass")[:limit].decode("utf-8", "ignore")))


def break_point(text: str, limit: int) -> int:
    """Sentence end in the last fifth, else a newline there, else a space past the half, else the limit."""
    most = fitting(text, limit)
    if most == len(text):
        return most
    low = most * 4 // 5
    ends = [low + i + len(e) for e in ENDS if (i := text[low:most].rfind(e)) >= 0]
    if ends:
        return max(ends)
    newline = text.rfind("\n", low, most)
    if newline >= 0:
        return newline + 1
    space = text.rfind(" ", 0, most)
    return space + 1 if space > most // 2 else most


def gather(pieces: list[str], limit: int) -> list[str]:
    """Consecutive pieces joined while they fit; a larger one is by itself."""
    out: list[str] = []
    for piece in pieces:
        if out and size(out[-1]) + size(piece) <= limit:
            out[-1] += piece
        elif piece:
            out.append(piece)
    return out


def cut_at(text: str, places: list[int]) -> list[str]:
    edges = [0, *places, len(text)]
    return [text[a:b] for a, b in zip(edges, edges[1:]) if b > a]


def by_size(text: str, limit: int) -> list[str]:
    out = []
    while size(text) > limit:
        at = break_point(text, limit)
        inside = within(at, boundaries(text))
        if inside:
            at = inside[0] or inside[1]
        out.append(text[:at])
        text = text[at:]
    return out + [text] if text else out


def by_paragraph(text: str, limit: int) -> list[str]:
    spans = boundaries(text)
    places = [m.end() for m in re.finditer(r"\n\s*\n", text) if not within(m.start(), spans)]
    return [p for c in gather(cut_at(text, places), limit) for p in (by_size(c, limit) if size(c) > limit else [c])]


def by_section(text: str, limit: int) -> list[str]:
    spans = boundaries(text)
    places = [m.start() for m in re.finditer(r"(?m)^\\(?:section|subsection|subsubsection|chapter|part)\s*[\[{]", text) if not within(m.start(), spans)]
    if len(places) < 2:
        return [text]
    return [p for c in gather(cut_at(text, places), limit) for p in (by_paragraph(c, limit) if size(c) > limit else [c])]


def split_chunks(text: str, limit: int = 4000) -> list[str]:
    """The whole text if it fits; else by sections, paragraphs or size, the first that splits it."""
    if size(text) <= limit:
        return [text]
    for split in (by_section, by_paragraph):
        found = split(text, limit)
        if len(found) > 1:
            return found
    return by_size(text, limit)
