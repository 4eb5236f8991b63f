"""Repairs of a text, many of them against a reference text. Each returns the repaired text; order matters where noted."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter

from inkspan.functions.rules.alignment import align, align_keys
from inkspan.functions.rules.groups import close_arguments, drop_repeated_ends, uncross, unopened
from inkspan.functions.rules.spans import TAG, balanced
from inkspan.functions.rules.validators import live
from inkspan.functions.text import TYPOS

# Commands that were translated by mistake, and where line breaks belong.
TRANSLATED = {
    "引用": "cite", "参考": "ref", "标签": "label", "章节": "section", "小节": "subsection", "段落": "paragraph", "图": "figure", "表": "table",
    "公式": "equation", "开始": "begin", "结束": "end", "文本": "text", "粗体": "textbf", "斜体": "textit", "下划线": "underline", "脚注": "footnote", "项目": "item",
}
LISTS = "itemize|enumerate|description"
FLOATS = r"wrapfigure|figure\*?|table\*?|sidewaystable"
SECTION = r"\\(?:section|subsection|subsubsection|paragraph|chapter)\b"
RULES = r"\\(?:toprule|midrule|bottomrule|hline)"
GRIDS = "tabular|tabularx|longtable|array"
BREAKS = [
    (rf"(\\end\{{(?:{LISTS})\}})\s*(\\item\b)", "\n"), (r"(\\end\{[^}]+\})\s*(\\begin\{[^}]+\})", "\n"), (rf"(\\end\{{[^}}]+\}})\s*({SECTION})", "\n\n"),
    (rf"([^\n\s])\s*(\\begin\{{(?:{LISTS})\}})", "\n"), (rf"(\\end\{{(?:{LISTS})\}})([^\n\\])", "\n"),
]
LINE_BREAKS = BREAKS + [
    (r"([^\n])(\\item\b)", "\n"), (rf"(\}})\s*({SECTION})", "\n\n"), (rf"(\}})\s*(\\begin\{{(?:{LISTS}|quote|quotation|center)\}})", "\n"),
    (r"(\\maketitle)\s*([^\n\s\\])", "\n\n"), (r"(%[^\n]*[^\s\n])\s*(\\begin\{[^}]+\})", "\n"), (rf"([^\n])\s*(\\begin\{{(?:{FLOATS}|equation|align)\}})", "\n"),
    (rf"(\\end\{{(?:{FLOATS})\}})\s*([^\n\s\\])", "\n"), (r"(\\caption\{[^}]*\})\s*(\\(?:footnotesize|small|tiny|scriptsize|normalsize|large|Large|LARGE|huge|Huge)\b)", "\n    "),
    (r"(\\caption\{[^}]*\})\s*(\\setlength)", "\n    "), (rf"(\\caption\{{[^}}]*\}})\s*(\\begin\{{(?:{GRIDS})\}})", "\n    "), (rf"({RULES})\s*({RULES}\b)", "\n    "),
    (r"(\\\\)\s*(\\(?:midrule|bottomrule|hline)\b)", "\n    "), (r"(\\(?:midrule|toprule|hline))\s*(&|\w)", "\n    "), (rf"(\\end\{{(?:{GRIDS})\}})\s*(\\end\{{table\*?\}})", "\n"),
    (r"(\\centering)\s*(\\caption)", "\n    "), (r"(\\label\{[^}]*\})\s*(\\end\{(?:table|figure)\*?\})", "\n"),
]
SPACED = [
    (r"([^\n\s])\s*(\\begin\{[^}]+\})", "\n"), (r"(\\begin\{[^}]+\}(?:\[[^\]]*\])?)\s*([^\n\s\[\\])", "\n"), (r"([^\n\s])\s*(\\end\{[^}]+\})", "\n"),
    (r"(\\end\{[^}]+\})\s*([^\n\s\\])", "\n"), (r"([^\n\s])\s*(\\item\b)", "\n"),
]


def rewrite(text: str, rules: list[tuple[str, str]]) -> str:
    for pattern, gap in rules:
        text = re.sub(pattern, lambda m, gap=gap: m.group(1) + gap + m.group(2), text, flags=re.A)
    return text


def fix_line_structure(text: str) -> str:
    return rewrite(text, LINE_BREAKS)


#: Tags and items of which a line should have one, as the original's lines do.
SINGLE = (r"\\begin\{[^}]+\}", r"\\end\{[^}]+\}", r"\\item\b")


def split_merged(text: str, original: str) -> str:
    """Lines with several begins, ends or items are split, if fewer lines have one than in the original.

    Texts whose numbers of lines differ by more than a fifth and more than five are left alone.
    """
    a, b = original.split("\n"), text.split("\n")
    if abs(len(a) - len(b)) > max(5, len(a) // 5):
        return text
    for pattern in SINGLE:
        own = re.compile(pattern, re.A)
        b = text.split("\n")
        if sum(bool(own.search(line)) for line in b) < sum(bool(own.search(line)) for line in a):
            gap = re.compile(rf"[ \t]*({pattern})", re.A)
            ends = [m.end() if (m := own.search(line)) else len(line) for line in b]
            text = "\n".join(line[:end] + gap.sub(lambda m: "\n" + m.group(1), line[end:]) for line, end in zip(b, ends))
    return text


def restore_line_structure(text: str, original: str = "") -> str:
    """Line breaks back around tags and items; merged ones are split where the original has them apart."""
    text = rewrite(text, SPACED)
    return rewrite(split_merged(text, original) if original else text, BREAKS)


def _tag_stack(text: str) -> list[tuple[str, int]]:
    """Environments left open when every end closes the nearest begin of its name."""
    begun: dict[str, list[int]] = {}
    left: dict[int, str] = {}  # position -> name, in text order
    for m in TAG.finditer(text):
        if m.group(1) == "begin":
            begun.setdefault(m.group(2), []).append(m.start())
            left[m.start()] = m.group(2)
        elif begun.get(m.group(2)):
            del left[begun[m.group(2)].pop()]
    return [(name, at) for at, name in left.items()]


def insert_missing_ends(text: str) -> str:
    """End tags for environments left open, innermost first, at the end of the text."""
    stack = _tag_stack(text)
    return text + "".join(f"\n\\end{{{name}}}" for name, _ in reversed(stack)) + ("\n" if stack else "")


def restore_environments(text: str, original: str = "") -> str:
    return insert_missing_ends(text) if text else text


def fix_nesting(text: str) -> str:
    """Before an end that skips open environments, those are ended."""
    stack, held, out, at = [], Counter(), [], 0
    for m in TAG.finditer(text):
        name = m.group(2)
        if m.group(1) == "begin":
            stack.append(name)
            held[name] += 1
        elif held[name]:
            out.append(text[at : m.start()])
            at = m.start()
            while stack[-1] != name:
                held[stack[-1]] -= 1
                out.append(f"\n\\end{{{stack.pop()}}}\n")
            held[stack.pop()] -= 1
    return "".join([*out, text[at:]])


def _is_comment(line: str) -> bool:
    return line.lstrip(" \t").startswith("%")


def _bare(line: str) -> str:
    return line.strip().removeprefix("%").strip()


def _alike(a: str, b: str) -> bool:
    """Same leading command and argument; else the same first 20 characters; short lines always."""
    x, y = _bare(a), _bare(b)
    if not x or not y:
        return False
    full = r"\\[a-zA-Z]+(?:\[[^\]]*\])?\{[^}]*\}"
    p, q = re.match(full, x), re.match(full, y)
    if p and q:
        return p.group() == q.group()
    p, q = re.match(r"\\[a-zA-Z]+", x), re.match(r"\\[a-zA-Z]+", y)
    if p and q:
        n = min(15, len(x) - p.end(), len(y) - q.end())
        return p.group() == q.group() and x[p.end() :][:n] == y[q.end() :][:n]
    n = min(20, len(x), len(y))
    return n < 10 or x[:n] == y[:n]


def _surplus(line: str) -> int:
    part = live(line)
    return part.count("{") - part.count("\\{") - part.count("}") + part.count("\\}")


def fix_line(line: str, reference: str) -> str:
    """One line against its counterpart: comment sign, commented tags, closing braces, a stray document end."""
    if not reference.strip():
        return line
    fixed = line
    if _is_comment(reference) != _is_comment(line) and _alike(reference, line):
        if _is_comment(reference):
            fixed = "% " + fixed.lstrip(" \t")
        elif "\\bibliography{" not in line:
            fixed = re.match(r"[ \t]*", reference).group() + _bare(line)
    if not _is_comment(reference):
        for m in TAG.finditer(reference):
            fixed = re.sub(r"%\s?" + re.escape(m.group()), lambda _, tag=m.group(): tag, fixed, count=1)
    for _ in range(max(0, _surplus(reference) - _surplus(fixed))):
        if fixed.rstrip(" \t").endswith("}}"):
            fixed = fixed.rstrip(" \t")[:-1]
    if "\\end{document}" in fixed and "\\end{document}" not in reference:
        fixed = fixed.replace("\\end{document}", "").strip()
    return fixed


def fix_by_lines(text: str, original: str) -> str:
    """Each line against the line of the original that it is aligned with; lines without one stay."""
    if not text or not original:
        return text
    a, b = original.split("\n"), text.split("\n")
    for i, j in align(b, a).items():
        b[i] = fix_line(b[i], a[j])
    return "\n".join(b)


def restore_comments(text: str, original: str) -> str:
    """Comment signs that a line's counterpart in the original has; commented tags anywhere."""
    if not text or not original:
        return text
    a, b = original.split("\n"), text.split("\n")
    hidden = {m.group() for line in a if _is_comment(line) for m in TAG.finditer(line)}
    shown = {m.group() for line in a if not _is_comment(line) for m in TAG.finditer(line)}
    for i, j in align(b, a).items():
        if _is_comment(a[j]) and b[i].strip() and not _is_comment(b[i]) and _alike(a[j], b[i]):
            b[i] = "% " + b[i].lstrip(" \t")
    for i, line in enumerate(b):
        tags = {m.group() for m in TAG.finditer(line)}
        if tags and not _is_comment(line) and tags <= hidden - shown and re.fullmatch(r"\s*", TAG.sub("", line)):
            b[i] = "% " + line.lstrip(" \t")
    return "\n".join(b)


def pair_commented_tags(text: str, original: str) -> str:
    """Begin and end of an environment both in comments or both not: as the original has it, else not."""
    if not text or not original:
        return text
    hidden = {m.group(2) for line in original.split("\n") if _is_comment(line) for m in TAG.finditer(line)}
    shown = {m.group(2) for line in original.split("\n") if not _is_comment(line) for m in TAG.finditer(line)}
    lines, begun = text.split("\n"), {}
    for i, line in enumerate(lines):
        for m in TAG.finditer(line):
            if m.group(1) == "begin":
                begun.setdefault(m.group(2), []).append(i)
            elif begun.get(m.group(2)):
                j = begun[m.group(2)].pop()
                if _is_comment(lines[i]) != _is_comment(lines[j]):
                    at = j if _is_comment(lines[j]) else i  # the commented one
                    if m.group(2) in hidden - shown:
                        lines[i + j - at] = "% " + lines[i + j - at].lstrip(" \t")
                    else:
                        lines[at] = re.sub(r"^([ \t]*)%+[ \t]?", r"\1", lines[at])
    return "\n".join(lines)


def _brace_marks(text: str) -> list[tuple[int, str]]:
    return [(m.start(), m.group()) for m in re.finditer(r"[{}](?<!\\[{}])", re.sub(r"%(?<!\\%)[^\n]*", lambda m: " " * len(m.group()), text))]


def brace_difference(text: str) -> int:
    return sum(1 if m == "{" else -1 for _, m in _brace_marks(text))


def restore_braces(text: str, original: str = "") -> str:
    """Closing braces where an opening one is left open: at its line's end if the original balances such lines, else at the end."""
    out = text.split("\n")
    if original:
        reference = original.split("\n")
        for i, j in align(out, reference).items():
            lacking = _surplus(out[i]) - _surplus(reference[j])
            if lacking > 0 and not _is_comment(out[i]):
                out[i] = out[i].rstrip() + "}" * lacking
    return close_braces("\n".join(out))


def close_braces(text: str) -> str:
    """As many closing braces as are lacking, before the document's end or at the end; excess ones go from the end."""
    lacking = brace_difference(text)
    if lacking > 0:
        at = text.rfind("\\end{document}")
        return text[:at] + "}" * lacking + "\n" + text[at:] if at >= 0 else text + "}" * lacking
    depth, excess = 0, []
    for at, mark in _brace_marks(text):
        depth += 1 if mark == "{" else -1
        if depth < 0:
            excess.append(at)
            depth = 0
    for at in reversed(excess):
        text = text[:at] + text[at + 1 :]
    return text


def fix_tabular(text: str) -> str:
    """Column definitions back on the line of their tabular."""
    text = re.sub(r"(\\begin\{tabular\}(?:\[[^\]]*\])?)\s*\n\s*(\{[^}]*\})", r"\1\2", text)
    text = re.sub(r"(\\multirow\{[0-9]+\}\{\*\}\{)\s*\n\s*(\\begin\{tabular\})", r"\1\2", text)
    return re.sub(r"(\\end\{tabular\}\})\s*\n\}\s*\n\s*(&?)", lambda m: m.group(1) + " " + m.group(2), text)


def tidy(text: str) -> str:
    return re.sub("\n{4,}", "\n\n\n", "\n".join(line.rstrip(" \t") for line in text.split("\n")))


def postprocess(text: str, original: str) -> str:
    """Chunk repair in its fixed order: lines, comments, commented tags, environments, nesting, crossing, braces, tables, white space."""
    if not text:
        return text
    text = pair_commented_tags(restore_comments(restore_line_structure(text, original), original), original)
    text = uncross(fix_nesting(restore_environments(text, original)))
    return tidy(fix_tabular(restore_braces(close_arguments(text), original)))


INPUT = re.compile(r"(?m)^[^%\n]*?(\\(?:input|include)\{[^}]+\})")


def restore_inputs(text: str, original: str) -> str:
    """Include commands that got lost: after the nearest one before them that is left, else after the document's begin."""
    wanted = list(dict.fromkeys(INPUT.findall(original)))
    present = set(INPUT.findall(text))
    for i, command in enumerate(wanted):
        if command in present:
            continue
        anchor = next((w for w in reversed(wanted[:i]) if w in present), "\\begin{document}")
        place = re.search(r"(?m)^[^%\n]*" + re.escape(anchor) + r"[^\n]*$", text)
        if place:
            text = text[: place.end()] + "\n" + command + text[place.end() :]
            present.add(command)
    return text


def restore_appendix(text: str, original: str) -> str:
    """The appendix mark, before the first section that follows it in the original."""
    at = re.search(r"(?m)^[^%\n]*\\appendix\b", original, re.A)
    if not at or re.search(r"(?m)^[^%\n]*\\appendix\b", text, re.A):
        return text
    before = len(re.findall(r"(?m)^[^%\n]*\\section", original[: at.start()]))
    sections = list(re.finditer(r"(?m)^[^%\n]*\\section", text))
    if before >= len(sections):
        return text
    place = sections[before].start()
    return text[:place] + "\\appendix\n" + text[place:]


# Set-up commands before which an opening brace stands alone, and what may not be glued to a table's end.
SET_UP = r"\\(?:setlength|renewcommand|begin\{(?:table|figure)|centering|caption)"
TABLE_ENDS = [
    (r"(\\end\{table\*?\}\s*\n\})([^\s}])", "\n\n"), (r"(\\end\{table\*?\})([^\s}%])", "\n\n"),
    (r"(\n\})(\\(?:textbf|textit|textsc|emph|section|subsection|paragraph)\{)", "\n\n"), (r"(\n\})([A-Za-z\u4e00-\u9fff])", "\n\n"),
]


def drop_braces_after_tables(text: str) -> str:
    """Closing braces that close nothing and stand alone on the line behind a table's end."""
    out, at = [], 0
    for place in unopened(text):
        head, stop = text.rfind("\n", 0, place) + 1, text.find("\n", place)
        stop = stop + 1 if stop >= 0 else len(text)
        before = text[text.rfind("\n", 0, max(head - 1, 0)) + 1 : head]
        if text[head:stop].strip() == "}" and re.search(r"\\end\{table\*?\}\s*\Z", before):
            out.append(text[at:head])
            at = stop
    return "".join([*out, text[at:]])


def free_comment_braces(text: str) -> str:
    """An opening brace that ended up behind a comment, before a set-up command, gets a line of its own."""
    return re.sub(rf"(?m)^([ \t]*%[^\n]*?)\{{[ \t]*\n(?=[ \t]*{SET_UP})", lambda m: m.group(1).strip(" \t") + "\n\n{\n", text)


def drop_styled_metadata(text: str) -> str:
    """Lines of classification mark-up whose tags were set in mathematical italics."""
    styled = re.compile("[\U0001d400-\U0001d7ff]").search
    metadata = lambda line: re.search(r"concept(?:id|desc|significance)|ccs2012|CCSXML", unicodedata.normalize("NFKC", line))
    return "\n".join(line for line in text.split("\n") if line.isascii() or not (styled(line) and metadata(line)))


def reference_fixes(text: str, original: str) -> str:
    """Repairs against the original in their fixed order: commented tags, includes, appendix, aligned lines, the document's end,
    crossing closers, comments, ends, cell and caption arguments, lines around tables, stray braces, braces in all."""
    if not original:
        return text
    hidden = {m.group() for line in original.split("\n") if _is_comment(line) for m in TAG.finditer(line)}
    lines = []
    for line in text.split("\n"):
        tags = {m.group() for m in TAG.finditer(line)}
        wrong = tags and _is_comment(line) and not tags & hidden and all(t in original for t in tags)
        lines.append(re.sub(r"^([ \t]*)%+[ \t]?", r"\1", line) if wrong else line)
    text = restore_appendix(restore_inputs("\n".join(lines), original), original)
    text = uncross(drop_repeated_ends(fix_by_lines(text, original)))
    text = close_arguments(insert_missing_ends(restore_comments(text, original)))
    text = drop_styled_metadata(free_comment_braces(drop_braces_after_tables(rewrite(text, TABLE_ENDS))))
    return close_braces(text)


def _columns(definition: str) -> int:
    return len(re.findall("[clrp]", definition))


def fix_table_layout(text: str) -> str:
    """Placement, column gap, and scaling of tables by their number of columns."""
    out, star, scaled = [], None, False
    for line in text.split("\n"):
        indent = re.match(r"[ \t]*", line).group()
        begin = re.search(r"\\begin\{table(\*?)\}", line)
        if begin:
            star, scaled, gap = bool(begin.group(1)), False, False
            line = re.sub(r"(\\begin\{table\*?\})\[!?[th]\]", r"\1[!htbp]", line)
        elif star is not None:
            gap = gap or "\\tabcolsep" in line
            if "\\centering" in line and not gap:
                out.append(indent + "\\setlength{\\tabcolsep}{1.5pt}")
                gap = True
            grid = re.search(r"\\begin\{tabular\}\{([^}]+)\}", line)
            if grid and not re.search(r"\\(?:scale|resize)box", line):
                n = _columns(grid.group(1))
                scale = ("0.65" if n >= 14 else "0.7" if n >= 12 else "") if star else ("0.7" if n >= 10 else "0.75" if n >= 8 else "")
                width = "\\textwidth" if star else "\\columnwidth"
                opening = f"\\scalebox{{{scale}}}{{%" if scale else f"\\resizebox{{{width}}}{{!}}{{%" if n >= (8 if star else 6) else ""
                if opening:
                    out.append(indent + opening)
                    scaled = True
            if "\\end{tabular}" in line and scaled:
                line += "\n" + indent + "}% end scaling"
                scaled = False
            if re.search(r"\\end\{table\*?\}", line):
                star = None
        out.append(line)
    return "\n".join(out)


def fix_figure_layout(text: str) -> str:
    """Placement, widths, and ends that match their begins, of figures."""
    out, star = [], None
    for line in text.split("\n"):
        begin = re.search(r"\\begin\{figure(\*?)\}", line)
        if begin:
            star = begin.group(1)
            line = re.sub(r"(\\begin\{figure\*?\})\[!?[th]\]", r"\1[!htbp]", line)
        if star is not None:
            unit, share = ("textwidth", "0.85") if star else ("columnwidth", "0.9")
            line = re.sub(rf"(\\includegraphics\[width=)[0-9.]+(\\{unit}\])", rf"\g<1>{share}\2", line)
            if re.search(r"\\end\{figure\*?\}", line):
                line = re.sub(r"\\end\{figure\*?\}", lambda _, s=star: f"\\end{{figure{s}}}", line)
                star = None
        out.append(line)
    return "\n".join(out)


def widen_tables(text: str, columns: int = 14, ahead: int = 50) -> str:
    """Tables of many columns span the page."""
    lines, i = text.split("\n"), 0
    while i < len(lines):
        if "\\begin{table}" in lines[i]:
            stop = next((j for j in range(i + 1, min(i + ahead, len(lines))) if "\\end{table}" in lines[j]), None)
            grid = next((m for j in range(i + 1, stop or i) if (m := re.search(r"\\begin\{tabular\}\{([^}]+)\}", lines[j]))), None)
            if stop and grid and _columns(grid.group(1)) >= columns:
                lines[i] = re.sub(r"\\begin\{table\}(?:\[!(?:htbp|t)\])?", r"\\begin{table*}[!t]", lines[i], count=1)
                lines[stop] = lines[stop].replace("\\end{table}", "\\end{table*}", 1)
                i = stop
        i += 1
    return "\n".join(lines)


def close_resizebox(text: str) -> str:
    """A resizebox that is still open where its tabular ends is closed there."""
    at = 0
    while (m := re.compile(r"\\resizebox\s*\{[^}]*\}\s*\{[^}]*\}\s*\{").search(text, at)) is not None:
        at = m.end()
        end = text.find("\\end{tabular}", at)
        stop = re.compile(r"\\end\{table").search(text, at)
        close = balanced(text, m.end() - 1)
        if end >= 0 and (not stop or end < stop.start()) and (not close or (stop and close > stop.start())):
            end += len("\\end{tabular}")
            text = text[:end] + "}" + text[end:]
    return text


DEFINITION = re.compile(r"\\(?:(?:re)?newcommand|newenvironment|def)")


def strip_end_braces(text: str) -> str:
    """Closing braces after an end tag that no command definition before it is waiting for. Braces are counted once."""
    marks = _brace_marks(text)
    places, depth = [at for at, _ in marks], [0]
    for _, mark in marks:
        depth.append(depth[-1] + (1 if mark == "{" else -1))
    level = lambda at: depth[bisect_left(places, at)]
    begun = [m.start() for m in DEFINITION.finditer(text)]

    def keep(m: re.Match) -> str:
        last = bisect_left(begun, m.start()) - 1
        waiting = max(0, level(m.start()) - level(begun[last])) if last >= 0 else 0
        return m.group(1) + "}" * min(waiting, len(m.group(2)))

    return re.sub(r"(\\end\{[^}]+\})(\}+)", keep, text)


def close_definitions(text: str) -> str:
    """The end part of an environment definition, ``{\\end{...}`` on its line, is closed where the definition cannot go on."""
    lines = text.split("\n")
    for i, line in enumerate(lines):
        after = lines[i + 1].strip() if i + 1 < len(lines) else ""
        lacking = line.count("{") - line.count("}")
        if line.strip().startswith("{\\end{") and lacking > 0 and (not after or after[0] in "\\%"):
            lines[i] = line + "}" * lacking
    return "\n".join(lines)


def close_repeated_theorems(text: str) -> str:
    """The definition of repeated theorems closes its end part, its environment and itself before ``\\makeatother``."""
    return re.sub(r"(\{\\end\{rep@theorem\})\}*(\s*\n\s*\\makeatother)", r"\1}}\2", text)


def merge_resizeboxes(text: str) -> str:
    """A resizebox whose whole content is the same resizebox again loses the inner one, with its closing brace."""
    twice = re.compile(r"(\\resizebox\s*\{[^{}]*\}\s*\{[^{}]*\}\s*\{)\s*%?\s*(\1)")
    at = 0
    while (m := twice.search(text, at)) is not None:
        close = balanced(text, m.end() - 1)
        inner = text[m.end() : close - 1] + text[close:] if close else text[m.end() :]
        text, at = text[: m.end(1)] + inner, m.start()
    return text


def comment_orphaned_lists(text: str) -> str:
    """The begin of a list that only comments follow, its end among them, is commented too."""
    lines = text.split("\n")
    for i, line in enumerate(lines):
        begin = re.fullmatch(rf"\s*\\begin\{{({LISTS})\}}(?:\[[^\]]*\])?\s*", line)
        if begin:
            for after in lines[i + 1 :]:
                if after.strip() and not _is_comment(after):
                    break
                if f"\\end{{{begin.group(1)}}}" in after:
                    lines[i] = "% " + line.lstrip(" \t")
                    break
    return "\n".join(lines)


def lonely_items(text: str) -> str:
    """Items outside any list get one around them."""
    out, depth, inside = [], 0, False
    for line in text.split("\n"):
        part = live(line)
        item = re.match(r"\s*\\item\b", part, re.A)
        if item and not depth and not inside:
            out.append("\\begin{itemize}")
            inside = True
        elif inside and not item and (not part.strip() or part.lstrip().startswith("\\")):
            out.append("\\end{itemize}")
            inside = False
        out.append(line)
        depth += len(re.findall(rf"\\begin\{{(?:{LISTS})\}}", part)) - len(re.findall(rf"\\end\{{(?:{LISTS})\}}", part))
    return "\n".join(out + ["\\end{itemize}"] * inside)


def quick_fix(text: str) -> str:
    """Rules without a reference, in their fixed order."""
    for wrong, right in TRANSLATED.items():
        text = text.replace("\\" + wrong, "\\" + right)
    text = strip_end_braces(rewrite(text, BREAKS))
    text = lonely_items(insert_missing_ends(comment_orphaned_lists(close_braces(text))))
    text = re.sub(r"(\\bibliography\{[^}]*\})\s*(\\bibliographystyle\{[^}]*\})", r"\2\n\1", text)
    if "\\usepackage{subcaption}" in text:
        text = text.replace("\\usepackage{subfigure}", "")
    if re.search(r"fontspec|xeCJK|ctex", text):
        text = text.replace("\\usepackage{breakurl}", "")
    text = close_definitions(text)
    text = merge_resizeboxes(re.sub(r"(\\end\{document\})\s*\}+\s*\Z", r"\1\n", text))
    text = re.sub(r"(\\includegraphics(?:\[[^\]]*\])?\{)([^}/]+/)\2", r"\1\2", text)
    text = close_repeated_theorems(close_resizebox(text))
    text = re.sub(r"(\\end\{tabular\})\}\}(\s*&)", r"\1}\2", text)
    end = text.find("\\end{document}")
    if end >= 0:
        text = text[:end].replace("\\end{document}", "") + "\\end{document}\n"
    return widen_tables(fix_figure_layout(fix_table_layout(text)))


def quick_fix_with_reference(text: str, original: str) -> str:
    return quick_fix(reference_fixes(text, original))


def simple_fix(text: str) -> str:
    """Unclosed braces, content after the document's end, and misspelt commands."""
    for wrong, right in TYPOS.items():
        text = text.replace(wrong, right)
    end = text.find("\\end{document}")
    if end >= 0:
        text = text[: end + len("\\end{document}")] + "\n"
    return close_braces(text)


def auto_fix(text: str) -> str:
    """The editor's workflow: byte-order mark, misspelt commands, braces."""
    return simple_fix(text.removeprefix("\ufeff"))


def recover_placeholders(text: str, original: str, table: dict[str, str]) -> tuple[str, list[tuple[str, str]]]:
    """Missing placeholders put back, and the strategy of each.

    Tried in order: after a like command, on the line of the original, after the
    words before it in the original, before the words after it, at the end.
    """
    number = lambda k: int(re.search(r"_(\d+)>>>", k).group(1)) if re.search(r"_(\d+)>>>", k) else 0
    done = []
    for key in sorted((k for k in table if k not in text), key=lambda k: (number(k), k)):
        value = table[key]
        text, how = _recover(text, original, key, value)
        done.append((key, how))
    return text, done


def _recover(text: str, original: str, key: str, value: str) -> tuple[str, str]:
    put = lambda at: text[:at] + " " + key + text[at:]
    command = re.match(r"\\([a-zA-Z]+)", value)
    like = list(re.finditer(r"\\" + command.group(1) + r"\b", text, re.A)) if command else []
    if like:
        at = like[-1].end()
        return put(balanced(text, at) if text[at : at + 1] == "{" else at), "pattern_match"
    lines, own = original.split("\n"), text.split("\n")
    row = next((i for i, line in enumerate(lines) if value in line), None)
    if row is not None and len(own) == len(lines):
        own[row] += " " + key
        return "\n".join(own), "line_based"
    at = original.find(value)
    if at >= 0:
        before, after = original[:at].split()[-3:], original[at + len(value) :].split()[:3]
        if before and (i := text.rfind(" ".join(before))) >= 0:
            return put(i + len(" ".join(before))), "context_before"
        if after and (i := text.find(" ".join(after))) >= 0:
            return text[:i] + key + " " + text[i:], "context_after"
    return text + " " + key, "append"


PIECE = re.compile(r"<<<[^<>]*>>>|[^\W_]+|\s|[\s\S]")


def _grown_together(pieces: list[str], missing: set[str]) -> dict[str, list[str]]:
    """Words that become one where the placeholders between them are missing, by that one word."""
    found: dict[str, list[str]] = {}
    run: list[str] = []
    for piece in [*pieces, ""]:
        if piece in missing:
            continue
        if not piece.isalnum():
            if len(run) > 1:
                found["".join(run)] = run
            run = []
        else:
            run = [*run, piece]
    return found


def recover_in_order(text: str, protected: str, keys: list[str]) -> tuple[str, list[tuple[str, str]]]:
    """Missing placeholders put back by their neighbours in ``protected``, the text with all of them; and how each was.

    Words, signs and placeholders of both texts are aligned. A missing one goes
    behind the piece before it that has a counterpart (``anchor``), or to the
    start (``start``), so placeholders stay in the order of ``protected``, each
    once. One that ``protected`` lacks too goes to the end (``append``).
    """
    present = set(re.findall(r"<<<[^<>]*>>>", text))
    missing = {k for k in keys if k not in present}
    if not missing:
        return text, []
    b = PIECE.findall(protected)
    grown = _grown_together(b, missing)
    a = [part for piece in PIECE.findall(text) for part in grown.get(piece, (piece,))]
    place = {j: i for i, j in align_keys(a, b).items()}
    after: dict[int, list[str]] = {}
    done, at = [], -1
    for j, piece in enumerate(b):
        at = max(at, place.get(j, -1))
        if piece in missing:
            missing.discard(piece)
            after.setdefault(at, []).append(piece)
            done.append((piece, "anchor" if at >= 0 else "start"))
    done += [(k, "append") for k in keys if k in missing]
    out = after.get(-1, []) + [x for i, piece in enumerate(a) for x in (piece, *after.get(i, ()))]
    return "".join([*out, *(" " + k for k in keys if k in missing)]), done


def log_excerpt(log: str, limit: int, most: int = 50) -> str:
    """Lines from each error on and around each source file, cut to the limit; the log's end if there are none."""
    if len(log) <= limit:
        return log
    lines, taken, left = log.split("\n"), set(), 0
    for i, line in enumerate(lines):
        if line.startswith("!") or "Error" in line:
            left = most
        if left > 0:
            taken.add(i)
            left -= 1
        if ".tex" in line:
            taken.update(range(max(0, i - 2), min(len(lines), i + 3)))
    found = "\n".join(lines[i] for i in sorted(taken))
    return found[:limit] + "\n...[truncated]" if len(found) > limit else found or log[-limit:]


def fit_font(text: str, width: float, height: float, low: float = 6.0, high: float = 72.0, step: float = 0.5) -> float:
    """Largest font size, found by halving, at which the wrapped text fits the box; ``low`` if none does."""
    wide = re.compile("[\u4e00-\u9fff\u3400-\u4dbf\U00020000-\U0002a6df\uf900-\ufaff\u3000-\u303f]")
    chars = [("n", 0.0) if c == "\n" else ("c", 1.0 if wide.match(c) else 0.25 if c in " \t" else 0.5) for c in text if c != "\r"]

    def fits(size: float) -> bool:
        lines, used, total = 1, 0.0, 0.0
        for kind, share in chars:
            w = share * size
            total += w
            if kind == "n":
                lines, used = lines + 1, 0.0
            elif used + w > width:
                lines, used = lines + 1, w
            else:
                used += w
        return lines <= max(1, int(height / (size * 1.2))) and total / lines <= width

    best = low
    while high - low >= step:
        middle = (low + high) / 2
        if fits(middle):
            best, low = middle, middle + step
        else:
            high = middle - step
    return best


def detect_encoding(content: bytes) -> str:
    """By byte-order mark, else valid UTF-8, else valid GBK, else unknown."""
    for mark, name in ((b"\xef\xbb\xbf", "UTF-8-BOM"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE")):
        if content.startswith(mark):
            return name
    for name in ("UTF-8", "GBK"):
        try:
            content.decode(name)
            return name
        except UnicodeDecodeError:
            continue
    return "UNKNOWN"


CODECS = {"UTF-8": "utf-8", "UTF-8-BOM": "utf-8-sig", "GBK": "gbk", "UTF-16LE": "utf-16-le", "UTF-16BE": "utf-16-be"}


def to_text(content: bytes) -> str:
    """Text of bytes in a detected encoding; unknown bytes are replaced."""
    name = detect_encoding(content)
    return content.decode(CODECS.get(name, "utf-8"), "replace").removeprefix("\ufeff")


def convert(content: bytes, target: str) -> bytes:
    mark = {"UTF-16LE": b"\xff\xfe", "UTF-16BE": b"\xfe\xff"}.get(target, b"")
    return mark + to_text(content).encode(CODECS[target], "replace")
