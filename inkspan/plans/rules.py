"""Queries of the rules that need a stack or a cursor; their tests hold them against plain versions."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from inkspan.functions import tex
from inkspan.functions.rules import chunks, repairs, spans
from inkspan.functions.text import GARBLED, TYPOS
from inkspan.operators import rules
from inkspan.plans.catalog import query


# SQL of the validators and repairs. It counts levels with windows instead of walking with a stack.
# tags: environment tags of ``source`` with their place. h: how many are open after a tag, when ends without a begin do not count;
# level: what a begin opens and an end closes; stray: an end without a begin; begins and ends of one level take turns.
def _tags(source: str, text: str = "text") -> str:
    pattern = r"\\(begin|end)\{([^}]+)\}"
    return rf"""
cut AS (SELECT doc_id, {text} AS text, regexp_split_to_array({text}, '{pattern}') AS pieces, regexp_extract_all({text}, '{pattern}') AS tags FROM {source}),
placed AS (SELECT doc_id, text, tags[i] AS tag, i, CAST(list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(tags[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS pos
  FROM (SELECT *, unnest(range(1, len(tags) + 1)) AS i FROM cut)),
tags AS (SELECT doc_id, i, pos, CASE WHEN starts_with(tag, '\begin') THEN 1 ELSE -1 END AS d, regexp_extract(tag, '{pattern}', 2) AS name,
  length(substr(text, 1, pos)) - length(replace(substr(text, 1, pos), chr(10), '')) + 1 AS line, length(list_last(string_split(substr(text, 1, pos), chr(10)))) + 1 AS col FROM placed)"""


def _levels(rows: str, made: str, key: str, order: str) -> str:
    """Tables that end in ``made``: ``rows`` (with d = 1 or -1) with ``h``, ``stray`` and ``level``, in each ``key``."""
    over = f"OVER (PARTITION BY {key} ORDER BY {order} ROWS UNBOUNDED PRECEDING)"
    return f"""
{made}_s AS (SELECT *, sum(d) {over} AS s FROM {rows}),
{made}_m AS (SELECT *, least(0, min(s) {over}) AS m FROM {made}_s),
{made}_h AS (SELECT *, s - m AS h, d < 0 AND m < coalesce(lag(m) OVER (PARTITION BY {key} ORDER BY {order}), 0) AS stray FROM {made}_m),
{made}_l AS (SELECT *, CASE WHEN stray THEN NULL WHEN d > 0 THEN h ELSE h + 1 END AS level FROM {made}_h),
{made} AS (SELECT *, d > 0 AND lead(d) OVER (PARTITION BY {key}, level ORDER BY {order}) IS NULL AS left_open FROM {made}_l)"""


LIVE = r"CASE WHEN regexp_matches(line, '(?s)^(?:[^%\\]|\\.)*%') THEN regexp_extract(line, '(?s)^((?:[^%\\]|\\.)*)%', 1) ELSE line END"


def _marks(source: str, characters: str, made: str) -> str:
    """Table ``made``: the unescaped ones of some characters, in ``source``'s column ``live``, with line and column."""
    return rf"""
{made} AS (SELECT * FROM (SELECT doc_id, line_no + 1 AS line, col, substr(live, col, 1) AS ch, CASE WHEN col > 1 THEN substr(live, col - 1, 1) END AS before
  FROM (SELECT *, unnest(range(1, length(live) + 1)) AS col FROM {source})) WHERE contains('{characters}', ch) AND before IS DISTINCT FROM '\')"""


def _pairs(opening: str, closing: str, kind: str, name: str) -> tuple[str, str]:
    marked = f"{name}_d AS (SELECT *, CASE WHEN ch = '{opening}' THEN 1 ELSE -1 END AS d FROM marks WHERE ch IN ('{opening}', '{closing}'))"
    rows = f"""SELECT doc_id, line, col, '{kind}', CASE WHEN stray THEN 'unmatched closing {closing}' ELSE 'unmatched opening {opening}' END FROM {name} WHERE stray OR left_open"""
    return marked + "," + _levels(f"{name}_d", name, "doc_id", "line, col"), rows


BRACES, BRACE_ROWS = _pairs("{", "}", "brace", "braces")
BRACKETS, BRACKET_ROWS = _pairs("[", "]", "bracket", "brackets")

SYNTAX = rf"""WITH live AS (SELECT doc_id, line_no, {LIVE} AS live FROM tex_lines),
{_marks("live", "{}[]", "marks")},
{BRACES}, {BRACKETS}, {_tags("tex")}, {_levels("tags", "nested", "doc_id, name", "i")},
dollars AS (SELECT doc_id, line_no + 1 AS line, regexp_split_to_array(live, '\\\$|\$\$?') AS pieces, regexp_extract_all(live, '\\\$|\$\$?') AS found FROM live),
single AS (SELECT doc_id, line, CAST(1 + list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS col
  FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM dollars) WHERE found[i] = '$'),
signs AS (SELECT doc_id, text, sign, string_split(text, sign) AS pieces FROM tex, (VALUES ('$$'), ('\('), ('\)'), ('\['), ('\]')) AS signs(sign)),
signed AS (SELECT doc_id, text, sign, i, len(pieces) - 1 AS n, CAST(list_sum(list_transform(pieces[1:i], lambda x: length(x))) + (i - 1) * 2 AS BIGINT) AS pos FROM (SELECT *, unnest(range(1, len(pieces))) AS i FROM signs)),
counts AS (SELECT doc_id, sign, len(pieces) - 1 AS n FROM signs),
extra AS (SELECT s.* FROM signed s JOIN counts c ON s.doc_id = c.doc_id AND c.sign = CASE s.sign WHEN '\(' THEN '\)' WHEN '\)' THEN '\(' WHEN '\[' THEN '\]' WHEN '\]' THEN '\[' ELSE '$$' END
  WHERE CASE WHEN s.sign = '$$' THEN s.i = s.n AND s.n % 2 = 1 ELSE s.i > c.n END)
{BRACE_ROWS.replace("col, 'brace'", "col AS column, 'brace' AS type").replace(" FROM braces", " AS message FROM braces")}
UNION ALL {BRACKET_ROWS}
UNION ALL SELECT doc_id, line, col, 'environment', CASE WHEN stray THEN 'end of ' || name || ' without begin' ELSE 'begin of ' || name || ' without end' END FROM nested WHERE stray OR left_open
UNION ALL SELECT doc_id, arg_max(line, line * 100000000 + col), arg_max(col, line * 100000000 + col), 'math', 'unmatched $' FROM single GROUP BY doc_id HAVING count(*) % 2 = 1
UNION ALL SELECT doc_id, length(substr(text, 1, pos)) - length(replace(substr(text, 1, pos), chr(10), '')) + 1, length(list_last(string_split(substr(text, 1, pos), chr(10)))) + 1, 'math', 'unmatched ' || sign FROM extra"""

MISSING_ENDS = rf"""WITH {_tags("tex_pairs", "translated")}, {_levels("tags", "nested", "doc_id, name", "i")},
ends AS (SELECT doc_id, string_agg(chr(10) || '\end{{' || name || '}}', '' ORDER BY i DESC) || chr(10) AS added FROM nested WHERE left_open GROUP BY doc_id)
SELECT doc_id, md5(translated || coalesce(added, '')) AS fixed, coalesce(added, '') <> '' AS changed FROM tex_pairs LEFT JOIN ends USING (doc_id)"""


TYPO_ROWS = ", ".join(f"('{wrong}', '{right}')" for wrong, right in TYPOS.items())
DOCUMENT_ENDS = r"""
UNION ALL SELECT doc_id, 0, 0, 'structure', 'missing ' || mark FROM tex, (VALUES ('\begin{document}'), ('\end{document}')) AS marks(mark) WHERE NOT contains(text, mark)
UNION ALL SELECT DISTINCT doc_id, 0, 0, 'structure', 'content after the document'
  FROM (SELECT doc_id, unnest(string_split(substr(text, strpos(text, '\end{document}') + 14), chr(10))) AS rest FROM tex WHERE contains(text, '\end{document}')) WHERE regexp_matches(rest, '^\s*[^%\s]')"""
# Every end takes the last begin, of whatever name.
STRICT = """
UNION ALL SELECT doc_id, line, 0, 'structure', CASE WHEN stray THEN 'end of ' || name || ' without begin' ELSE 'begin of ' || begun || ' ends as ' || name END
  FROM (SELECT *, lag(name) OVER (PARTITION BY doc_id, level ORDER BY i) AS begun FROM strict) WHERE stray OR (d < 0 AND begun <> name)
UNION ALL SELECT doc_id, 0, 0, 'structure', 'unclosed: ' || string_agg(name, ', ' ORDER BY i) FROM strict WHERE left_open GROUP BY doc_id"""

EDITOR = rf"""WITH live AS (SELECT doc_id, line_no, string_split(line, '%')[1] AS live FROM tex_lines),
chars AS (SELECT doc_id, line_no + 1 AS line, col, substr(live, col, 1) AS ch FROM (SELECT *, unnest(range(1, length(live) + 1)) AS col FROM live)),
sums AS (SELECT *, sum(CASE ch WHEN '{{' THEN 1 ELSE -1 END) OVER (PARTITION BY doc_id ORDER BY line, col ROWS UNBOUNDED PRECEDING) AS s FROM chars WHERE ch IN ('{{', '}}')),
totals AS (SELECT doc_id, a, b, kind, count(*) FILTER (ch = a) AS n, count(*) FILTER (ch = b) AS m
  FROM chars, (VALUES ('{{', '}}', 'syntax'), ('[', ']', 'warning'), ('(', ')', 'warning')) AS signs(a, b, kind) GROUP BY ALL),
{_tags("tex")}, {_levels("tags", "strict", "doc_id", "i")}
SELECT doc_id, line, col AS column, 'syntax' AS type, 'unexpected }}' AS message FROM sums WHERE ch = '}}' AND s < 0
UNION ALL SELECT doc_id, 0, 0, kind, n || ' ' || a || ' and ' || m || ' ' || b FROM totals WHERE n <> m
{STRICT}
UNION ALL SELECT doc_id, line_no + 1, strpos(live, wrong), 'syntax', wrong || ' for ' || well FROM live, (VALUES {TYPO_ROWS}) AS typos(wrong, well) WHERE contains(live, wrong)
UNION ALL SELECT doc_id, line_no + 1, 0, 'warning', 'odd number of $' FROM live WHERE (length(live) - length(replace(live, '$', ''))) % 2 = 1
UNION ALL SELECT doc_id, line_no + 1, length(live), 'warning', 'triple backslash' FROM live WHERE regexp_matches(live, '\\\\\\\s*$')
{DOCUMENT_ENDS}
UNION ALL SELECT doc_id, line_no + 1, strpos(line, list_filter({GARBLED!r}, lambda g: contains(line, g))[1]), 'encoding', 'garbled text' FROM tex_lines
  WHERE len(list_filter({GARBLED!r}, lambda g: contains(line, g))) > 0
UNION ALL SELECT doc_id, 0, 0, 'warning', 'byte-order mark inside' FROM tex WHERE contains(substr(text, 2), chr(65279))"""

PROJECT = rf"""WITH cut_lines AS (SELECT doc_id, line_no, regexp_replace(line, '(^|[^\\])%.*$', '\1') AS live FROM tex_lines),
{_marks("cut_lines", "{}", "marks")},
braces_d AS (SELECT *, CASE ch WHEN '{{' THEN 1 ELSE -1 END AS d FROM marks), {_levels("braces_d", "braces", "doc_id", "line, col")},
{_tags("tex")},
written AS (SELECT t.* FROM tags t JOIN tex_lines l ON l.doc_id = t.doc_id AND l.line_no + 1 = t.line WHERE NOT regexp_matches(l.line, '^\s*%')), {_levels("written", "strict", "doc_id", "i")},
surplus AS (SELECT doc_id, line_no, line, len(string_split(line, '{{')) - len(string_split(line, '\{{')) - len(string_split(line, '}}')) + len(string_split(line, '\}}')) AS n FROM tex_lines),
summed AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS upto FROM surplus)
SELECT doc_id, line, col AS column, CASE WHEN stray THEN 'error' ELSE 'warning' END AS type, CASE WHEN stray THEN 'extra closing brace' ELSE 'deep nesting' END AS message FROM braces WHERE stray OR h > 100
UNION ALL SELECT doc_id, 0, 0, 'error', CAST(arg_max(h, line * 100000000 + col) AS BIGINT) || ' unclosed braces' FROM braces GROUP BY doc_id HAVING arg_max(h, line * 100000000 + col) <> 0
UNION ALL SELECT doc_id, 0, 0, 'structure', 'missing \documentclass' FROM tex WHERE NOT contains(text, '\documentclass')
{DOCUMENT_ENDS}
UNION ALL SELECT doc_id, line_no + 1, 1, 'warning', 'incomplete command definition' FROM summed a WHERE n > 0 AND NOT regexp_matches(line, '^\s*%') AND regexp_matches(line, '\\(?:re)?newcommand')
  AND NOT EXISTS (SELECT 1 FROM summed b WHERE b.doc_id = a.doc_id AND b.line_no BETWEEN a.line_no + 1 AND a.line_no + 10 AND b.upto = a.upto - a.n)
{STRICT}"""

LOG_EXCERPTS = r"""WITH marked AS (SELECT *, starts_with(line, '!') OR contains(line, 'Error') AS error, contains(line, '.tex') AS source FROM log_lines),
near AS (SELECT *, bool_or(error) OVER (PARTITION BY doc_id ORDER BY line_no ROWS 49 PRECEDING) OR bool_or(source) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS taken FROM marked),
logs AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS log, string_agg(line, chr(10) ORDER BY line_no) FILTER (taken) AS found FROM near GROUP BY doc_id),
cut AS (SELECT doc_id, CASE WHEN length(log) <= 500 THEN log WHEN length(found) > 500 THEN substr(found, 1, 500) || chr(10) || '...[truncated]' WHEN found <> '' THEN found ELSE right(log, 500) END AS excerpt FROM logs)
SELECT doc_id, length(excerpt) AS n, md5(excerpt) AS excerpt FROM cut"""

def _break_points(source: str, limit: int, keep: str = "doc_id") -> str:
    """Tables ``fit``, ``low`` and ``places`` over a source's ``text``, and the place as an expression of the last."""
    ends = ", ".join("'" + e.replace(chr(10), "' || chr(10) || '") + "'" for e in chunks.ENDS)
    fit = f"SELECT {keep}, text, CASE WHEN strlen(text) <= {limit} THEN length(text) ELSE list_max(list_filter(range(1, {limit + 1}), lambda n: strlen(substr(text, 1, n)) <= {limit})) END AS most FROM {source}"
    return rf"""(SELECT {keep}, text, CAST(CASE WHEN most = length(text) THEN most WHEN sentence IS NOT NULL THEN sentence WHEN newline IS NOT NULL THEN newline WHEN space - 1 > most // 2 THEN space ELSE most END AS BIGINT) AS place FROM (
  SELECT {keep}, text, most,
  list_max(flatten(list_transform(ends, lambda e: list_transform(list_filter(range(low + 1, most - length(e) + 2), lambda i: substr(text, i, length(e)) = e), lambda i: i - 1 + length(e))))) AS sentence,
  list_max(list_filter(range(low + 1, most + 1), lambda i: substr(text, i, 1) = chr(10))) AS newline,
  list_max(list_filter(range(1, most + 1), lambda i: substr(text, i, 1) = ' ')) AS space FROM (SELECT *, most * 4 // 5 AS low, [{ends}] AS ends FROM ({fit}))))"""


BREAK_POINTS = f"SELECT doc_id, place AS at FROM {_break_points('tex', 400)}"

def _boundaries(source: str, suffix: str = "") -> str:
    """Tables that end in ``kept``: spans of environments that stay whole, outermost first; their names end in ``suffix``."""
    body = rf"""{_tags(source)}, {_levels("tags", "nested", "doc_id, name", "i")},
whole AS (SELECT * FROM (SELECT doc_id, name, d, stray, lag(pos) OVER (PARTITION BY doc_id, name, level ORDER BY i) AS start, pos + length(name) + 6 AS stop FROM nested)
  WHERE d < 0 AND NOT stray AND name IN ({", ".join(repr(n) for n in sorted(chunks.WHOLE))})),
kept AS (SELECT doc_id, min(start) AS start, arg_min(stop, start) AS stop FROM whole GROUP BY doc_id
  UNION ALL SELECT w.doc_id, min(w.start), arg_min(w.stop, w.start) FROM kept k JOIN whole w ON w.doc_id = k.doc_id AND w.start >= k.stop GROUP BY w.doc_id)"""
    return re.sub(r"\b(cut|placed|tags|nested\w*|whole|kept)\b", lambda m: m.group() + suffix, body)


BOUNDARIES = f"WITH RECURSIVE {_boundaries('tex')} SELECT doc_id, start, stop FROM kept"


def _gathered(source: str, made: str, pattern: str, behind: int, least: int, limit: int) -> str:
    """Tables that end in ``made`` (doc_id, unit, n, text): texts of ``source`` cut at a pattern outside whole environments, the
    pieces joined while they fit. ``behind``: cuts are behind a match, else before it; texts with fewer than ``least`` cuts stay whole."""
    x = made
    return rf"""{_boundaries(source, x)},
{x}_spans AS (SELECT s.doc_id, s.unit, s.text, coalesce(list({{'start': k.start, 'stop': k.stop}}) FILTER (k.start IS NOT NULL), []) AS spans FROM {source} s LEFT JOIN kept{x} k ON k.doc_id = s.doc_id GROUP BY ALL),
{x}_found AS (SELECT *, regexp_split_to_array(text, '{pattern}') AS parts, regexp_extract_all(text, '{pattern}') AS found FROM {x}_spans),
{x}_marks AS (SELECT doc_id, spans, CAST(list_sum(list_transform(parts[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda p: length(p))), 0) AS BIGINT) AS place, length(found[i]) AS size
  FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM {x}_found)),
{x}_places AS (SELECT doc_id, list_sort(list(place + size * {behind})) AS places FROM {x}_marks WHERE len(list_filter(spans, lambda s: s.start < place AND place < s.stop)) = 0 GROUP BY doc_id HAVING count(*) >= {least}),
{x}_edges AS (SELECT s.doc_id, s.unit, s.text, [0] || coalesce(places, []) || [length(s.text)] AS edges FROM {x}_spans s LEFT JOIN {x}_places USING (doc_id)),
{x}_pieces AS (SELECT doc_id, unit, row_number() OVER (PARTITION BY doc_id ORDER BY j) AS i, piece FROM (
  SELECT doc_id, unit, j, substr(text, edges[j] + 1, edges[j + 1] - edges[j]) AS piece FROM (SELECT *, unnest(range(1, len(edges))) AS j FROM {x}_edges)) WHERE piece <> ''),
{x}_fold AS (SELECT doc_id, unit, i, 0 AS n, strlen(piece) AS size, piece FROM {x}_pieces WHERE i = 1
  UNION ALL SELECT p.doc_id, p.unit, p.i, CASE WHEN f.size + strlen(p.piece) <= {limit} THEN f.n ELSE f.n + 1 END, CASE WHEN f.size + strlen(p.piece) <= {limit} THEN f.size ELSE 0 END + strlen(p.piece), p.piece
  FROM {x}_fold f JOIN {x}_pieces p ON p.doc_id = f.doc_id AND p.i = f.i + 1),
{x} AS (SELECT doc_id, unit, n, string_agg(piece, '' ORDER BY i) AS text FROM {x}_fold GROUP BY doc_id, unit, n)"""


LIMIT = 4000
SECTION_STARTS = r"(?m)^\\(?:section|subsection|subsubsection|chapter|part)\s*[\[{]"
BLANK_LINES = r"\n\s*\n"
# Units are numbered afresh at each level; ``unit`` keeps where a piece comes from, so that chunks come out in order.
def chunks_sql(limit: int) -> str:
    """Chunks of the texts: by sections, then paragraphs, then size, each level over what the one before left too large."""
    return rf"""WITH RECURSIVE large AS (SELECT doc_id, [doc_id] AS unit, text FROM tex WHERE strlen(text) > {limit}),
{_gathered("large", "sections", SECTION_STARTS, 0, 2, limit)},
long AS (SELECT row_number() OVER (ORDER BY unit, n) AS doc_id, unit || [n] AS unit, text FROM sections WHERE strlen(text) > {limit}),
{_gathered("long", "paragraphs", BLANK_LINES, 1, 0, limit)},
sized AS (SELECT row_number() OVER (ORDER BY unit, n) AS doc_id, unit || [n] AS unit, text FROM paragraphs WHERE strlen(text) > {limit}),
{_boundaries("sized", "3")},
lists AS (SELECT s.doc_id, s.unit, s.text, coalesce(list({{'start': k.start, 'stop': k.stop}}) FILTER (k.start IS NOT NULL), []) AS spans FROM sized s LEFT JOIN kept3 k ON k.doc_id = s.doc_id GROUP BY ALL),
steps AS (SELECT doc_id, unit, spans, 0 AS k, CAST(0 AS BIGINT) AS gone, '' AS piece, text AS text FROM lists
  UNION ALL
  SELECT doc_id, unit, spans, k + 1, gone + cut_at, substr(text, 1, cut_at), substr(text, cut_at + 1) FROM (
    SELECT *, coalesce(CASE WHEN inside.start > 0 THEN inside.start ELSE inside.stop END, place) AS cut_at FROM (
      SELECT *, list_filter(list_transform(spans, lambda s: {{'start': s.start - gone, 'stop': s.stop - gone}}), lambda s: s.start >= 0 AND s.start < place AND place < s.stop)[1] AS inside
      FROM {_break_points(f"(SELECT * FROM steps WHERE strlen(text) > {limit})", limit, "doc_id, unit, spans, k, gone")}))),
ends AS (SELECT unit || [k] AS unit, piece AS text FROM steps WHERE k > 0
  UNION ALL SELECT unit || [k + 1], text FROM steps WHERE strlen(text) <= {limit} AND text <> ''),
chunk_rows AS (SELECT [doc_id] AS unit, text FROM tex WHERE strlen(text) <= {limit} UNION ALL SELECT unit || [n], text FROM sections WHERE strlen(text) <= {limit}
  UNION ALL SELECT unit || [n], text FROM paragraphs WHERE strlen(text) <= {limit} UNION ALL SELECT * FROM ends)
SELECT unit[1] AS doc_id, row_number() OVER (PARTITION BY unit[1] ORDER BY unit) - 1 AS chunk, strlen(text) AS bytes, md5(text) AS content FROM chunk_rows"""


def _rewrite(made: str, rules: list[tuple[str, str]]) -> str:
    """The line rules one after another, as SQL over an expression."""
    for pattern, gap in rules:
        made = f"regexp_replace({made}, '{pattern}', '\\1' || " + " || ".join("chr(10)" if c == chr(10) else "' '" for c in gap) + " || '\\2', 'g')"
    return made


def _split_lines(pattern: str) -> str:
    """Lines of ``text`` with several matches split, if fewer of them have one than of ``original``'s lines."""
    lines = lambda c: f"string_split({c}, chr(10))"
    having = lambda c: f"len(list_filter({lines(c)}, lambda x: regexp_matches(x, '{pattern}')))"
    head = f"regexp_extract(x, '(?s)^(.*?{pattern})', 1)"
    parted = f"{head} || regexp_replace(substr(x, length({head}) + 1), '[ \\t]*({pattern})', chr(10) || '\\1', 'g')"
    return f"CASE WHEN near AND {having('text')} < {having('original')} THEN array_to_string(list_transform({lines('text')}, lambda x: CASE WHEN regexp_matches(x, '{pattern}') THEN {parted} ELSE x END), chr(10)) ELSE text END"


FINAL_LINES = f"SELECT doc_id, md5(fixed) AS fixed, fixed <> translated AS changed FROM (SELECT doc_id, translated, {_rewrite('translated', repairs.LINE_BREAKS)} AS fixed FROM tex_pairs)"
LINE_STRUCTURE = f"""WITH spaced AS (SELECT doc_id, original, translated, {_rewrite('translated', repairs.SPACED)} AS text FROM tex_pairs),
split0 AS (SELECT *, abs(len(string_split(original, chr(10))) - len(string_split(text, chr(10)))) <= greatest(5, len(string_split(original, chr(10))) // 5) AS near FROM spaced),
{", ".join(f"split{i} AS (SELECT doc_id, original, translated, near, {_split_lines(p)} AS text FROM split{i - 1})" for i, p in enumerate(repairs.SINGLE, 1))}
SELECT doc_id, md5(fixed) AS fixed, fixed <> translated AS changed FROM (SELECT doc_id, translated, {_rewrite('text', repairs.BREAKS)} AS fixed FROM split{len(repairs.SINGLE)})"""


# Spans of a text in SQL: rows (doc_id, start, stop, type, name, rank) by the pieces around the matches of a pattern.
def _found(pattern: str, kind: str, name: str, rank: int, trim: int = 0, keep: str = "true", start: str = "start", stop: str = "stop") -> str:
    return rf"""SELECT doc_id, {start} AS start, {stop} AS stop, '{kind}' AS type, {name} AS name, {rank} AS rank FROM (
  SELECT doc_id, tag, CAST(sum(length(piece) + length(coalesce(before, ''))) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS start, start + length(tag) - {trim} AS stop
  FROM (SELECT doc_id, i, pieces[i] AS piece, found[i] AS tag, found[i - 1] AS before FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM (
    SELECT doc_id, regexp_split_to_array(text, '{pattern}') AS pieces, regexp_extract_all(text, '{pattern}') AS found FROM tex)))) WHERE {keep}"""


def _matched(patterns: tuple[str, ...], kind: str, rank: int) -> list[str]:
    """A pattern that ends by looking ahead takes that character, which ``trim`` gives back."""
    made = []
    for pattern in patterns:
        trim = int("(?=" in pattern)
        plain = pattern.replace(r"(?=[\[{])", r"[\[{]").replace(r"(?=\{)", r"\{")
        made.append(_found(plain, kind, f"substr(tag, 1, length(tag) - {trim})", rank, trim))
    return made


def _spanned(names: list[str], kind: str, rank: int) -> str:
    return rf"""SELECT doc_id, start, stop, '{kind}', name, {rank} FROM (
  SELECT doc_id, name, d, stray, lag(pos) OVER (PARTITION BY doc_id, name, level ORDER BY i) AS start, pos + length(name) + 6 AS stop FROM nested) WHERE d < 0 AND NOT stray AND name IN ({", ".join(map(repr, names))})"""


MATH_ROWS = [
    _spanned(spans.MATH, "environment", 1), _found(r"(?s)\$\$.*?\$\$", "display", "'$$'", 2), _found(r"(?s)\\\[.*?\\\]", "display", r"'\[\]'", 2), _found(r"(?s)\\\(.*?\\\)", "inline", r"'\(\)'", 2),
    rf"""SELECT doc_id, start, stop, 'inline', '$', 2 FROM (SELECT doc_id, lag(start) OVER w AS start, stop, row_number() OVER w AS n
  FROM ({_found(r"(?s)\\.|\$\$|\$", "inline", "'$'", 2, keep="tag = '$'")}) WINDOW w AS (PARTITION BY doc_id ORDER BY stop)) WHERE n % 2 = 0""",
]
AUTHORS = rf"""SELECT a.doc_id, a.start, b.stop, 'author', 'author', 1 FROM ({_found(r"\\author\s*\{", "author", "'author'", 1)}) a
  JOIN (SELECT doc_id, d, stray, place + 1 AS stop, lag(place) OVER (PARTITION BY doc_id, level ORDER BY place) AS start FROM closed) b ON a.doc_id = b.doc_id AND b.start = a.stop - 1 WHERE b.d < 0 AND NOT b.stray"""
AUTHOR_BRACES = rf"""author_braces AS (SELECT doc_id, start AS place, CASE name WHEN '{{' THEN 1 ELSE -1 END AS d FROM ({_found("[{}]", "brace", "tag", 1)})
  WHERE doc_id IN (SELECT doc_id FROM tex WHERE contains(text, '\author'))), {_levels("author_braces", "closed", "doc_id", "place")}"""
# A run of backslashes separates once, by its first two; an ampersand after an even number of them separates.
CELLS = [
    _found(r"\\\\(?:\\+|(?:\s*\[[^\]]*\])?)", "separator", r"'\\'", 1, stop=r"CASE WHEN substr(tag, 3, 1) = '\' THEN start + 2 ELSE stop END"),
    _found(r"\\*&", "separator", "'&'", 1, keep="length(tag) % 2 = 1", start="stop - 1"),
]
SPANS = {
    "math": MATH_ROWS, "tables": [_spanned(spans.TABLES, "table", 1)], "table_commands": _matched(spans.TABLE_COMMANDS, "command", 1), "cells": CELLS, "authors": [AUTHORS],
    "commands": _matched(spans.COMMANDS, "command", 3),
}


def _disjoint(rows: list[str]) -> str:
    """Tables that end in ``kept``: spans by start, longer first, without those that begin inside a kept one; ``n`` numbers them from 0."""
    best = "arg_min(x, (x.start, -x.stop, x.rank))"
    return rf"""{_tags("tex")}, {_levels("tags", "nested", "doc_id, name", "i")}, {AUTHOR_BRACES},
spans(doc_id, start, stop, type, name, rank) AS ({" UNION ALL ".join(rows)}),
walk AS (SELECT doc_id, 0 AS n, {best} AS s FROM spans x GROUP BY doc_id
  UNION ALL SELECT x.doc_id, any_value(w.n) + 1, {best} FROM walk w JOIN spans x ON x.doc_id = w.doc_id AND x.start >= w.s.stop GROUP BY x.doc_id),
kept AS (SELECT doc_id, n, s.start AS start, s.stop AS stop, s.type AS type, s.name AS name FROM walk)"""


def _replaced(rows: list[str], placeholder: str, result: str) -> str:
    """``result`` over every text with its kept spans replaced by ``placeholder``, an expression of n."""
    return rf"""WITH RECURSIVE {_disjoint(rows)},
parts AS (SELECT doc_id, count(*) AS placeholders, max(stop) AS last, string_agg(gap || {placeholder}, '' ORDER BY n) AS head FROM (
  SELECT k.doc_id, n, stop, substr(t.text, before + 1, start - before) AS gap FROM (SELECT *, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY n), 0) AS before FROM kept) k JOIN tex t USING (doc_id)) GROUP BY doc_id)
SELECT doc_id, {result} FROM (SELECT doc_id, coalesce(placeholders, 0) AS placeholders, coalesce(head, '') || substr(t.text, coalesce(last, 0) + 1) AS text FROM tex t LEFT JOIN parts USING (doc_id))"""


PROTECT = {kind: _replaced(rows, f"'<<<LATEX_{spans.PROTECTED[kind][0]}_' || n || '>>>'", "placeholders, md5(text) AS text") for kind, rows in SPANS.items()}
COMMAND_ROWS = [_spanned([*spans.TABLES, "figure", "figure*", "verbatim", "lstlisting", "tikzpicture"], "environment", 0), *MATH_ROWS, *SPANS["commands"]]
COMMANDS = f"WITH RECURSIVE {_disjoint(COMMAND_ROWS)} SELECT doc_id, type, name, start, stop FROM kept"
PLAIN_TEXT = _replaced(COMMAND_ROWS, "''", "text AS plain")


STRUCTURE_ROWS = [
    rf"""SELECT doc_id, off + length(live), off + length(line), 'comment', CASE WHEN regexp_matches(live, '^\s*$') THEN 'comment' ELSE 'inline_comment' END, 0 FROM (SELECT *, {LIVE} AS live,
  CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) - length(line) - 1 AS BIGINT) AS off FROM tex_lines) WHERE length(live) < length(line)""",
    *MATH_ROWS[1:],
    rf"""SELECT doc_id, start, stop, CASE WHEN name IN ({", ".join(map(repr, spans.TABLES))}) THEN 'table' WHEN name IN ({", ".join(map(repr, spans.MATH))}) THEN 'display' ELSE 'environment' END, name, 3 FROM (
  SELECT doc_id, name, d, stray, lag(pos) OVER (PARTITION BY doc_id, name, level ORDER BY i) AS start, pos + length(name) + 6 AS stop FROM nested) WHERE d < 0 AND NOT stray""",
    _found(r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?(?:\{[^{}]*\})?", "command", "tag", 4),
]
STRUCTURES = rf"""WITH {_tags("tex")}, {_levels("tags", "nested", "doc_id, name", "i")},
spans(doc_id, start, stop, type, name, rank) AS ({" UNION ALL ".join(STRUCTURE_ROWS)}),
numbered AS (SELECT *, row_number() OVER () AS n FROM spans)
SELECT any_value(a.doc_id) AS doc_id, any_value(a.start) AS start, any_value(a.stop) AS stop, any_value(a.type) AS type, any_value(a.name) AS name, count(b.doc_id) > 0 AS is_nested,
  coalesce(arg_min(b.type, (b.start, -b.stop, b.rank)) FILTER (b.doc_id IS NOT NULL), '') AS parent_type
FROM numbered a LEFT JOIN spans b ON a.doc_id = b.doc_id AND b.start < a.start AND b.stop > a.stop GROUP BY a.n"""


@query("SELECT doc_id, md5(text) AS restored FROM tex")
def protection_round_trip(t):
    return rules.restore(rules.protect(t.tex, "text")).select("doc_id", F.md5("restored").alias("restored"))


def _protected(kind: str):
    def build(t):
        made = rules.protect(t.tex, "text", kind)
        return made.select("doc_id", F.size("protected.placeholders").alias("placeholders"), F.md5("protected.text").alias("text"))

    build.__name__ = f"protect_{kind}"
    query(PROTECT[kind])(build)


for _kind in spans.PROTECTED:
    _protected(_kind)


@query("SELECT doc_id, md5(text) AS text FROM tex")
def chunk_concatenation(t):
    rows = rules.chunk(t.tex, "doc_id", "text", 500)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "text"))), lambda s: s["text"]), "")
    return rows.groupBy("doc_id").agg(F.md5(joined).alias("text"))


@query(chunks_sql(LIMIT))
def chunking(t):
    return rules.chunk(t.tex, "doc_id", "text", LIMIT).select("doc_id", "chunk", F.octet_length("text").alias("bytes"), F.md5("text").alias("content"))


@query(BREAK_POINTS)
def chunk_break_points(t):
    return rules.with_text(t.tex, "at", lambda x: chunks.break_point(x, 400), "text", kind="long").select("doc_id", "at")


@query(BOUNDARIES)
def environment_boundaries(t):
    return rules.explode_rule(t.tex, "doc_id", "text", chunks.boundaries, "start bigint, stop bigint")


@query(SYNTAX)
def syntax_validation(t):
    return rules.validate(t.tex, "doc_id", "text", "syntax")


@query(EDITOR)
def editor_validation(t):
    return rules.validate(t.tex, "doc_id", "text", "editor")


@query(PROJECT)
def project_validation(t):
    return rules.validate(t.tex, "doc_id", "text", "project")


@query(STRUCTURES)
def structure_identification(t):
    return rules.structures(t.tex, "doc_id", "text")


@query(COMMANDS)
def command_extraction(t):
    return rules.commands(t.tex, "doc_id", "text")


@query(PLAIN_TEXT)
def plain_text_extraction(t):
    return rules.with_text(t.tex, "plain", spans.plain_text, "text").select("doc_id", "plain")


@query("SELECT doc_id, 'A big ' || doc_id AS title FROM documents")
def title_extraction(t):
    made = t.documents.select("doc_id", F.concat(F.lit("x \\title{A \\emph big "), F.col("doc_id").cast("string"), F.lit("} y")).alias("text"))
    return rules.with_text(made, "title", lambda x: " ".join(spans.title(x).split()), "text").select("doc_id", "title")


REPAIRS = {
    "repair_postprocess": repairs.postprocess, "repair_reference": repairs.reference_fixes,
    "repair_comments": repairs.restore_comments, "repair_environments": repairs.restore_environments, "repair_braces": repairs.restore_braces,
    "repair_lines": repairs.fix_by_lines, "repair_inputs": repairs.restore_inputs, "repair_quick_fix": repairs.quick_fix_with_reference,
}
REPAIRS_ALONE = {
    "repair_missing_ends": repairs.insert_missing_ends, "repair_nesting": repairs.fix_nesting, "repair_tables": repairs.fix_table_layout,
    "repair_figures": repairs.fix_figure_layout, "repair_wide_tables": repairs.widen_tables, "repair_resizebox": repairs.close_resizebox,
    "repair_quick": repairs.quick_fix,
}


REPAIR_SQL = {
    "repair_missing_ends": MISSING_ENDS, "repair_environments": MISSING_ENDS,
}


def _repair(name: str, rule, columns: tuple[str, ...]):
    def build(t):
        return rules.with_text(t.tex_pairs.select("doc_id", *columns), "fixed", rule, *columns).select("doc_id", F.md5("fixed").alias("fixed"), (F.col("fixed") != F.col("translated")).alias("changed"))

    build.__name__ = name
    query(REPAIR_SQL.get(name))(build)


for _name, _rule in REPAIRS.items():
    _repair(_name, _rule, ("translated", "original"))
for _name, _rule in REPAIRS_ALONE.items():
    _repair(_name, _rule, ("translated",))


def _lines_mended(t, fixed):
    return t.tex_pairs.withColumn("fixed", fixed).select("doc_id", F.md5("fixed").alias("fixed"), (F.col("fixed") != F.col("translated")).alias("changed"))


@query(FINAL_LINES)
def repair_final_lines(t):
    return _lines_mended(t, tex.break_lines(F.col("translated"), repairs.LINE_BREAKS))


@query(LINE_STRUCTURE)
def repair_line_structure(t):
    return _lines_mended(t, tex.restore_line_structure(F.col("translated"), F.col("original"), repairs.SPACED, repairs.BREAKS, repairs.SINGLE))


@query("SELECT doc_id, regexp_replace(original, 'section', 'part', 'g') <> original AS changed, md5(regexp_replace(original, 'section', 'part', 'g')) AS fixed FROM tex_pairs")
def repair_regex(t):
    return rules.regex_fix(t.tex_pairs, "original", "section", "part").select("doc_id", "changed", F.md5("fixed").alias("fixed"))


@query()
def placeholder_recovery(t):
    made = rules.protect(t.tex, "text", "commands").select("doc_id", "text", "protected.*").toDF("doc_id", "original", "text", "placeholders")
    lossy = made.withColumn("text", F.replace("text", F.lit("<<<LATEX_CMD_1>>>"), F.lit("")))
    return rules.recover(lossy, "text", "original", "placeholders").select("doc_id", F.md5("recovered.text").alias("text"), F.size("recovered.attempts").alias("attempts"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'UTF-8' ELSE 'UTF-8-BOM' END AS encoding, md5(text) AS text FROM documents")
def encoding_detection(t):
    content = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8")))
    rows = t.documents.select("doc_id", content.alias("content"))
    found = rules.with_text(rows, "encoding", lambda b: repairs.detect_encoding(bytes(b)), "content")
    return rules.with_text(found, "t", lambda b: repairs.to_text(bytes(b)), "content").select("doc_id", "encoding", F.md5("t").alias("text"))


@query(LOG_EXCERPTS)
def log_excerpts(t):
    log = t.joined(t.log_lines)
    return rules.with_text(log, "excerpt", lambda x: repairs.log_excerpt(x, 500), "text").select("doc_id", F.length("excerpt").alias("n"), F.md5("excerpt").alias("excerpt"))
