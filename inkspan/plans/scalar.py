"""Queries of scalar functions: one projection per group of functions, nothing shuffled."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkspan.functions import blocks, checks, geometry, ids, tex, text
from inkspan.plans.catalog import query

T = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
N = "len(regexp_extract_all({0}, '{1}'))"


def trimmed(c: str) -> str:
    return T.format(c)


def n(c: str, pattern: str) -> str:
    return N.format(c, pattern)


@query(rf"""
SELECT n, input,
  CASE WHEN regexp_matches(lower(t), '^https?://') AND contains(lower(t), 'arxiv') THEN 'url'
       WHEN regexp_matches(t, '^(\d{{4}}\.\d{{4,5}}|[a-z-]+/\d{{7}})$') THEN 'arxiv_id'
       WHEN suffix(lower(t), '.zip') THEN 'local_zip' WHEN suffix(lower(t), '.pdf') THEN 'local_pdf' END AS kind,
  regexp_matches(input, '^(\d{{4}}\.\d{{4,5}}|[a-z-]+/\d{{7}})$') AS strict_id,
  CASE WHEN strlen(input) >= 10 AND substr(input, 5, 1) = '.' THEN regexp_matches(input, '^\d{{4}}\.\d+$')
       ELSE strlen(input) >= 10 AND contains(input, '/') END AS lenient_id,
  CASE WHEN contains(t, 'arxiv.org') AND regexp_matches(t, '(?:^|/)(?:abs|pdf)/') THEN regexp_replace(regexp_extract(t, '(?:^|/)(?:abs|pdf)/([^/]*)', 1), '\.pdf$', '')
       WHEN CASE WHEN strlen(t) >= 10 AND substr(t, 5, 1) = '.' THEN regexp_matches(t, '^\d{{4}}\.\d+$') ELSE strlen(t) >= 10 AND contains(t, '/') END THEN t ELSE '' END AS paper_id
FROM (SELECT n, input, {trimmed('input')} AS t FROM inputs)
""")
def input_classification(t):
    c = F.col("input")
    return t.inputs.select(
        "n", "input", ids.classify_input(c).alias("kind"), ids.is_paper_id(c).alias("strict_id"),
        ids.is_paper_id_lenient(c).alias("lenient_id"), ids.extract_paper_id(c).alias("paper_id"),
    )


@query(r"""
SELECT n,
  CASE WHEN contains(input, 'arxiv.org') AND tail <> '' THEN 'https://arxiv.org/e-print/' || regexp_replace(string_split(tail, '?')[1], '/$', '') ELSE input END AS canonical,
  CASE WHEN contains(input, 'arxiv.org') AND contains(input, '/abs/') THEN replace(list_last(string_split(input, '/abs/')), '/', '_') || '.tar.gz'
       WHEN contains(input, 'arxiv.org') AND contains(input, '/pdf/') THEN replace(regexp_replace(list_last(string_split(input, '/pdf/')), '\.pdf$', ''), '/', '_') || '.tar.gz'
       WHEN last = '' THEN 'download.tar.gz' WHEN contains(last, '.') THEN last ELSE last || '.tar.gz' END AS filename,
  translate(input, '/:\', '___') AS safe_id,
  CASE WHEN len(string_split(input, '/abs/')) < 2 THEN '' ELSE regexp_replace(string_split(input, '/abs/')[2], '(?s)^(.[^v]*)v.*$', '\1') END AS feed_id
FROM (SELECT n, input, list_last(string_split(input, '/')) AS last,
  CASE WHEN contains(input, '/pdf/') THEN regexp_replace(list_last(string_split(input, '/pdf/')), '\.pdf$', '')
       WHEN contains(input, '/abs/') THEN list_last(string_split(input, '/abs/')) ELSE '' END AS tail FROM inputs)
""")
def url_functions(t):
    c = F.col("input")
    return t.inputs.select(
        "n", ids.canonical_url(c).alias("canonical"), ids.filename_from_url(c).alias("filename"),
        ids.sanitise_id(c).alias("safe_id"), ids.feed_paper_id(c).alias("feed_id"),
    )


@query(r"""
SELECT name, regexp_extract(lower(name), '(?s)_([^_]*)_(?:cn|bilingual)\.pdf$', 1) AS category,
  nullif(regexp_extract(lower(name), '_([a-z0-9]+)_(?:cn|bilingual)\.pdf$', 1), '') AS category_strict,
  CASE WHEN suffix(name, '_cn.pdf') THEN 'cn' WHEN suffix(name, '_bilingual.pdf') THEN 'bilingual' ELSE 'zip' END AS kind,
  true AS safe, false AS safe_above, false AS safe_root
FROM repo_files
""")
def file_name_functions(t):
    c = F.col("name")
    return t.repo_files.select(
        "name", ids.category_from_filename(c).alias("category"), ids.category_strict(c).alias("category_strict"), ids.file_kind(c).alias("kind"),
        ids.is_safe_path(F.concat(F.lit("a/../b/"), c)).alias("safe"), ids.is_safe_path(F.concat(F.lit("a/../../"), c)).alias("safe_above"),
        ids.is_safe_path(F.concat(F.lit("/"), c)).alias("safe_root"),
    )


@query(r"""
SELECT doc_id, sha256(text) AS content_hash, md5(text) AS file_md5, 'md5_' || substr(md5(text), 1, 16) AS directory,
  CASE WHEN doc_id % 3 = 0 THEN 'md5_' || substr(md5(text), 1, 16) ELSE CAST(doc_id AS VARCHAR) END AS paper_key,
  upper(substr(md5(text), 1, 4)) || '-' || upper(substr(md5(text), 5, 4)) || '-ABCD-0123' AS serial, true AS serial_ok, false AS serial_bad
FROM documents
""")
def content_identity(t):
    c, d = F.col("text"), F.col("doc_id")
    serial = F.concat(F.upper(F.substring(F.md5(c), 1, 4)), F.lit("-"), F.upper(F.substring(F.md5(c), 5, 4)), F.lit("-ABCD-0123"))
    return t.documents.select(
        "doc_id", F.sha2(c, 256).alias("content_hash"), F.md5(c).alias("file_md5"), ids.hash_directory(F.md5(c)).alias("directory"),
        ids.synthetic_id(F.when(d % 3 == 0, "").otherwise(d.cast("string")), F.md5(c)).alias("paper_key"),
        serial.alias("serial"), ids.is_serial(serial).alias("serial_ok"), ids.is_serial(F.concat(serial, F.lit("-"))).alias("serial_bad"),
    )


@query(rf"""
SELECT doc_id, {n('text', r'\p{Han}')} AS han, {n('text', r'\p{Han}')} > 0 AS has_han,
  len(string_split(text, chr(10))) - CASE WHEN suffix(text, chr(10)) THEN 1 ELSE 0 END AS lines,
  len(list_filter(string_split(text, chr(10)), lambda x: {trimmed('x')} <> '')) AS nonblank,
  CASE WHEN length(text) <= 50 THEN text ELSE substr(text, 1, 50) || '...' END AS shown,
  md5(regexp_replace({trimmed("replace(text, chr(10), ' ')")}, ' {{2,}}', ' ', 'g')) AS cleaned,
  md5(regexp_replace(regexp_replace(text, '(?m)[ \t]+$', '', 'g'), '\n{{4,}}', chr(10) || chr(10) || chr(10), 'g')) AS tidied,
  regexp_matches(text, '\pL') AND NOT regexp_matches(text, '[\p{{Ll}}\p{{Lo}}\p{{Lt}}\p{{Lm}}]') AS all_upper,
  contains(text, '鎮ㄧ殑') OR contains(text, '锟斤拷') OR contains(text, '�') AS garbled,
  regexp_matches(upper(text), 'TODO|FIXME|NOTE|XXX|HACK|BUG|WARNING') AS important,
  length(replace(replace(text, '\begn{{', '\begin{{'), 'the', '')) AS typo_probe
FROM documents
""")
def text_functions(t):
    c = F.col("text")
    return t.documents.select(
        "doc_id", text.han_count(c).alias("han"), text.has_han(c).alias("has_han"), text.line_count(c).alias("lines"), text.nonblank_line_count(c).alias("nonblank"),
        text.truncate(c, 50).alias("shown"), F.md5(text.clean_feed_text(c)).alias("cleaned"), F.md5(text.tidy_lines(c)).alias("tidied"),
        text.is_all_upper(c).alias("all_upper"), text.is_garbled(c).alias("garbled"), text.is_important_comment(c).alias("important"),
        F.length(F.replace(text.fix_typos(c), F.lit("the"), F.lit(""))).alias("typo_probe"),
    )


SYM = blocks.SYMBOLS
SCR = blocks.SCRIPTS
BT = trimmed("text")


@query(rf"""
SELECT doc_id, pos,
  ((contains(text, ' def ') OR suffix(text, ' def')) AND contains(text, '/')) OR regexp_matches(low, 'null def|/burl|burl@') OR regexp_matches(text, '@stx|@etx')
    OR regexp_matches(low, '{blocks.POSTSCRIPT}')
    OR (NOT contains(text, '://') AND NOT contains(low, 'http') AND len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: regexp_matches(w, '^/[A-Za-z0-9_@]+$'))) >= 3) AS postscript,
  ((contains(text, ' def ') OR suffix(text, ' def')) AND contains(text, '/')) OR regexp_matches(low, '{blocks.POSTSCRIPT_SHORT}') AS postscript_short,
  CASE WHEN text = '' THEN false ELSE {n('text', r'[\x00-\x08\x0b\x0c\x0e-\x1f\x{7f}-\x{9f}]')} / strlen(text) > 0.1 END AS unprintable,
  (text <> '' AND ({n('text', r'[-+*/=<>^_~()\[\]{}]')} + {n('text', f'[{SYM}]')}) / length(text) > 0.3)
    OR (contains(text, '=') AND regexp_matches(text, '[(+-]') AND {n('text', r'\S+')} <= 5 AND strlen(text) < 100)
    OR regexp_matches(text, '{blocks.BIG}') OR ({n('text', '[_^]')} > 2 AND strlen(text) < 100) AS formula_parsed,
  (text <> '' AND {n('text', f'[-+*/=<>^_{SYM}{SCR}]')} / length(text) > 0.25) OR regexp_matches(text, '{blocks.BIG}') OR regexp_matches(text, '[{SCR}]')
    OR (contains(text, '=') AND regexp_matches(text, '[()]') AND strlen(text) < 50 AND {n('text', '[A-Za-z]')} < 10 AND {n('text', f'[-+*/=<>^_{SYM}{SCR}]')} > 2) AS formula_glyph,
  (text <> '' AND {n('text', f'[-+*/=<>^_{SYM}]')} / strlen(text) > 0.25) OR regexp_matches(text, '{blocks.BIG}') AS formula_bytes,
  regexp_matches(low, '^(figure|table|fig\.|tab\.|图|表)') AS caption,
  strlen(t) >= 2 AND (regexp_matches(t, '^[•◦▪▫●○■□*–—-]') OR regexp_matches(t, '(?s)^[0-9a-z][).].') OR (regexp_matches(t, '(?s)^\(.(\)|.\))') AND strlen(t) >= 3)) AS list_item,
  false AS line_numbers,
  strlen(t) >= 3 AND NOT ({n('t', f'[-+*/=<>^_{SYM}]')} / strlen(t) > 0.25 OR regexp_matches(t, '{blocks.BIG}')) AND {n('t', '[A-Za-z]')} / strlen(t) >= 0.3 AS translate_block,
  t <> '' AND NOT (x = 0 AND y = 0) AND y >= 0 AND NOT (strlen(text) < 3 AND width < 20) AND lower(t) <> 'preprint' AND NOT starts_with(lower(t), 'arxiv:') AS translatable
FROM (SELECT *, lower(text) AS low, {BT} AS t FROM blocks)
""")
def block_predicates(t):
    c, own = F.col("text"), F.col("t")
    return t.blocks.withColumn("t", text.strip(c)).select(
        "doc_id", "pos", blocks.is_postscript(c).alias("postscript"), blocks.is_postscript_short(c).alias("postscript_short"),
        blocks.is_unprintable(c).alias("unprintable"), blocks.is_formula_parsed(c).alias("formula_parsed"), blocks.is_formula_glyph(c).alias("formula_glyph"),
        blocks.is_formula_bytes(c).alias("formula_bytes"), blocks.is_caption(c).alias("caption"), blocks.is_list_item(own).alias("list_item"),
        blocks.is_line_numbers(c).alias("line_numbers"), blocks.should_translate(own).alias("translate_block"),
        blocks.is_translatable_block(c, F.lit("paragraph"), F.col("x"), F.col("y"), F.col("width")).alias("translatable"),
    )


NUM = r"regexp_extract(t, '^[0-9A-Z][0-9.A-Z]{0,14}')"
NUMBERED = rf"""(regexp_matches(lower(t), '^({"|".join(blocks.PARSED_HEADINGS)})') OR (num <> '' AND strlen(t) >= 2 AND (
    (contains(num, '.') AND regexp_matches(rest, '^[ \t]') AND strlen({trimmed('rest')}) < 80)
    OR (NOT contains(num, '.') AND regexp_matches(rest, '^[.)][ \t]') AND strlen({trimmed('substr(rest, 2)')}) < 80))))"""
FORMULA_P = rf"""((({n('t', r'[-+*/=<>^_~()\[\]{}]')} + {n('t', f'[{SYM}]')}) / length(t) > 0.3)
    OR (contains(t, '=') AND regexp_matches(t, '[(+-]') AND {n('t', r'\S+')} <= 5 AND strlen(t) < 100) OR regexp_matches(t, '{blocks.BIG}') OR ({n('t', '[_^]')} > 2 AND strlen(t) < 100))"""
FORMULA_G = rf"""(({n('t', f'[-+*/=<>^_{SYM}{SCR}]')} / length(t) > 0.25) OR regexp_matches(t, '{blocks.BIG}') OR regexp_matches(t, '[{SCR}]')
    OR (contains(t, '=') AND regexp_matches(t, '[()]') AND strlen(t) < 50 AND {n('t', '[A-Za-z]')} < 10 AND {n('t', f'[-+*/=<>^_{SYM}{SCR}]')} > 2))"""
AT = " OR ".join(
    rf"""(regexp_matches(t, '(?s)^[0-9A-Z].{{{i - 1}}}[.)][ \t]') AND strlen({trimmed(f'substr(t, {i + 2})')}) < 80 AND NOT suffix({trimmed(f'substr(t, {i + 2})')}, '.'))"""
    for i in range(1, 10)
)


@query(rf"""
SELECT doc_id, pos,
  CASE WHEN t = '' THEN 'paragraph' WHEN {FORMULA_P} THEN 'formula'
    WHEN {NUMBERED} OR (is_bold AND strlen(t) < 100 AND (font_size > 12 OR (regexp_matches(t, '\pL') AND NOT regexp_matches(t, '[\p{{Ll}}\p{{Lo}}\p{{Lt}}\p{{Lm}}]') AND strlen(t) > 2)))
      OR (font_size > 12 AND strlen(t) < 100 AND NOT contains(t, '.')) THEN 'heading'
    WHEN regexp_matches(lower(t), '^(figure|table|fig\.|tab\.|图|表)') THEN 'caption'
    WHEN regexp_matches(t, '^[0-9]') AND strlen(t) < 200 AND contains(t, '.') AND NOT suffix(t, '.') THEN 'footnote'
    WHEN strlen(t) >= 2 AND (regexp_matches(t, '^[•◦▪▫●○■□*–—-]') OR regexp_matches(t, '(?s)^[0-9a-z][).].') OR (regexp_matches(t, '(?s)^\(.(\)|.\))') AND strlen(t) >= 3)) THEN 'list_item'
    ELSE 'paragraph' END AS parsed_type,
  CASE WHEN t = '' THEN 'paragraph' WHEN {FORMULA_G} THEN 'formula' WHEN regexp_matches(lower(t), '^(figure|table|fig\.|tab\.|图|表)') THEN 'caption'
    WHEN regexp_matches(lower(t), '^(?:{blocks.GLYPH_HEADINGS})') OR regexp_matches(lower(t), ' (?:{blocks.GLYPH_HEADINGS})') OR {AT}
      OR (is_bold AND strlen(t) < 100 AND font_size > 12) THEN 'heading' ELSE 'paragraph' END AS glyph_type
FROM (SELECT *, {NUM} AS num, substr(t, length({NUM}) + 1) AS rest FROM (SELECT *, {BT} AS t FROM blocks))
""")
def block_types(t):
    args = F.col("t"), F.col("font_size"), F.col("is_bold")
    return t.blocks.withColumn("t", text.strip(F.col("text"))).select("doc_id", "pos", blocks.block_type_parsed(*args).alias("parsed_type"), blocks.block_type_glyph(*args).alias("glyph_type"))


@query(rf"""
SELECT doc_id, pos, CASE WHEN p = '' OR c = '' OR right(p, 1) = '-' OR regexp_matches(left(c, 1), '^[,.;:)\]}}'']') OR regexp_matches(right(p, 1), '[(\[{{]$')
    OR regexp_matches(p, '^[a-z]$') OR regexp_matches(c, '^[a-z]$') THEN false
  WHEN regexp_matches(p, '^[a-z]{{2}}$') AND regexp_matches(left(c, 1), '^[a-z]') AND p NOT IN ({", ".join(repr(w) for w in blocks.SHORT_WORDS)}) THEN false
  ELSE strlen(p) >= 2 AND strlen(c) >= 2 END AS boundary
FROM (SELECT doc_id, pos, w AS c, coalesce(lag(w) OVER (PARTITION BY doc_id ORDER BY pos), '') AS p
  FROM (SELECT doc_id, pos, string_split(text, ' ')[1] AS w FROM blocks))
""")
def fragment_boundaries(t):
    first = t.blocks.select("doc_id", "pos", F.get(F.split("text", " ", -1), F.lit(0)).alias("c"))
    w = W.partitionBy("doc_id").orderBy("pos")
    pairs = first.withColumn("p", F.coalesce(F.lag("c").over(w), F.lit("")))
    return pairs.select("doc_id", "pos", blocks.is_word_boundary(F.col("p"), F.col("c")).alias("boundary"))


@query(rf"""
SELECT doc_id, pos, w AS string_width, total AS total_chars, 0::BIGINT AS wide_chars, blank AS space_chars, 0::BIGINT AS newline_chars, total - blank AS latin_chars,
  CASE WHEN total = 0 THEN NULL ELSE ((total - blank) * 0.5::DOUBLE + blank * 0.25::DOUBLE) / total END AS avg_width,
  CASE WHEN total = 0 OR total * 0.5 * font_size <= 150 THEN font_size ELSE greatest(font_size * (150 / (total * 0.5::DOUBLE * font_size)), 6.0::DOUBLE) END AS shrunk
FROM (SELECT *, length(text) AS total, {n('text', '[ \t]')} AS blank, ({n('text', '[ \t]')} * 0.25::DOUBLE + (length(text) - {n('text', '[ \t]')}) * 0.5::DOUBLE) * font_size AS w FROM blocks)
""")
def text_widths(t):
    c, size = F.col("text"), F.col("font_size")
    metrics = geometry.text_metrics(c)
    return t.blocks.select(
        "doc_id", "pos", geometry.string_width(c, size).alias("string_width"), *[v.alias(k) for k, v in metrics.items()],
        geometry.shrink_to_width(c, size, F.lit(150.0), F.lit(20.0)).alias("shrunk"),
    )


WRAP = """list_reduce(list_transform(list_filter(string_split(text, ''), lambda c: c <> '' AND c <> chr(13)), lambda c: {'lines': CASE WHEN c = chr(10) THEN 1::BIGINT ELSE 0 END,
  'used': CASE WHEN c IN (' ', chr(9)) THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END * font_size}), lambda a, q: {'lines': a.lines + CASE WHEN q.lines = 1 OR a.used + q.used > 200 THEN 1::BIGINT ELSE 0 END,
  'used': CASE WHEN q.lines = 1 THEN 0::DOUBLE WHEN a.used + q.used > 200 THEN q.used ELSE a.used + q.used END}, {'lines': 1::BIGINT, 'used': 0::DOUBLE}).lines"""


@query(rf"""
SELECT doc_id, pos, l AS lines, l <= greatest(floor(60 / (font_size * 1.2::DOUBLE)), 1) AND ({n('text', '[ 	]')} * 0.25::DOUBLE + (length(text) - {n('text', '[ 	]')}) * 0.5::DOUBLE) * font_size / l <= 200 AS fits
FROM (SELECT *, {WRAP} AS l FROM blocks)
""")
def text_wrapping(t):
    c, size = F.col("text"), F.col("font_size")
    rows = t.blocks.withColumn("lines", geometry.lines_needed(c, size, F.lit(200.0)))
    return rows.select("doc_id", "pos", "lines", geometry.fits_bounds(c, size, F.lit(200.0), F.lit(60.0), lines=F.col("lines")).alias("fits"))


CLS = "(['title', 'text', 'page_footer', 'picture', 'caption', 'table', 'caption', 'footnote', 'formula', 'caption'])"


@query(rf"""
SELECT doc_id, element, coalesce({CLS}[CAST(class_id + 1 AS INTEGER)], 'text') AS class_name,
  CAST(CASE type WHEN 'title' THEN 100 WHEN 'section_header' THEN 90 WHEN 'text' THEN 80 WHEN 'caption' THEN 70 WHEN 'list_item' THEN 60 WHEN 'footnote' THEN 50 ELSE 0 END AS BIGINT) AS priority,
  type NOT IN ('formula', 'picture', 'table', 'page_header', 'page_footer') AS translatable,
  x * 2 AS px, y * 3 AS py, x - 72 AS dx, y - 700 AS dy, abs(x - 72) < 10 AND abs(y - 700) < 10 AS near,
  x >= 0 AND y >= 0 AND width >= 0 AND height >= 0 AND page > 0 AS valid,
  x < 0 OR y < 0 OR x + width > 600 OR y + height > 842 OR confidence < 0 OR confidence > 1 OR class_id < 0 AS out_of_range
FROM layout_elements
""")
def layout_functions(t):
    b = geometry.box()
    return t.layout_elements.select(
        "doc_id", "element", geometry.class_name(F.col("class_id")).alias("class_name"), geometry.priority(F.col("type")).alias("priority"),
        geometry.is_translatable_kind(F.col("type")).alias("translatable"), (b["x"] * 2).alias("px"), (b["y"] * 3).alias("py"),
        (b["x"] - 72).alias("dx"), (b["y"] - 700).alias("dy"), geometry.within_tolerance(b["x"] - 72, b["y"] - 700, 0).alias("near"),
        geometry.valid_block(F.col("page"), F.lit("x"), F.col("type"), b).alias("valid"),
        checks.detection_out_of_range(b, F.col("confidence"), F.col("class_id"), 600, 842).alias("out_of_range"),
    )


@query(r"""
SELECT doc_id, strftime(translated_at, '%Y-%m-%d %H:%M') AS shown, epoch_ms(translated_at) AS millis,
  least(30, 2 * CAST(pow(2, doc_id % 8) AS BIGINT)) AS backoff,
  CASE WHEN doc_id % 10 = 0 THEN -1 ELSE CAST(trunc(epoch(translated_at - TIMESTAMP '2024-01-15 00:00:00') / 86400) AS BIGINT) END AS days_left,
  CASE WHEN doc_id % 10 = 0 THEN true ELSE TIMESTAMP '2024-01-15 00:00:00' > translated_at END AS expired
FROM papers
""")
def date_functions(t):
    d, ts = F.col("doc_id"), F.col("translated_at")
    now = F.lit("2024-01-15 00:00:00").cast("timestamp")
    stamp = F.when(d % 10 == 0, F.when(d % 20 == 0, "not a time").otherwise("")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return t.papers.select(
        "doc_id", F.date_format(ts, "yyyy-MM-dd HH:mm").alias("shown"), F.unix_millis(ts).alias("millis"), checks.backoff_seconds(d % 8 + 1).alias("backoff"),
        checks.days_until_expiry(stamp, now).alias("days_left"), checks.is_expired(stamp, now).alias("expired"),
    )


@query(rf"""
SELECT doc_id, line_no, regexp_matches(line, '^[ \t]*%') AS is_comment,
  regexp_replace(line, '(?s)^((?:[^%\\]|\\.)*)%.*$', '\1') AS uncommented,
  CASE WHEN strpos(line, '%') = 0 THEN -1 ELSE CASE WHEN length(cut) < length(line) THEN length(cut) ELSE -1 END END AS percent_at,
  CASE WHEN starts_with({trimmed('line')}, '%') THEN CASE WHEN regexp_matches(upper(line), 'TODO|FIXME|NOTE|XXX|HACK|BUG|WARNING') THEN line ELSE '' END
    WHEN cut = line THEN line ELSE regexp_replace(cut, '[ \t]+$', '') END AS stripped,
  regexp_matches(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '\\label\{{[^}}]*\}}', '', 'g'),
    '\\(?:ref|eqref|pageref|autoref|cref|Cref)\{{[^}}]*\}}', '', 'g'), '\\cite\w*(\[[^\]]*\])*\{{[^}}]*\}}', '', 'g'), '\$[^$]+\$', '', 'g'),
    '\\(?:textbf|textit|texttt|emph)\{{([^}}]*)\}}', '\1', 'g'), '[a-zA-Z]') AS translatable,
  regexp_extract_all(line, '\\(begin|end)\{{([^}}]+)\}}') AS tags
FROM (SELECT *, regexp_replace(line, '(?s)^((?:[^%\\]|\\.)*)%.*$', '\1') AS cut FROM tex_lines)
""")
def markup_line_functions(t):
    c = F.col("line")
    return t.tex_lines.select(
        "doc_id", "line_no", tex.is_comment(c).alias("is_comment"), tex.cut_comment(c).alias("uncommented"), tex.percent_position(c).alias("percent_at"),
        tex.strip_line_comment(c).alias("stripped"), tex.has_translatable_text(c).alias("translatable"), tex.env_tags(c).alias("tags"),
    )


PLAIN = r"replace(replace({0}, '\{{', ''), '\}}', '')"
UNCOMMENTED = r"regexp_replace(text, '(?m)^[ \t]*%.*$', '', 'g')"
CUT = r"array_to_string(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(l, '(?s)^((?:[^%\\]|\\.)*)%.*$', '\1')), chr(10))"


def braces(c: str, b: str) -> str:
    return f"length({PLAIN.format(c)}) - length(replace({PLAIN.format(c)}, '{b}', ''))"


@query(rf"""
SELECT doc_id, {braces('u', '{')} AS open_braces, {braces('u', '}')} AS close_braces, ({braces('u', '{')}) - ({braces('u', '}')}) AS difference,
  {braces('c', '{')} AS open_inline, {braces('c', '}')} AS close_inline,
  {n("regexp_replace(text, '(?m)%.*$', '', 'g')", '[{]')} AS open_plain, {n("regexp_replace(text, '(?m)%.*$', '', 'g')", '[}]')} AS close_plain
FROM (SELECT *, {UNCOMMENTED} AS u, {CUT} AS c FROM tex)
""")
def brace_counts(t):
    c = F.col("text")
    (o, e), (oi, ei), (op, ep) = tex.brace_counts(c), tex.brace_counts_inline(c), tex.brace_counts_plain(c)
    return t.tex.select(
        "doc_id", o.alias("open_braces"), e.alias("close_braces"), (o - e).alias("difference"), oi.alias("open_inline"), ei.alias("close_inline"), op.alias("open_plain"), ep.alias("close_plain")
    )


LINES = "string_split(text, chr(10))"
DEF = rf"^\\({'|'.join(tex.DEFINITIONS)})"
TABLE = "|".join("\\\\" + m.replace("{", r"\{") for m in tex.TABLE_MARKS)
NOTBLANK = "t <> '' AND NOT starts_with(t, '%')"
IS_TABLE = rf"(regexp_matches(t, '{TABLE}') OR starts_with(t, '&') OR suffix(t, '\\'))"


@query(rf"""
WITH l AS (SELECT doc_id, unnest(list_transform({LINES}, lambda x: {trimmed('x')})) AS t FROM tex),
k AS (SELECT doc_id, CASE WHEN NOT ({NOTBLANK}) THEN NULL WHEN regexp_matches(t, '{DEF}') THEN 'definition' WHEN {IS_TABLE} THEN 'table'
    WHEN regexp_matches(t, '^[\\{{}}&$]') THEN 'markup' WHEN {n('t', '[a-zA-Z]{3,}')} >= 3 THEN 'prose' ELSE 'other' END AS class,
    CASE WHEN NOT ({NOTBLANK}) THEN NULL ELSE starts_with(t, '\') OR regexp_matches(t, '\\(?:draw|node|path|coordinate|fill|shade)') OR NOT regexp_matches(t, '[a-zA-Z]') END AS code FROM l),
c AS (SELECT doc_id, count(*) FILTER (class = 'prose') AS prose, count(*) FILTER (class = 'table') AS tab, count(*) FILTER (class = 'definition') AS def,
    count(*) FILTER (code) AS code, count(code) AS said FROM k GROUP BY doc_id)
SELECT doc_id, NOT ((contains(text, '\begin{{table') OR contains(text, '\begin{{tabular')) AND prose < 5)
    AND NOT (CASE WHEN tab + def + prose = 0 THEN 0 ELSE (tab + def) / (tab + def + prose) END > 0.8 AND prose < 5) AND prose >= 3 AS needs_translation,
  CASE WHEN said = 0 THEN true ELSE code / said > 0.8 END AS mostly_code,
  regexp_extract(text, '\\documentclass(?:\[[^\]]*\])?\{{([^}}]+)\}}', 1) AS class,
  {n('text', r'\\(?:section|subsection|subsubsection|chapter)\s*[\[{]')} AS major_sections,
  false AS unicode_compiler, contains(text, '\citation{{') OR contains(text, '\bibdata{{') AS bibliography
FROM tex JOIN c USING (doc_id)
""")
def document_predicates(t):
    c = F.col("text")
    return t.tex.select(
        "doc_id", tex.needs_translation(c).alias("needs_translation"), tex.is_mostly_code(c).alias("mostly_code"), tex.document_class(c).alias("class"),
        tex.major_section_count(c).alias("major_sections"), tex.needs_unicode_compiler(c).alias("unicode_compiler"), tex.needs_bibliography(c).alias("bibliography"),
    )


@query(r"""
SELECT event_id, error_msg,
  regexp_matches(m, 'rate limit|status 5|server error|connection|timeout|network|EOF|reset by peer') AND NOT regexp_matches(m, 'authentication failed|invalid API key|unauthorized|invalid API request') AS retryable,
  regexp_matches(m, 'status 5') AS retryable_call
FROM (SELECT event_id, error_msg, error_msg || (['', ' timeout', ' rate limit', ' unauthorized timeout', ' status 503'])[CAST(event_id % 5 AS INTEGER) + 1] AS m FROM err_events)
""")
def retry_predicates(t):
    tail = F.element_at(F.array(*[F.lit(x) for x in ("", " timeout", " rate limit", " unauthorized timeout", " status 503")]), (F.col("event_id") % 5 + 1).cast("int"))
    m = F.concat("error_msg", tail)
    return t.err_events.select(
        "event_id", "error_msg", checks.is_retryable(F.lit(""), m).alias("retryable"), checks.is_retryable_call(F.lit("API_CALL"), m).alias("retryable_call")
    )


@query(r"""
SELECT doc_id, 1000 * (doc_id % 130) - 2000 AS max_chunk_size, list_filter([
  CASE WHEN s <= 0 THEN 'max_chunk_size must be greater than 0' WHEN s > 100000 THEN 'max_chunk_size must not exceed 100000' END,
  CASE WHEN o < 0 THEN 'chunk_overlap must be non-negative' WHEN o >= s THEN 'chunk_overlap must be less than max_chunk_size' END,
  CASE WHEN lo <= 0 THEN 'min_length_ratio must be greater than 0' WHEN lo >= 1 THEN 'min_length_ratio must be less than 1.0' END,
  CASE WHEN hi <= 1 THEN 'max_length_ratio must be greater than 1.0' WHEN hi > 100 THEN 'max_length_ratio must not exceed 100.0' END,
  CASE WHEN lo >= hi THEN 'min_length_ratio must be less than max_length_ratio' END,
  CASE WHEN h < 0 THEN 'min_chinese_ratio must be non-negative' WHEN h > 1 THEN 'min_chinese_ratio must not exceed 1.0' END], lambda e: e IS NOT NULL) AS errors
FROM (SELECT doc_id, 1000 * (doc_id % 130) - 2000 AS s, doc_id % 7 * 1000 - 1000 AS o, (doc_id % 12 - 1) / 10.0::DOUBLE AS lo, doc_id % 5 * 30.0::DOUBLE AS hi, (doc_id % 14 - 1) / 10.0::DOUBLE AS h FROM documents)
""")
def option_validation(t):
    d = F.col("doc_id")
    options = {
        "max_chunk_size": 1000 * (d % 130) - 2000, "chunk_overlap": d % 7 * 1000 - 1000, "min_length_ratio": (d % 12 - 1) / 10.0,
        "max_length_ratio": d % 5 * 30.0, "min_chinese_ratio": (d % 14 - 1) / 10.0,
    }
    return t.documents.select("doc_id", options["max_chunk_size"].alias("max_chunk_size"), checks.option_errors(options).alias("errors"))


@query(r"""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 4000 ELSE doc_id % 3 * 100 END AS max_chunk_size, CASE WHEN doc_id % 4 = 0 THEN 0.3::DOUBLE ELSE doc_id % 4 * 1.0::DOUBLE END AS min_length_ratio
FROM documents
""")
def option_merge(t):
    d = F.col("doc_id")
    base = {"max_chunk_size": F.lit(4000).cast("long"), "min_length_ratio": F.lit(0.3)}
    over = {"max_chunk_size": d % 3 * 100, "min_length_ratio": d % 4 * 1.0}
    return t.documents.select("doc_id", *[v.alias(k) for k, v in checks.merge_options(base, over).items()])


@query(r"""
SELECT doc_id, 'md5 ' || md5(text) AS digest, 'gzip' AS gz, 'zip' AS zp, CAST(NULL AS VARCHAR) AS other, true AS bom, strlen(text) AS without_bom FROM documents
""")
def byte_functions(t):
    c = F.encode("text", "UTF-8")
    head = lambda h: F.concat(F.unhex(F.lit(h)), c)
    return t.documents.select(
        "doc_id", F.concat(F.lit("md5 "), F.md5(c)).alias("digest"), text.sniff_archive(head("1F8B08")).alias("gz"), text.sniff_archive(head("504B0304")).alias("zp"),
        text.sniff_archive(head("00")).alias("other"), text.utf8_bom(head("EFBBBF")).alias("bom"), F.octet_length(text.strip_bom(head("EFBBBF"))).alias("without_bom"),
    )


# The search for a font size by recursion over its halvings, each a fold over the characters' widths.
FONT_SIZES = r"""WITH RECURSIVE shares AS (SELECT doc_id, pos, list_transform(regexp_extract_all(replace(text, chr(13), ''), '(?s).'), lambda c: CAST(CASE WHEN c = chr(10) THEN -1.0
  WHEN regexp_matches(c, '[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{F900}-\x{FAFF}\x{3000}-\x{303F}]') THEN 1.0 WHEN c IN (' ', chr(9)) THEN 0.25 ELSE 0.5 END AS DOUBLE)) AS chars FROM blocks),
halves AS (
  SELECT doc_id, pos, chars, 6.0::DOUBLE AS low, 72.0::DOUBLE AS high, 6.0::DOUBLE AS best FROM shares
  UNION ALL
  SELECT doc_id, pos, chars, CASE WHEN ok THEN m + 0.5::DOUBLE ELSE low END, CASE WHEN ok THEN high ELSE m - 0.5::DOUBLE END, CASE WHEN ok THEN m ELSE best END
  FROM (SELECT *, a.lines <= greatest(1, CAST(trunc(60.0::DOUBLE / (m * 1.2::DOUBLE)) AS BIGINT)) AND a.total / a.lines <= 200 AS ok FROM (
    SELECT *, list_reduce([{'lines': 1::BIGINT, 'used': 0.0::DOUBLE, 'total': 0.0::DOUBLE}] || list_transform(chars, lambda c: {'lines': 0::BIGINT, 'used': c, 'total': c}),
      lambda a, x: CASE WHEN x.used < 0 THEN {'lines': a.lines + 1, 'used': 0.0::DOUBLE, 'total': a.total}
        WHEN a.used + x.used * m > 200 THEN {'lines': a.lines + 1, 'used': x.used * m, 'total': a.total + x.used * m}
        ELSE {'lines': a.lines, 'used': a.used + x.used * m, 'total': a.total + x.used * m} END) AS a
    FROM (SELECT *, (low + high) / 2 AS m FROM halves WHERE high - low >= 0.5))))
SELECT doc_id, pos, best AS size FROM halves WHERE high - low < 0.5"""


@query(FONT_SIZES)
def font_fitting(t):
    return t.blocks.select("doc_id", "pos", geometry.font_size(F.col("text"), 200.0, 60.0).alias("size"))
