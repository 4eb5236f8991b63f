"""Queries of ordered folds, set functions and nested values."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspan.functions import nested
from inkspan.functions.rules import spans
from inkspan.operators import rules
from inkspan.plans.catalog import query

SPANS = "SELECT doc_id, pos, (pos * 7 + doc_id) % 50 AS s, (pos * 7 + doc_id) % 50 + 1 + (pos * 5 + doc_id) % 9 AS e FROM blocks"


def intervals(t):
    d, p = F.col("doc_id"), F.col("pos")
    start = (p * 7 + d) % 50
    return t.blocks.select("doc_id", "pos", start.alias("s"), (start + 1 + (p * 5 + d) % 9).alias("e"))


@query(f"""
WITH RECURSIVE i AS ({SPANS}),
r AS (SELECT doc_id, 0 AS k, CAST(-1 AS BIGINT) AS last, CAST(-1 AS BIGINT) AS s FROM (SELECT DISTINCT doc_id FROM i)
  UNION ALL SELECT doc_id, k + 1, n.e, n.s FROM (SELECT r.doc_id, r.k, (SELECT min((i.s, -i.e)) FROM i WHERE i.doc_id = r.doc_id AND i.s >= r.last AND (r.k = 0 OR i.s > r.s)) AS m FROM r) q,
    LATERAL (SELECT m[1] AS s, -m[2] AS e) n WHERE m IS NOT NULL)
SELECT doc_id, s AS start, last AS stop FROM r WHERE k > 0
""".replace("min((i.s, -i.e))", "min([i.s, -i.e])"))
def interval_deoverlap(t):
    return nested.keep_disjoint(intervals(t), "doc_id", "s", "e")


@query(f"""
WITH i AS ({SPANS}) SELECT a.doc_id, a.pos, min(b.pos) IS NOT NULL AS is_nested, min(b.pos) AS parent
FROM i a LEFT JOIN i b ON a.doc_id = b.doc_id AND b.s < a.s AND b.e > a.e GROUP BY a.doc_id, a.pos
""")
def nested_intervals(t):
    return nested.mark_nested(intervals(t), "doc_id", "pos", "s", "e")


@query("""
SELECT doc_id, list_distinct(l) IS NOT NULL AS has, len(list_distinct(l)) AS n, list_has_any(l[1:5], ['the', 'der', 'la']) AS shares, len(list_filter(list_distinct(l), lambda x: NOT list_contains(['the', 'of'], x))) AS rest
FROM (SELECT doc_id, string_split(lower(text), ' ') AS l FROM documents)
""")
def array_sets(t):
    w = F.split(F.lower("text"), " ", -1)
    known = F.array(F.lit("the"), F.lit("der"), F.lit("la"))
    return t.documents.select(
        "doc_id", F.array_distinct(w).isNotNull().alias("has"), F.size(F.array_distinct(w)).alias("n"), F.arrays_overlap(F.slice(w, 1, 5), known).alias("shares"),
        F.size(F.array_except(w, F.array(F.lit("the"), F.lit("of")))).alias("rest"),
    )


@query("""
SELECT doc_id, [k FOR k IN ['<<<LATEX_CMD_2>>>', '<<<LATEX_CMD_10>>>', '<<<LATEX_CMD_1>>>'] IF CAST(regexp_extract(k, '(\\d+)>', 1) AS INTEGER) % 3 <> doc_id % 3] AS missing,
  'x \\alpha z' AS restored, 'b2' AS merged FROM documents
""".replace("['<<<LATEX_CMD_2>>>', '<<<LATEX_CMD_10>>>', '<<<LATEX_CMD_1>>>']", "['<<<LATEX_CMD_1>>>', '<<<LATEX_CMD_2>>>', '<<<LATEX_CMD_10>>>']"))
def placeholder_maps(t):
    d = F.col("doc_id")
    keys = [f"<<<LATEX_CMD_{i}>>>" for i in (2, 10, 1)]
    present = F.concat_ws(" ", *[F.when(F.lit(i % 3) == d % 3, F.lit(f"<<<LATEX_CMD_{i}>>>")) for i in (2, 10, 1)])
    made = F.create_map(*[x for k in keys for x in (F.lit(k), F.lit("v"))])
    one = F.create_map(F.lit("<<<LATEX_CMD_0>>>"), F.lit("\\alpha"))
    both = nested.merge_maps(F.create_map(F.lit("a"), F.lit("b1")), F.create_map(F.lit("a"), F.lit("b2")))
    return t.documents.select(
        "doc_id", nested.by_number(nested.missing_keys(made, present)).alias("missing"), nested.restore(F.lit("x <<<LATEX_CMD_0>>> z"), one).alias("restored"),
        F.element_at(both, "a").alias("merged"),
    )


@query("SELECT doc_id, count(*) AS chunks, CAST(sum(strlen(line)) AS BIGINT) AS tokens, string_agg(line, '' ORDER BY line_no) AS text FROM doc_lines GROUP BY doc_id")
def chunk_reduction(t):
    return nested.reduce_chunks(t.doc_lines.withColumn("tokens", F.octet_length("line")), "doc_id", "line_no", "line", "tokens")


@query("""
SELECT (['a', 'b', 'c', 'd', 'failed'])[CAST(doc_id % 5 AS INTEGER) + 1] AS strategy, count(*) AS attempts, count(*) FILTER (doc_id % 5 < 4) AS recovered, count(*) FILTER (doc_id % 5 = 4) AS failed FROM documents GROUP BY 1
""")
def recovery_report(t):
    names = F.array(*[F.lit(x) for x in ("a", "b", "c", "d", "failed")])
    rows = t.documents.select(F.element_at(names, (F.col("doc_id") % 5 + 1).cast("int")).alias("strategy"), (F.col("doc_id") % 5 < 4).alias("success"))
    return nested.recovery_report(rows)


@query("SELECT category, count(*) AS papers FROM (SELECT 'cat' || doc_id % 64 AS category FROM papers) GROUP BY category")
def category_dimension(t):
    named = t.papers.select(F.concat(F.lit("cat"), (F.col("doc_id") % 64).cast("string")).alias("category"))
    return named.join(F.broadcast(nested.categories(t.spark, 64)), "category", "left_semi").groupBy("category").agg(F.count("*").alias("papers"))


@query(r"""
SELECT doc_id, element, x * 100 AS x, y * 200 AS y, w AS class_id FROM (SELECT doc_id, pos AS element, (pos % 8) / 8.0::DOUBLE AS x, (pos % 4) / 4.0::DOUBLE AS y, pos % 12 AS w FROM blocks)
""")
def detector_output(t):
    d = F.col("pos")
    one = F.array((d % 8) / 8.0, (d % 4) / 4.0, F.lit(0.1), F.lit(0.1), F.lit(0.5), (d % 12).cast("double"))
    flat = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(d.alias("p"), one.alias("v")))), lambda s: s["v"]))
    raw = t.blocks.groupBy("doc_id").agg(flat.alias("output"))
    return nested.parse_detections(raw, 100, 200).select("doc_id", "element", "x", "y", "class_id")


@query(r"""
WITH p AS (SELECT doc_id, regexp_split_to_array(text, '\\(begin|end)\{([^}]+)\}') AS pieces, regexp_extract_all(text, '\\(begin|end)\{([^}]+)\}') AS tags FROM tex),
l AS (SELECT doc_id, tags, list_transform(pieces, lambda x: length(x)) AS n, list_transform(pieces, lambda x: length(x) - length(replace(x, chr(10), ''))) AS k, list_transform(tags, lambda x: length(x)) AS m FROM p)
SELECT doc_id, tags[i] AS tag, CAST(list_sum(n[1:i]) + coalesce(list_sum(m[1:i - 1]), 0) AS BIGINT) AS position, CAST(1 + list_sum(k[1:i]) AS BIGINT) AS line
FROM (SELECT *, unnest(range(1, len(tags) + 1)) AS i FROM l)
""")
def structure_spans(t):
    """Environment tags with their 0-based character position and 1-based line."""
    return rules.explode_rule(t.tex, "doc_id", "text", spans.tags, "tag string, position bigint, line bigint")


@query("""
SELECT arxiv_id, min(doc_id) AS first FROM (SELECT *, doc_id % 7 AS search FROM papers) GROUP BY arxiv_id ORDER BY arxiv_id LIMIT 1000
""")
def harvest_distinct(t):
    """Entries of several searches, one per identifier, up to the harvest's target of 1,000."""
    return t.papers.groupBy("arxiv_id").agg(F.min("doc_id").alias("first")).orderBy("arxiv_id").limit(1000)


@query("SELECT doc_id % 50 AS base, list(name ORDER BY name DESC) AS backups FROM (SELECT doc_id, 'b' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS name FROM papers) GROUP BY 1")
def backup_listing(t):
    named = t.papers.select((F.col("doc_id") % 50).alias("base"), F.concat(F.lit("b"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("name"))
    return named.groupBy("base").agg(F.sort_array(F.collect_list("name"), asc=False).alias("backups"))


@query("""
SELECT doc_id, '<<<LATEX_' || (['CMD', 'MATH', 'TABLE'])[CAST(doc_id % 3 AS INTEGER) + 1] || '_' || doc_id || '>>>' AS placeholder, (['CMD', 'MATH', 'TABLE'])[CAST(doc_id % 3 AS INTEGER) + 1] AS type FROM documents
""")
def placeholder_generation(t):
    d = F.col("doc_id")
    kind = F.element_at(F.array(F.lit("CMD"), F.lit("MATH"), F.lit("TABLE")), (d % 3 + 1).cast("int"))
    made = nested.placeholder(kind, d)
    info = F.create_map(made, kind)
    return t.documents.select("doc_id", made.alias("placeholder"), F.element_at(info, made).alias("type"))
