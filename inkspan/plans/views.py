"""Derived tables over the driver's data, in Spark and in SQL with the same arithmetic.

The data hold no mark-up, page geometry or logs, so these views lay them over
the documents' lines. ``sql`` resolves the views a query names into a WITH clause.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATES = ["pending", "downloading", "extracted", "original_compiled", "translating", "translated", "compiling", "complete", "error"]
SOURCES = ["arxiv", "zip", "pdf"]
STAGES = ["download", "extract", "original_compile", "translation", "translated_compile", "pdf_generation", "page_count_mismatch"]
ENVIRONMENTS = ["figure", "table", "itemize", "equation", "proof"]
CATEGORIES = 64


def _pick(names: list[str], at):
    return F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod(at, F.lit(len(names))) + 1).cast("int"))


def _sql_pick(names: list[str], at: str) -> str:
    return f"([{', '.join(repr(n) for n in names)}])[CAST(({at}) % {len(names)} AS INTEGER) + 1]"


def text(c):
    return c.cast("string")


class Tables:
    """Base tables by name, and the derived views, each read when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def papers(self) -> DataFrame:
        d = F.col("doc_id")
        return self.documents.select(
            "doc_id",
            F.concat(F.lpad(text(2301 + d % 12), 4, "0"), F.lit("."), F.lpad(text(d), 5, "0")).alias("arxiv_id"),
            F.concat(F.lit("paper "), text(d)).alias("title"),
            _pick(STATES, d).alias("status"),
            _pick(SOURCES, d).alias("source_type"),
            F.md5("text").alias("source_md5"),
            F.timestamp_add("MINUTE", d, F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("translated_at"),
            F.when(d % 9 == 8, F.concat(F.lit("failed "), text(d))).otherwise("").alias("error_message"),
        )

    @cached_property
    def doc_lines(self) -> DataFrame:
        return self.documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).withColumn(
            "line_no", F.col("line_no").cast("long")
        )

    @staticmethod
    def tex_line(d, n, line):
        """A line of a document as a line of mark-up."""
        k = d + n
        env = _pick(ENVIRONMENTS, k)
        begin = F.concat(F.when(k % 6 == 5, "% ").otherwise(""), F.lit("\\begin{"), env, F.lit("} "), line)
        return (
            F.when(n == 0, F.concat(F.lit("\\documentclass[11pt]{"), _pick(["article", "report", "book"], d), F.lit("}")))
            .when(k % 11 == 0, F.concat(F.lit("\\section{"), line, F.lit("}")))
            .when(k % 11 == 1, F.concat(F.lit("\\subsection*{"), line, F.lit("}")))
            .when(k % 11 == 2, F.concat(F.lit("\\cite{key"), text(k), F.lit("} "), line))
            .when(k % 11 == 3, F.concat(F.lit("\\label{lab"), text(k), F.lit("} "), line, F.lit(" \\ref{lab"), text(k + 1), F.lit("}")))
            .when(k % 11 == 4, F.concat(F.lit("\\usepackage[utf8]{amsmath, pkg"), text(k % 3), F.lit("}")))
            .when(k % 11 == 5, F.concat(F.lit("% todo "), line))
            .when(k % 11 == 6, F.concat(line, F.lit(" 5\\% x { y \\} % note }")))
            .otherwise(F.concat(begin, F.when(k % 7 == 0, "").otherwise(F.concat(F.lit(" \\end{"), env, F.lit("}")))))
        )

    @staticmethod
    def translated_line(d, n, line):
        """A line of mark-up as its translation has it."""
        k = d + n
        return (
            F.when((n == 0) & (d % 2 == 0), "\\documentclass[11pt]{ctexart}")
            .when(k % 4 == 0, F.regexp_replace(line, "^% ", ""))
            .when(k % 9 == 0, F.concat(line, F.lit(" \\end{figure}")))
            .when(k % 13 == 0, F.concat(line, F.lit("\\usepackage{ctex}")))
            .otherwise(line)
        )

    @cached_property
    def tex_lines(self) -> DataFrame:
        d, n = F.col("doc_id"), F.col("line_no")
        return self.doc_lines.select(d, n, self.tex_line(d, n, F.col("line")).alias("line"))

    @cached_property
    def tex_translated_lines(self) -> DataFrame:
        d, n = F.col("doc_id"), F.col("line_no")
        return self.tex_lines.select(d, n, self.translated_line(d, n, F.col("line")).alias("line"))

    @staticmethod
    def joined(lines: DataFrame) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
        return lines.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda s: s["line"]), "\n").alias("text"))

    @cached_property
    def tex(self) -> DataFrame:
        """Whole texts, line by line inside the row: nothing is exploded or shuffled."""
        d = F.col("doc_id")
        made = F.transform(F.split("text", "\n", -1), lambda line, n: self.tex_line(d, n.cast("long"), line))
        return self.documents.filter("text is not null").select(d, F.array_join(made, "\n").alias("text"))

    @cached_property
    def tex_pairs(self) -> DataFrame:
        d = F.col("doc_id")
        made = F.transform(F.split("original", "\n", -1), lambda line, n: self.translated_line(d, n.cast("long"), line))
        return self.tex.withColumnRenamed("text", "original").select(d, "original", F.array_join(made, "\n").alias("translated"))

    def damaged(self, head, line, tail) -> DataFrame:
        """``original`` and ``translated`` texts, line by line inside the row; the three give (sound, damaged) pieces."""
        d = F.col("doc_id")
        plain = lambda x: F.trim(F.regexp_replace(x, "[^A-Za-z0-9]+", " "))

        # A name inside a lambda is an expression each time it is used: the words of a line are made before, once.
        words = F.transform(F.split("text", "\n", -1), plain)

        def whole(side: int):
            lines = F.transform(words, lambda w, n: line(d + n.cast("long"), w)[side])
            return F.concat(head(d)[side], F.array_join(lines, "\n"), tail(d)[side])

        return self.documents.filter("text is not null").select(d, whole(0).alias("original"), whole(1).alias("translated"))

    @cached_property
    def cell_tables(self) -> DataFrame:
        """Every line of a document as a table row; four in five rows and a third of the captions have lost braces."""

        def row(k, w):
            cell = lambda a, b: F.concat(F.lit("\\multirow{2}{*}{\\textbf{"), w, F.lit(a + " & x & \\multicolumn{2}{c}{\\textit{"), w, F.lit(b + " \\\\"))
            return cell("}}", "}}"), F.when(k % 5 == 0, cell("", "}}")).when(k % 5 == 1, cell("}", "}}")).when(k % 5 == 2, cell("}}", "")).when(k % 5 == 3, cell("}}", "}")).otherwise(cell("}}", "}}"))

        head = lambda d: [F.concat(F.lit("\\begin{table}\n\\caption{Table "), text(d), close, F.lit("\n\\begin{tabular}{llll}\n")) for close in (F.lit("}"), F.when(d % 3 == 0, "").otherwise("}"))]
        return self.damaged(head, row, lambda d: [F.lit("\n\\end{tabular}\n\\end{table}")] * 2)

    @cached_property
    def crossed_groups(self) -> DataFrame:
        """Lines in nested braces and environments whose closers cross in the translation; every other document ends twice."""

        def block(k, w):
            sound = [["\\begin{center}\n\\scalebox{0.8}{\n", "\n}\n\\end{center}"], ["\\resizebox{1}{!}{\\begin{tabular}{l}", "\\end{tabular}}"], ["\\begin{center}\\textbf{\\begin{small}\\emph{", "}\\end{small}}\\end{center}"], ["", ""]]
            crossed = [["\\begin{center}\n\\scalebox{0.8}{\n\\end{center}\n", "\n}"], ["\\resizebox{1}{!}{\\begin{tabular}{l}", "}\\end{tabular}"], ["\\begin{center}\\textbf{\\begin{small}\\emph{", "}\\end{center}\\end{small}}"], ["", ""]]
            return [F.concat(_pick([a for a, _ in made], k), w, _pick([b for _, b in made], k)) for made in (sound, crossed)]

        end = "\n\\end{document}\n"
        tail = lambda d: [F.lit(end), F.when(d % 2 == 0, end + end[1:]).otherwise(end)]
        return self.damaged(lambda d: [F.lit("\\begin{document}\n")] * 2, block, tail)

    @cached_property
    def shifted_pairs(self) -> DataFrame:
        """Texts with a line put in before and behind, where a quarter of the lines has lost its comment sign."""
        d = F.col("doc_id")
        made = F.transform(F.split("original", "\n", -1), lambda x, n: F.when((d + n) % 4 == 0, F.regexp_replace(x, "^% ", "")).otherwise(x))
        return self.tex.withColumnRenamed("text", "original").select(d, "original", F.concat(F.lit("\\section{Inserted}\n"), F.array_join(made, "\n"), F.lit("\n\\section{Added}")).alias("translated"))

    @cached_property
    def blocks(self) -> DataFrame:
        d, n = F.col("doc_id"), F.col("line_no")
        return self.doc_lines.select(
            "doc_id",
            n.alias("pos"),
            (1 + F.floor(n / 20)).cast("long").alias("page"),
            (72 + F.pmod(d * 7 + n, F.lit(5)) * 100).cast("double").alias("x"),
            (800 - 12 * (n % 20) + (d + n) % 3).cast("double").alias("y"),
            (5.0 * F.length("line")).alias("width"),
            F.lit(10.0).alias("height"),
            (9 + F.pmod(d + n, F.lit(6))).cast("double").alias("font_size"),
            ((d + n) % 4 == 0).alias("is_bold"),
            F.when(n % 5 == 0, F.concat(text(1 + n / 5).substr(1, 1), F.lit(". "), "line")).otherwise(F.col("line")).alias("text"),
        )

    @cached_property
    def layout_elements(self) -> DataFrame:
        n = F.col("pos")
        kinds = ["text", "title", "picture", "caption", "section_header", "footnote", "formula", "table", "list_item", "unknown"]
        return self.blocks.filter(n % 3 == 0).select(
            "doc_id", "page", n.alias("element"), _pick(kinds, n).alias("type"),
            (F.col("x") + F.pmod(n, F.lit(4)) * 3).alias("x"), "y", (F.col("width") + 8).alias("width"), "height",
            (F.pmod(n, F.lit(16)) / 16.0).alias("confidence"), F.pmod(n, F.lit(12)).alias("class_id"),
        )

    @cached_property
    def repo_files(self) -> DataFrame:
        kind = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")
        rows = self.papers.select("doc_id", "arxiv_id", kind).filter((F.col("doc_id") + F.col("k")) % 3 != 0)
        stem = F.concat("arxiv_id", F.lit("_cat"), text(F.col("doc_id") % CATEGORIES))
        name = F.when(F.col("k") == 0, F.concat(stem, F.lit("_cn.pdf"))).when(F.col("k") == 1, F.concat(stem, F.lit("_bilingual.pdf"))).otherwise(F.concat(stem, F.lit(".zip")))
        return rows.select(name.alias("name"), F.lit("file").alias("type"), F.concat(F.lit("https://files.example/"), name).alias("download_url"))

    @cached_property
    def cache_entries(self) -> DataFrame:
        d = F.col("doc_id")
        rows = self.documents.filter(d % 2 == 0).groupBy("text").agg(F.min(d).alias("first"))
        translation = F.when(F.col("first") % 10 == 0, "").otherwise(F.concat(F.lit("T "), F.substring("text", 1, 40)))
        return rows.select(F.sha2("text", 256).alias("hash"), translation.alias("translation"))

    @cached_property
    def err_events(self) -> DataFrame:
        return self.events.filter("event_type = 'error'").select(
            text(F.col("user_id")).alias("id"), "event_id", "ts", _pick(STAGES, F.col("event_id")).alias("stage"),
            F.concat(F.lit("error | "), text(F.col("event_id"))).alias("error_msg"), (F.col("event_id") % 5 == 0).alias("is_retry"),
        )

    @cached_property
    def inputs(self) -> DataFrame:
        d = F.col("doc_id")
        pages = self.pages.select(F.col("page_id").alias("n"), F.col("url").alias("input"))
        ids = self.papers.select(d.alias("n"), F.col("arxiv_id").alias("input"))
        shapes = ["https://arxiv.org/abs/", "https://arxiv.org/pdf/", " http://ARXIV.org/x/", "cs-lg/", "/home/u/", "C:\\docs\\"]
        ends = ["", ".pdf", ".zip", "v2", "?x=1", "/", ".PDF "]
        made = self.papers.select((d + 1_000_000).alias("n"), F.concat(_pick(shapes, d), "arxiv_id", _pick(ends, d)).alias("input"))
        return pages.unionByName(ids).unionByName(made)

    @cached_property
    def include_edges(self) -> DataFrame:
        d = F.col("doc_id")
        return self.documents.select(F.explode(F.array(F.struct(d.alias("parent"), (d * 3 % 200).alias("child")), F.struct(d.alias("parent"), ((d * 5 + 1) % 200).alias("child"))))).select("col.*")

    @cached_property
    def log_lines(self) -> DataFrame:
        n, k = F.col("line_no"), F.col("doc_id") + F.col("line_no")
        made = (
            F.when(k % 11 == 0, F.concat(F.lit("(./f"), text(n), F.lit(".tex")))
            .when(k % 11 == 3, "! Undefined control sequence.")
            .when(k % 11 == 4, F.concat(F.lit("l."), text(n * 2), F.lit(" x")))
            .when(k % 11 == 7, "! LaTeX Error: File missing.")
            .when(k % 11 == 8, "Missing $ inserted")
            .otherwise(F.col("line"))
        )
        return self.doc_lines.select("doc_id", n, made.alias("line"))


K = "(doc_id + line_no)"
VIEWS = {
    "papers": f"""SELECT doc_id, lpad(CAST(2301 + doc_id % 12 AS VARCHAR), 4, '0') || '.' || lpad(CAST(doc_id AS VARCHAR), 5, '0') AS arxiv_id,
      'paper ' || doc_id AS title, {_sql_pick(STATES, 'doc_id')} AS status, {_sql_pick(SOURCES, 'doc_id')} AS source_type, md5(text) AS source_md5,
      TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id AS INTEGER)) AS translated_at,
      CASE WHEN doc_id % 9 = 8 THEN 'failed ' || doc_id ELSE '' END AS error_message FROM documents""",
    "doc_lines": """SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line
      FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""",
    "tex_lines": rf"""SELECT doc_id, line_no, CASE
      WHEN line_no = 0 THEN '\documentclass[11pt]{{' || {_sql_pick(['article', 'report', 'book'], 'doc_id')} || '}}'
      WHEN {K} % 11 = 0 THEN '\section{{' || line || '}}'
      WHEN {K} % 11 = 1 THEN '\subsection*{{' || line || '}}'
      WHEN {K} % 11 = 2 THEN '\cite{{key' || {K} || '}} ' || line
      WHEN {K} % 11 = 3 THEN '\label{{lab' || {K} || '}} ' || line || ' \ref{{lab' || ({K} + 1) || '}}'
      WHEN {K} % 11 = 4 THEN '\usepackage[utf8]{{amsmath, pkg' || ({K} % 3) || '}}'
      WHEN {K} % 11 = 5 THEN '% todo ' || line
      WHEN {K} % 11 = 6 THEN line || ' 5\% x {{ y \}} % note }}'
      ELSE CASE WHEN {K} % 6 = 5 THEN '% ' ELSE '' END || '\begin{{' || {_sql_pick(ENVIRONMENTS, K)} || '}} ' || line
        || CASE WHEN {K} % 7 = 0 THEN '' ELSE ' \end{{' || {_sql_pick(ENVIRONMENTS, K)} || '}}' END END AS line FROM doc_lines""",
    "tex_translated_lines": rf"""SELECT doc_id, line_no, CASE
      WHEN line_no = 0 AND doc_id % 2 = 0 THEN '\documentclass[11pt]{{ctexart}}'
      WHEN {K} % 4 = 0 THEN regexp_replace(line, '^% ', '')
      WHEN {K} % 9 = 0 THEN line || ' \end{{figure}}'
      WHEN {K} % 13 = 0 THEN line || '\usepackage{{ctex}}' ELSE line END AS line FROM tex_lines""",
    "tex": "SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM tex_lines GROUP BY doc_id",
    "tex_pairs": """SELECT a.doc_id, a.text AS original, b.text AS translated FROM tex a
      JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM tex_translated_lines GROUP BY doc_id) b USING (doc_id)""",
    "plain_lines": "SELECT doc_id, line_no, trim(regexp_replace(line, '[^A-Za-z0-9]+', ' ', 'g')) AS w FROM doc_lines",
    "cell_tables": rf"""SELECT doc_id, '\begin{{table}}' || chr(10) || '\caption{{Table ' || doc_id || '}}' || chr(10) || '\begin{{tabular}}{{llll}}' || chr(10)
      || string_agg('\multirow{{2}}{{*}}{{\textbf{{' || w || '}}}} & x & \multicolumn{{2}}{{c}}{{\textit{{' || w || '}}}} \\', chr(10) ORDER BY line_no) || chr(10) || '\end{{tabular}}' || chr(10) || '\end{{table}}' AS original,
      doc_id % 3 = 0 OR bool_or({K} % 5 <> 4) AS damaged FROM plain_lines GROUP BY doc_id""",
    "crossed_groups": rf"""SELECT doc_id, '\begin{{document}}' || chr(10) || string_agg(CASE {K} % 4 WHEN 0 THEN '\begin{{center}}' || chr(10) || '\scalebox{{0.8}}{{' || chr(10) || w || chr(10) || '}}' || chr(10) || '\end{{center}}'
      WHEN 1 THEN '\resizebox{{1}}{{!}}{{\begin{{tabular}}{{l}}' || w || '\end{{tabular}}}}' WHEN 2 THEN '\begin{{center}}\textbf{{\begin{{small}}\emph{{' || w || '}}\end{{small}}}}\end{{center}}' ELSE w END, chr(10) ORDER BY line_no)
      || chr(10) || '\end{{document}}' || chr(10) AS original, doc_id % 2 = 0 OR bool_or({K} % 4 <> 3) AS damaged FROM plain_lines GROUP BY doc_id""",
    "shifted_pairs": rf"""SELECT doc_id, '\section{{Inserted}}' || chr(10) || string_agg(line, chr(10) ORDER BY line_no) || chr(10) || '\section{{Added}}' AS wanted,
      bool_or({K} % 4 = 0 AND starts_with(line, '% ')) AS damaged FROM tex_lines GROUP BY doc_id""",
    "blocks": """SELECT doc_id, line_no AS pos, 1 + line_no // 20 AS page, CAST(72 + (doc_id * 7 + line_no) % 5 * 100 AS DOUBLE) AS x,
      CAST(800 - 12 * (line_no % 20) + (doc_id + line_no) % 3 AS DOUBLE) AS y, 5.0::DOUBLE * length(line) AS width, 10.0::DOUBLE AS height,
      CAST(9 + (doc_id + line_no) % 6 AS DOUBLE) AS font_size, (doc_id + line_no) % 4 = 0 AS is_bold,
      CASE WHEN line_no % 5 = 0 THEN substr(CAST(1 + line_no / 5 AS VARCHAR), 1, 1) || '. ' || line ELSE line END AS text FROM doc_lines""",
    "layout_elements": f"""SELECT doc_id, page, pos AS element, {_sql_pick(["text", "title", "picture", "caption", "section_header", "footnote", "formula", "table", "list_item", "unknown"], 'pos')} AS type,
      x + pos % 4 * 3 AS x, y, width + 8 AS width, height, (pos % 16) / 16.0::DOUBLE AS confidence, pos % 12 AS class_id FROM blocks WHERE pos % 3 = 0""",
    "repo_files": f"""SELECT name, 'file' AS type, 'https://files.example/' || name AS download_url FROM (
      SELECT arxiv_id || '_cat' || doc_id % {CATEGORIES} || (['_cn.pdf', '_bilingual.pdf', '.zip'])[k + 1] AS name
      FROM papers, (SELECT unnest(range(3)) AS k) WHERE (doc_id + k) % 3 <> 0)""",
    "cache_entries": """SELECT sha256(text) AS hash, CASE WHEN min(doc_id) % 10 = 0 THEN '' ELSE 'T ' || substr(text, 1, 40) END AS translation
      FROM documents WHERE doc_id % 2 = 0 GROUP BY text""",
    "err_events": f"""SELECT CAST(user_id AS VARCHAR) AS id, event_id, ts, {_sql_pick(STAGES, 'event_id')} AS stage,
      'error | ' || event_id AS error_msg, event_id % 5 = 0 AS is_retry FROM events WHERE event_type = 'error'""",
    "inputs": f"""SELECT page_id AS n, url AS input FROM pages UNION ALL SELECT doc_id, arxiv_id FROM papers UNION ALL
      SELECT doc_id + 1000000, (['https://arxiv.org/abs/', 'https://arxiv.org/pdf/', ' http://ARXIV.org/x/', 'cs-lg/', '/home/u/', 'C:\\docs\\'])[CAST(doc_id % 6 AS INTEGER) + 1]
      || arxiv_id || (['', '.pdf', '.zip', 'v2', '?x=1', '/', '.PDF '])[CAST(doc_id % 7 AS INTEGER) + 1] FROM papers""".replace("\\\\", "\\"),
    "include_edges": "SELECT doc_id AS parent, doc_id * 3 % 200 AS child FROM documents UNION ALL SELECT doc_id, (doc_id * 5 + 1) % 200 FROM documents",
    "log_lines": f"""SELECT doc_id, line_no, CASE WHEN {K} % 11 = 0 THEN '(./f' || line_no || '.tex' WHEN {K} % 11 = 3 THEN '! Undefined control sequence.'
      WHEN {K} % 11 = 4 THEN 'l.' || line_no * 2 || ' x' WHEN {K} % 11 = 7 THEN '! LaTeX Error: File missing.'
      WHEN {K} % 11 = 8 THEN 'Missing $ inserted' ELSE line END AS line FROM doc_lines""",
}


def sql(body: str) -> str:
    """``body`` after the views that it names, and those they name, in order of need."""
    order: list[str] = []

    def need(piece: str) -> None:
        for name in VIEWS:
            if name not in order and re.search(rf"\b(?:FROM|JOIN|,)\s*\(?\s*{name}\b", piece):
                need(VIEWS[name])
                if name not in order:
                    order.append(name)

    need(body)
    views = [f"{name} AS ({VIEWS[name]})" for name in order]
    body = body.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(start):
            return start + ",\n".join([*views, body[len(start) :]])
    return ("WITH " + ",\n".join(views) + "\n" if views else "") + body
