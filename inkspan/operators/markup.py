"""Structure of marked-up documents: counts, profiles, diffs, comments, lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkspan.functions import tex
from inkspan.functions.text import common_prefix, is_similar, nonblank_line_count, strip

BEGIN = r"\\begin\{([^}]+)\}"
END = r"\\end\{([^}]+)\}"


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, line_no, line)``, 1-based; only the two columns are exploded."""
    return docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long") + 1)


def line_range(docs: DataFrame, start: int, end: int = -1) -> DataFrame:
    """Lines ``start`` to ``end`` (inclusive; -1: to the last)."""
    at = F.col("line_no")
    return lines(docs).filter((at >= start) & ((at <= end) if end >= 0 else F.lit(True)))


def search_lines(docs: DataFrame, literal: str) -> DataFrame:
    return lines(docs).filter(F.col("line").contains(literal))


def grep(docs: DataFrame, pattern: str, limit: int = 51) -> DataFrame:
    """The first matches of a pattern in document and line order."""
    return lines(docs).filter(F.col("line").rlike(pattern)).orderBy("doc_id", "line_no").limit(limit)


def edit_line(text: Column, number: Column, replacement: Column | None = None, insert: bool = False) -> Column:
    """Text with its 1-based line replaced, deleted (no replacement) or preceded by an inserted line."""
    parts = F.split(text, "\n", -1)
    head, own, tail = F.slice(parts, F.lit(1), number - 1), F.slice(parts, number, F.lit(1)), F.slice(parts, number + 1, F.greatest(F.size(parts) - number, F.lit(0)))
    middle = F.concat(F.array(replacement), own) if insert else F.array(replacement) if replacement is not None else F.slice(own, 1, 0)
    return F.array_join(F.concat(head, middle, tail), "\n")


def environment_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(doc_id, env, begins, ends)`` with map-side partial counts."""
    tags = docs.select("doc_id", F.explode(tex.env_tags(F.col(text))).alias("tag"))
    named = tags.select("doc_id", F.regexp_extract("tag", tex.ENV_TAG, 2).alias("env"), F.col("tag").startswith("\\begin").alias("begin"))
    return named.groupBy("doc_id", "env").agg(F.count_if("begin").alias("begins"), F.count_if(~F.col("begin")).alias("ends"))


def environment_mismatches(docs: DataFrame) -> DataFrame:
    counts = environment_counts(docs).withColumn("difference", F.col("begins") - F.col("ends"))
    return counts.filter("difference <> 0").orderBy("doc_id", "env")


def _unpivot(docs: DataFrame, counts: dict[str, Column], kind: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(k).alias("name"), v.alias("n")) for k, v in counts.items()])
    return docs.select("doc_id", F.lit(kind).alias("kind"), F.inline(pairs)).filter("n > 0")


def element_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(doc_id, kind, name, n)`` of sections, environments, key commands and packages that occur.

    Sections, commands and packages are counted inside each row; only the
    environments need an aggregation, and it starts before the shuffle.
    """
    c = F.col(text)
    begins = docs.select("doc_id", F.explode(F.regexp_extract_all(c, F.lit(BEGIN), F.lit(1))).alias("name"))
    environments = begins.groupBy("doc_id", "name").agg(F.count("*").alias("n")).select("doc_id", F.lit("environment").alias("kind"), "name", "n")
    packages = docs.select("doc_id", F.lit("package").alias("kind"), F.explode(tex.packages(c)).alias("name"), F.lit(1).cast("long").alias("n"))
    return (
        _unpivot(docs, tex.section_counts(c), "section")
        .unionByName(_unpivot(docs, tex.command_counts(c), "command"))
        .unionByName(packages)
        .unionByName(environments)
    )


def structure_profile(docs: DataFrame) -> DataFrame:
    """One row per document: lines, class, packages and the totals of its structure. Nothing is shuffled."""
    c = F.col("text")
    total = lambda counts: sum(counts.values(), F.lit(0))
    return docs.select(
        "doc_id", F.size(F.split(c, "\n", -1)).cast("long").alias("total_lines"), nonblank_line_count(c).alias("non_empty_lines"),
        tex.document_class(c).alias("document_class"), tex.packages(c).alias("packages"), total(tex.section_counts(c)).cast("long").alias("sections"),
        F.regexp_count(c, F.lit(BEGIN)).cast("long").alias("environments"), total(tex.command_counts(c)).cast("long").alias("commands"),
    )


def compare_structure(pairs: DataFrame) -> DataFrame:
    """Differences ``(doc_id, kind, name, original_count, translated_count, difference, severity)`` of text pairs.

    A pair is compared inside its row: counts of fixed names side by side, and
    those of environments and packages over the names that either side has.
    Nothing is shuffled.
    """
    sides = ("original", "translated")
    found = {f"{what}_{side}": of(F.col(side)) for side in sides for what, of in (("envs", lambda c: F.regexp_extract_all(c, F.lit(BEGIN), F.lit(1))), ("packages", tex.packages))}
    row = lambda kind, name, a, b: F.struct(F.lit(kind).alias("kind"), name.alias("name"), a.cast("long").alias("a"), b.cast("long").alias("b"))

    def fixed(kind: str, counts):
        a, b = (counts(F.col(side)) for side in sides)
        return F.array(*[row(kind, F.lit(name), a[name], b[name]) for name in a])

    def named(kind: str, what: str):
        a, b = (f"{what}_{side}" for side in sides)
        of = lambda names, name: F.size(F.filter(names, lambda x: x == name))
        return F.transform(F.array_union(a, b), lambda name: row(kind, name, of(a, name), of(b, name)))

    counts = F.concat(fixed("section", tex.section_counts), fixed("command", tex.command_counts), named("package", "packages"), named("environment", "envs"))
    changed = F.inline_outer(F.filter(counts, lambda r: r["a"] != r["b"]))  # the outer form is not evaluated once more to filter empty arrays
    joined = pairs.withColumns(found).select("doc_id", changed).filter("kind is not null")
    kind, name, lost = F.col("kind"), F.col("name"), F.col("b") < F.col("a")
    error = (
        ((kind == "section") & lost & (F.col("a") > 0))
        | ((kind == "environment") & lost & name.isin(*tex.CRITICAL_ENVIRONMENTS))
        | ((kind == "command") & lost & name.isin(*tex.CRITICAL_COMMANDS))
    )
    info = (kind == "package") & ~lost & name.isin(*tex.ADDED_PACKAGES)
    counted = joined.select(
        "doc_id", "kind", "name", F.col("a").alias("original_count"), F.col("b").alias("translated_count"), (F.col("b") - F.col("a")).alias("difference"),
        F.when(error, "error").when(info, "info").otherwise("warning").alias("severity"),
    )
    a, b = tex.document_class(F.col("original")), tex.document_class(F.col("translated"))
    classes = pairs.filter(~tex.compatible_class(a, b)).select(
        "doc_id", F.lit("documentclass").alias("kind"), F.concat(a, F.lit(" -> "), b).alias("name"), F.lit(1).cast("long").alias("original_count"),
        F.lit(1).cast("long").alias("translated_count"), F.lit(0).cast("long").alias("difference"), F.lit("warning").alias("severity"),
    )
    return counted.unionByName(classes)


def severity_summary(differences: DataFrame) -> DataFrame:
    """Per document: whether the structures match, and the number of errors, warnings and notes."""
    count = lambda s: F.count_if(F.col("severity") == s)
    match = F.bool_and((F.col("severity") != "error") & (F.col("kind") != "documentclass"))
    found = differences.groupBy("doc_id").agg(match.alias("is_match"), count("error").alias("errors"), count("warning").alias("warnings"), count("info").alias("infos"))
    text = F.format_string("errors: %d, warnings: %d, notes: %d", "errors", "warnings", "infos")
    return found.withColumn("summary", text)


def missing_labels(pairs: DataFrame) -> DataFrame:
    """Labels of the original that its translation lacks."""
    gone = F.array_except(tex.labels(F.col("original")), tex.labels(F.col("translated")))
    return pairs.select("doc_id", F.explode(gone).alias("label"))


def comment_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """Comment lines with their environment tags."""
    own = lines(docs.select("doc_id", F.col(text).alias("text"))).filter(tex.is_comment(F.col("line")))
    return own.withColumn("tags", tex.env_tags(F.col("line")))


def removed_comments(pairs: DataFrame) -> DataFrame:
    """Comment lines whose counterpart is live: ``(doc_id, original_line, translated_line)``.

    First the line of the same number, if its content or tags are similar; then,
    where line counts differ, the first live line that shares a tag.
    """
    comments = comment_lines(pairs, "original").select("doc_id", F.col("line_no").alias("original_line"), F.col("line").alias("c"), "tags")
    live = lines(pairs.select("doc_id", F.col("translated").alias("text"))).filter(~tex.is_comment(F.col("line")))
    live = live.select("doc_id", F.col("line_no").alias("translated_line"), F.col("line").alias("l"))
    bare = F.regexp_replace("c", r"^[ \t%]+", "")
    body = F.regexp_replace("l", r"^[ \t]+", "")
    alike = is_similar(bare, body) | F.arrays_overlap("tags", tex.env_tags(F.col("l")))
    same = comments.join(live, (comments["doc_id"] == live["doc_id"]) & (F.col("original_line") == F.col("translated_line"))).drop(live["doc_id"])
    same = same.filter((body != "") & alike).select("doc_id", "original_line", "translated_line")

    uneven = pairs.filter(F.size(F.split("original", "\n", -1)) != F.size(F.split("translated", "\n", -1))).select("doc_id")
    rest = comments.filter(bare != "").join(same, ["doc_id", "original_line"], "left_anti").join(uneven, "doc_id", "left_semi")
    tagged = rest.select("doc_id", "original_line", F.explode("tags").alias("tag"))
    first = live.select("doc_id", "translated_line", F.explode(tex.env_tags(F.col("l"))).alias("tag")).groupBy("doc_id", "tag").agg(F.min("translated_line").alias("translated_line"))
    moved = tagged.join(first, ["doc_id", "tag"]).groupBy("doc_id", "original_line").agg(F.min("translated_line").alias("translated_line"))
    return same.unionByName(moved)


def uncommented_tags(pairs: DataFrame) -> DataFrame:
    """Tags that are commented in the original and live in the translation, at their first live line."""
    hidden = comment_lines(pairs, "original").select("doc_id", F.col("line_no").alias("original_line"), F.explode("tags").alias("tag"))
    live = lines(pairs.select("doc_id", F.col("translated").alias("text"))).filter(~tex.is_comment(F.col("line")))
    first = live.select("doc_id", "line_no", F.explode(tex.env_tags(F.col("line"))).alias("tag")).groupBy("doc_id", "tag").agg(F.min("line_no").alias("translated_line"))
    return hidden.join(first, ["doc_id", "tag"])


def comment_summary(pairs: DataFrame) -> DataFrame:
    """Per document: comments before and after, and whether every comment stayed one."""
    count = lambda c: F.size(F.filter(F.split(c, "\n", -1), tex.is_comment)).cast("long")
    broken = removed_comments(pairs).select("doc_id").union(uncommented_tags(pairs).select("doc_id")).distinct().withColumn("broken", F.lit(True))
    counted = pairs.select("doc_id", count("original").alias("original_comments"), count("translated").alias("translated_comments"))
    return counted.join(broken, "doc_id", "left").select("doc_id", "original_comments", "translated_comments", F.col("broken").isNull().alias("is_valid"))


def aligned_lines(pairs: DataFrame) -> DataFrame:
    """Lines of both texts by number, where their counts differ by a tenth at most."""
    a, b = F.size(F.split("original", "\n", -1)), F.size(F.split("translated", "\n", -1))
    close = pairs.filter((F.col("original") != "") & (F.col("translated") != "") & (F.abs(a - b) <= F.floor(a / 10)))
    zipped = F.arrays_zip(F.split("original", "\n", -1).alias("o"), F.split("translated", "\n", -1).alias("t"))
    rows = close.select("doc_id", F.posexplode(zipped).alias("line_no", "z"))
    return rows.select("doc_id", (F.col("line_no") + 1).cast("long").alias("line_no"), F.col("z.o").alias("original"), F.col("z.t").alias("translated")).filter("original is not null and translated is not null")


def paragraphs(line_rows: DataFrame) -> DataFrame:
    """Lines (doc_id, line_no, line) joined to paragraphs ``(doc_id, paragraph, text)``.

    A blank line ends a paragraph, and so does a sentence end on a short line before a capital.
    """
    own = line_rows.withColumn("t", strip(F.col("line")))
    w = W.partitionBy("doc_id").orderBy("line_no")
    before = F.lag("t").over(w)
    ended = before.rlike(r"[.?!]\z") & (F.octet_length(before) < 60) & F.col("t").rlike("^[A-Z]")
    opens = F.coalesce((before == "") | ended, F.lit(True))
    marked = own.withColumn("opens", opens).withColumn("group", F.sum(F.col("opens").cast("int")).over(w)).filter("t <> ''")
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "t")))
    joined = marked.groupBy("doc_id", "group").agg(F.array_join(F.transform(ordered, lambda s: s["t"]), " ").alias("text"))
    number = F.row_number().over(W.partitionBy("doc_id").orderBy("group"))
    return joined.select("doc_id", number.alias("paragraph"), "text")


def log_errors(log: DataFrame) -> DataFrame:
    """Errors of compiler logs (doc_id, line_no, line): ``(doc_id, number, file, line, message, context)``.

    The file opened last is carried forward to each error; an error owns the
    last ``l.N`` up to the next one; the context is two lines before to four after.
    """
    w = W.partitionBy("doc_id").orderBy("line_no")
    opened = F.nullif(F.regexp_extract("line", r"\(\.?/?([^()]+\.tex)", 1), F.lit(""))
    message = F.nullif(F.regexp_extract("line", r"^!\s*(.+)$", 1), F.lit(""))
    at = F.nullif(F.regexp_extract("line", r"^l\.(\d+)", 1), F.lit("")).cast("long")
    around = F.array_join(F.collect_list("line").over(w.rowsBetween(-2, 4)), "\n")
    rows = log.select("doc_id", "line_no", "line", opened.alias("opened"), message.alias("message"), at.alias("at"), around.alias("context"))
    carried = rows.withColumn("file", F.last("opened", ignorenulls=True).over(w)).withColumn("number", F.count("message").over(w)).filter("number > 0")
    return carried.groupBy("doc_id", "number").agg(
        F.min_by("file", "line_no").alias("file"), F.max_by("at", F.when(F.col("at").isNotNull(), F.col("line_no"))).alias("line"),
        F.max("message").alias("message"), F.min_by("context", "line_no").alias("context"),
    )


LOG_CLASSES = [
    ("Undefined control sequence", "undefined_command"), (r"Missing \$ inserted", "math_mode"), (r"Missing \{ inserted", "brace"),
    (r"Missing \} inserted", "brace"), (r"Extra \}", "brace"), ("Runaway argument", "runaway"), ("Package .+ Error", "package_error"),
    ("LaTeX Error", "latex_error"), ("^! ", "latex_error"), (r"^l\.(\d+)", "line_error"),
]


def classify_log(log: DataFrame) -> DataFrame:
    """Lines of a log that report something: ``(doc_id, line_no, type, at, message)``; the first pattern counts."""
    kind = F.lit(None).cast("string")
    for pattern, name in reversed(LOG_CLASSES):
        kind = F.when(F.col("line").rlike(pattern), name).otherwise(kind)
    at = F.coalesce(F.nullif(F.regexp_extract("line", r"l\.(\d+)", 1), F.lit("")).cast("long"), F.col("line_no") + 1)
    return log.select("doc_id", "line_no", kind.alias("type"), at.alias("at"), strip(F.col("line")).alias("message")).filter("type is not null")


def first_error_file(log: DataFrame) -> DataFrame:
    """The file opened last before the first error line of each log that has one."""
    w = W.partitionBy("doc_id").orderBy("line_no")
    opened = F.nullif(F.regexp_extract("line", r"\(\.?/?([^\s\(\)]+\.tex)", 1), F.lit(""))
    failing = F.col("line").startswith("!") | F.col("line").contains("Error")
    carried = log.withColumn("file", F.last(opened, ignorenulls=True).over(w)).filter(failing & F.col("file").isNotNull())
    return carried.groupBy("doc_id").agg(F.min_by("file", "line_no").alias("file"))


def error_complexity(log: DataFrame) -> DataFrame:
    """high, medium or low by keywords of the log, else by the number of errors."""
    low = F.lower("line")
    high = low.rlike(r"emergency stop|no legal \\end found|ended by \\end\{document\}|fatal error|tex capacity exceeded|missing \\begin\{document\}")
    medium = low.rlike(r"mismatched|extra \}|missing \}|ended by \\end\{|lonely \\item|package xcolor error|package hyperref error|undefined control sequence")
    rows = log.groupBy("doc_id").agg(F.bool_or(high).alias("h"), F.bool_or(medium).alias("m"), F.count_if(F.col("line").startswith("!")).alias("errors"))
    n = F.col("errors")
    return rows.select("doc_id", "errors", F.when(n == 0, "low").when(F.col("h") | (~F.col("m") & (n > 5)), "high").when(F.col("m") | (n > 2), "medium").otherwise("low").alias("complexity"))


def missing_includes(docs: DataFrame, files: DataFrame) -> DataFrame:
    """Include targets of ``docs`` (doc_id, text) that ``files`` (path) does not hold."""
    wanted = docs.select("doc_id", F.explode(tex.includes(F.col("text"))).alias("path"))
    return wanted.join(files.select("path"), "path", "left_anti")


def prefix_length(a: Column, b: Column) -> Column:
    return common_prefix(a, b).cast("long")


def excess_closings(docs: DataFrame) -> DataFrame:
    """Closing braces beyond the open ones so far: ``(doc_id, line_no, mark)``, comments cut at the first percent sign."""
    marks = F.regexp_extract_all(F.regexp_replace("line", "%.*", ""), F.lit(r"[{}]"), F.lit(0))
    rows = lines(docs).select("doc_id", "line_no", F.posexplode(marks).alias("mark", "m"))
    surplus = F.sum(F.when(F.col("m") == "{", 1).otherwise(-1)).over(W.partitionBy("doc_id").orderBy("line_no", "mark"))
    return rows.withColumn("surplus", surplus).filter("m = '}' and surplus < 0").select("doc_id", "line_no", "mark")


def common_error_rows(docs: DataFrame) -> DataFrame:
    """``(doc_id, line_no, severity, message)``: misspelt commands, odd dollars, triple backslashes, garbled text; line 0 is the document."""
    from inkspan.functions.text import TYPOS, is_garbled

    own = lines(docs)
    cut = F.regexp_replace("line", "%.*", "")
    dollars = F.length(cut) - F.length(F.replace(cut, F.lit("$"), F.lit("")))
    found = [F.when(cut.contains(wrong), F.struct(F.lit("error").alias("severity"), F.lit(f"typo {wrong}").alias("message"))) for wrong in TYPOS]
    found.append(F.when(dollars % 2 == 1, F.struct(F.lit("warning").alias("severity"), F.lit("odd number of $").alias("message"))))
    found.append(F.when(strip(cut).endswith("\\\\\\"), F.struct(F.lit("warning").alias("severity"), F.lit("triple backslash").alias("message"))))
    found.append(F.when(is_garbled(F.col("line")), F.struct(F.lit("error").alias("severity"), F.lit("garbled text").alias("message"))))
    by_line = own.select("doc_id", "line_no", F.inline(F.array_compact(F.array(*found))))
    return by_line.unionByName(document_error_rows(docs).withColumn("line_no", F.lit(0).cast("long")))


def document_error_rows(docs: DataFrame) -> DataFrame:
    """``(doc_id, severity, message)``: missing class, begin or end of the document, odd display maths, and what follows the end."""
    c, end = F.col("text"), "\\end{document}"
    after = F.split(F.substr(c, F.locate(end, c) + len(end)), "\n", -1)
    trailing = (F.locate(end, c) > 0) & F.exists(after, lambda x: (strip(x) != "") & ~strip(x).startswith("%"))
    row = lambda severity, message: F.struct(F.lit(severity).alias("severity"), F.lit(message).alias("message"))
    found = [F.when(~c.contains(m), row("error", f"missing {m}")) for m in ("\\documentclass", "\\begin{document}", end)]
    found.append(F.when(trailing, row("warning", "content after the document")))
    found.append(F.when(F.regexp_count(c, F.lit(r"\$\$")) % 2 == 1, row("error", "unmatched $$")))
    return docs.select("doc_id", F.inline(F.array_compact(F.array(*found))))


def issue_summary(issues: DataFrame) -> DataFrame:
    """Errors and warnings per document."""
    count = lambda s: F.count_if(F.col("severity") == s)
    return issues.groupBy("doc_id").agg(count("error").alias("errors"), count("warning").alias("warnings"))


def incomplete_definitions(docs: DataFrame, ahead: int = 10) -> DataFrame:
    """Command definitions whose braces do not balance in the next lines: ``(doc_id, line_no)``."""
    c = F.col("line")
    count = lambda x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    surplus = (count("{") - count("\\{") / 2) - (count("}") - count("\\}") / 2)
    w = W.partitionBy("doc_id").orderBy("line_no")
    rows = lines(docs).withColumn("n", surplus.cast("long")).withColumn("total", F.sum("n").over(w))
    later = F.collect_list("total").over(w.rowsBetween(1, ahead))
    rows = rows.withColumns({"start": F.col("total") - F.col("n"), "later": later})
    opens = c.rlike(r"\\(?:re)?newcommand") & ~strip(c).startswith("%") & (F.col("n") > 0)
    return rows.filter(opens & ~F.array_contains("later", F.col("start"))).select("doc_id", "line_no")


def scaled_tables(docs: DataFrame, ahead: int = 9) -> DataFrame:
    """Table begins and whether a resizebox stands on their line or the next ones: ``(doc_id, line_no, scaled)``."""
    w = W.partitionBy("doc_id").orderBy("line_no")
    rows = lines(docs).withColumn("scaled", F.bool_or(F.col("line").contains("\\resizebox")).over(w.rowsBetween(0, ahead)))
    return rows.filter(F.col("line").contains("\\begin{table")).select("doc_id", "line_no", "scaled")
