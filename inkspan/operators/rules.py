"""Rules over texts as DataFrame operators: Arrow batches in, columns or rows out. Rows are dealt out anew only where they come from fewer files than there are cores."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from inkspan.functions.rules import chunks, repairs, spans, validators


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores, if they come from fewer files than there are: a file of one row group is one task, however many splits it has."""
    parallel = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(2 * parallel) if 0 < len(rows.inputFiles()) < parallel else rows


#: Bytes of a batch that are unpacked at once.
PIECE = 1 << 20


def pieces(batch: pa.RecordBatch):
    """``batch`` in slices of some ``PIECE`` bytes. Arrow batches count rows, so a batch of long texts is far larger than one of short ones."""
    step = max(1, PIECE * batch.num_rows // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def _with_made(rows: DataFrame, name: str, kind: str, make: Callable[..., object], *columns: str) -> DataFrame:
    """``rows`` with what ``make`` gives for the values of some columns: a worker holds one batch in Arrow's form and one piece of it as Python values."""
    kept = [c for c in rows.columns if c != name]
    parsed = StructType.fromDDL(f"made {kind}")[0].dataType
    fields, arrow = StructType([*rows.select(*kept).schema.fields, StructField(name, parsed)]), to_arrow_type(parsed)

    def applied(batches):
        for batch in batches:
            for piece in pieces(batch):
                made = [make(*values) for values in zip(*[piece.column(c).to_pylist() for c in columns])]
                yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in kept], pa.array(made, arrow)], names=fields.names)

    return rows.mapInArrow(applied, fields)


def with_text(rows: DataFrame, name: str, rule: Callable[..., str], *columns: str, kind: str = "string") -> DataFrame:
    """``rows`` with the result of a rule over text columns; null texts count as empty."""
    filled = lambda *values: rule(*(x if x is not None else "" for x in values))
    return _with_made(spread(rows), name, kind, filled, *columns)


def explode_rule(rows: DataFrame, key: str, text: str, rule: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    """One row per tuple that a rule gives for each text, with the row's key first."""
    source = rows.select(key, F.col(text).cast("string").alias("text"))
    fields = StructType([source.schema[0], *StructType.fromDDL(schema).fields])
    kinds = [to_arrow_type(f.dataType) for f in fields.fields[1:]]

    def expanded(batches):
        for batch in batches:
            for piece in pieces(batch):
                out = [(k, *r) for k, t in zip(piece.column(0).to_pylist(), piece.column(1)) for r in rule(t.as_py() or "")]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [piece.column(0).type, *kinds])], names=fields.names)

    return spread(source).mapInArrow(expanded, fields)


PROTECTED = "struct<text:string,placeholders:map<string,string>>"
RECOVERED = "struct<text:string,attempts:array<struct<placeholder:string,strategy:string>>>"


def protect(rows: DataFrame, text: str, kind: str = "all") -> DataFrame:
    """``rows`` with ``protected``: the text with placeholders, and what each stands for."""

    def made(value):
        found, table = spans.protect_all(value or "") if kind == "all" else spans.protect_kind(value or "", kind)
        return {"text": found, "placeholders": list(table.items())}

    return _with_made(spread(rows), "protected", PROTECTED, made, text)


def restore(rows: DataFrame, name: str = "restored") -> DataFrame:
    """``rows`` with the protected text's placeholders put back."""
    return _with_made(rows, name, "string", lambda p: spans.restore(p["text"], dict(p["placeholders"])), "protected")


def chunk(rows: DataFrame, key: str, text: str, limit: int = 4000) -> DataFrame:
    """``(key, chunk, text)``: chunks in order, numbered from 0."""
    return explode_rule(rows, key, text, lambda t: list(enumerate(chunks.split_chunks(t, limit))), "chunk bigint, text string")


def validate(rows: DataFrame, key: str, text: str, check: str = "syntax") -> DataFrame:
    """``(key, line, column, type, message)`` of what a check finds."""
    return explode_rule(rows, key, text, validators.CHECKS[check], "line bigint, column bigint, type string, message string")


def structures(rows: DataFrame, key: str, text: str) -> DataFrame:
    schema = "type string, name string, start bigint, stop bigint, is_nested boolean, parent_type string"
    return explode_rule(rows, key, text, spans.structures, schema)


def commands(rows: DataFrame, key: str, text: str) -> DataFrame:
    return explode_rule(rows, key, text, lambda t: [(s.kind, s.name, s.start, s.end) for s in spans.commands(t)], "type string, name string, start bigint, stop bigint")


def _recovered(text: str, attempts: list[tuple[str, str]]) -> dict:
    return {"text": text, "attempts": [{"placeholder": k, "strategy": s} for k, s in attempts]}


def recover(rows: DataFrame, text: str, original: str, placeholders: str) -> DataFrame:
    """``rows`` with ``recovered``: the text with missing placeholders, and the strategy of each."""
    made = lambda t, o, p: _recovered(*repairs.recover_placeholders(t or "", o or "", dict(p)))
    return _with_made(rows, "recovered", RECOVERED, made, text, original, placeholders)


def recover_in_order(rows: DataFrame, text: str, protected: str, placeholders: str) -> DataFrame:
    """``rows`` with ``recovered``: the text with missing placeholders at their neighbours' side, in order, and how each was placed."""
    made = lambda t, w, p: _recovered(*repairs.recover_in_order(t or "", w or "", sorted(dict(p))))
    return _with_made(spread(rows), "recovered", RECOVERED, made, text, protected, placeholders)


def repair_workflow(rows: DataFrame, text: str, rule: Callable[[str], str] = repairs.auto_fix, check: str = "editor") -> DataFrame:
    """``rows`` with ``issues_before``, ``issues_after`` (long), ``decision`` and ``kept``: each text is checked, repaired and checked again.

    A repair after which the check finds more than before is ``rejected`` and the
    older text kept; else it is ``accepted``, or the text was ``unchanged``. A
    null text counts as empty. One row comes out per row, nothing is shuffled.
    """
    found = validators.CHECKS[check]

    def checked(value):
        fixed = rule(value or "")
        return {"fixed": fixed, "before": len(found(value or "")), "after": len(found(fixed))}

    old, new = F.coalesce(F.col(text), F.lit("")), F.col("repair_.fixed")
    made = _with_made(spread(rows), "repair_", "struct<fixed:string,before:bigint,after:bigint>", checked, text)
    made = made.withColumns({"issues_before": F.col("repair_.before"), "issues_after": F.col("repair_.after")})
    rose = F.col("issues_after") > F.col("issues_before")
    decision = F.when(new == old, "unchanged").when(rose, "rejected").otherwise("accepted")
    return made.withColumns({"decision": decision, "kept": F.when(rose, old).otherwise(new)}).drop("repair_")


def regex_fix(rows: DataFrame, text: str, pattern: str, replacement: str) -> DataFrame:
    """A caller's pattern and replacement over each text, with whether it changed."""
    fixed = F.regexp_replace(text, pattern, replacement)
    return rows.withColumns({"fixed": fixed, "changed": fixed != F.col(text)})
