"""Chat formatting with tool-call linking, in DataFrame and SQL functions only.

Results are hash-joined to calls by identifier, and calls to the calls whose
results they build on. Events are put in a topological order of these links: a
call follows its message, a result its call, and a call the results it builds
on. Arguments are checked against their tool's schema, and every event becomes
one line of canonical JSON: keys in order, no spaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inkspan.llm.scratch import materialise

#: Turns of a conversation that are numbered by one sort; their counts carry over to the next ones.
STRETCH = 256

CALLS = "conv_id long, turn long, call_id string, name string, arguments string"
RESULTS = "conv_id long, turn long, call_id string, content string"
SCHEMAS = "name string, key string, type string, required boolean"


def _empty(spark: SparkSession, columns: str) -> DataFrame:
    pairs = [c.split() for c in columns.split(", ")]
    return spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in pairs])


def canonical(json: Column) -> Column:
    """JSON text with sorted keys and no spaces; null if it is not JSON."""
    return F.to_json(F.try_parse_json(json))


def _kind(value: Column) -> Column:
    """JSON schema type of a variant."""
    found = F.schema_of_variant(value)
    return (
        F.when(found == "BIGINT", "integer")
        .when(found.rlike("^DECIMAL|^DOUBLE|^FLOAT"), "number")
        .when(found == "BOOLEAN", "boolean")
        .when(found == "STRING", "string")
        .when(found.startswith("ARRAY"), "array")
        .when(found.startswith("OBJECT"), "object")
        .otherwise("null")
    )


def validate_arguments(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """Rows ``(conv_id, call_id, errors array<string>)`` of calls with errors, one per call identifier.

    A call is wrong if its arguments are not a JSON object, its tool has no
    schema, a required key is missing, or a key has another type than the schema
    names; other keys are allowed, and an integer is a number. Errors are sorted.
    """
    keyed = calls.select("conv_id", "call_id", "name", F.try_parse_json("arguments").alias("v"))
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    shape = keyed.filter(~is_object).select("conv_id", "call_id", F.lit("arguments are not an object").alias("error"))
    tools = schemas.select("name").distinct()
    unknown = keyed.join(tools, "name", "left_anti").select("conv_id", "call_id", F.lit("tool has no schema").alias("error"))
    sound = keyed.filter(is_object)
    pairs = sound.lateralJoin(calls.sparkSession.tvf.variant_explode(F.col("v").outer()))
    given = pairs.select("conv_id", "call_id", "name", "key", _kind(F.col("value")).alias("given"))
    wanted = schemas.filter(F.col("key").isNotNull()).select("name", "key", "type", F.coalesce("required", F.lit(False)).alias("required"))
    typed = given.join(wanted, ["name", "key"]).filter(F.col("type").isNotNull())
    fits = (F.col("given") == F.col("type")) | ((F.col("type") == "number") & (F.col("given") == "integer"))
    wrong = typed.filter(~fits).select("conv_id", "call_id", F.format_string("%s is %s, not %s", "key", "given", "type").alias("error"))
    due = sound.select("conv_id", "call_id", "name").join(wanted.filter("required"), "name").select("conv_id", "call_id", "key")
    missing = due.join(given, ["conv_id", "call_id", "key"], "left_anti").select("conv_id", "call_id", F.concat(F.lit("missing "), "key").alias("error"))
    errors = shape.unionByName(unknown).unionByName(wrong).unionByName(missing).distinct()
    return errors.groupBy("conv_id", "call_id").agg(F.array_sort(F.collect_list("error")).alias("errors"))


def dependency_order(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Rows ``(conv_id, call_id, call_turn, due long, depth long, circular boolean)``, one per call identifier.

    ``depth`` is the length of the chain of calls that a call builds on, and
    ``due`` the latest turn of any of them or of their results (null without a
    chain). Chains are followed by pointer doubling: each round joins every call
    to the call that its pointer reached, so rounds grow with the logarithm of
    the longest chain, and no conversation is gathered. A name that no call has
    ends a chain. What still points on after as many rounds as the number of
    calls allows goes round in a circle; such calls have depth 0.
    """
    linked = calls.filter(F.col("call_id").isNotNull() & F.col("conv_id").isNotNull())
    own = linked.groupBy("conv_id", "call_id").agg(F.min("turn").alias("call_turn"), F.max("turn").alias("last_turn"), F.min("after_id").alias("after_id"))
    given = results.filter(F.col("call_id").isNotNull()).groupBy("conv_id", "call_id").agg(F.max("turn").alias("result_turn"))
    own = own.join(given.hint("shuffle_hash"), ["conv_id", "call_id"], "left")
    nodes = materialise(own.select("conv_id", "call_id", "call_turn", F.greatest("last_turn", "result_turn").alias("settled"), "after_id"), "calls")
    before = nodes.select("conv_id", F.col("call_id").alias("up"), F.col("settled").alias("due"))
    known = nodes.select("conv_id", "call_id", "call_turn", F.col("after_id").alias("named"))
    chains = known.join(before, (known["conv_id"] == before["conv_id"]) & (known["named"] == before["up"]), "left").select(
        known["conv_id"], "call_id", "call_turn", "up", "due", F.col("up").isNotNull().cast("long").alias("depth")
    )
    chains, most, reach = materialise(chains, "chains"), nodes.count(), 1
    while reach <= 2 * most and not chains.filter("up is not null").isEmpty():
        at = chains.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"), F.col("up").alias("next"), F.col("due").alias("more"), F.col("depth").alias("further"))
        stepped = chains.join(at, (F.col("conv_id") == F.col("c")) & (F.col("up") == F.col("i")), "left")
        chains = materialise(
            stepped.select("conv_id", "call_id", "call_turn", F.col("next").alias("up"), F.greatest("due", "more").alias("due"), (F.col("depth") + F.coalesce("further", F.lit(0))).alias("depth")),
            "chains",
        )
        reach *= 2
    circular = F.col("up").isNotNull()
    return chains.select(
        "conv_id", "call_id", "call_turn", F.when(~circular, F.col("due")).alias("due"), F.when(circular, 0).otherwise(F.col("depth")).alias("depth"), circular.alias("circular")
    )


def number_events(events: DataFrame, order: list[str]) -> DataFrame:
    """``events`` with ``seq long``, 0-based in each conversation by ``turn`` and then ``order``.

    A long conversation is numbered in stretches of ``STRETCH`` turns: each is
    sorted by itself, and the counts of the ones before it are added.
    """
    events = events.withColumn("stretch", F.floor(F.coalesce("turn", F.lit(-1)) / STRETCH))
    sizes = events.groupBy("conv_id", "stretch").agg(F.count("*").alias("size"))
    before = F.sum("size").over(W.partitionBy("conv_id").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select(F.col("conv_id").alias("c"), F.col("stretch").alias("s"), F.coalesce(before, F.lit(0)).alias("start"))
    inside = W.partitionBy("conv_id", "stretch").orderBy(F.col("turn").asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order])
    placed = events.withColumn("place", F.row_number().over(inside))
    placed = placed.join(starts, placed["conv_id"].eqNullSafe(starts["c"]) & (placed["stretch"] == starts["s"]))
    return placed.withColumn("seq", F.col("start") + F.col("place") - 1).drop("c", "s", "start", "place", "stretch")


def format_chat(messages: DataFrame, calls: DataFrame | None = None, results: DataFrame | None = None, schemas: DataFrame | None = None) -> DataFrame:
    """Events of conversations: ``(conv_id, seq long, turn long, kind, role, call_id, depth long, linked boolean, errors array<string>, json)``.

    ``messages`` has conv_id, turn, role and text; ``calls``, ``results`` and
    ``schemas`` are shaped like CALLS, RESULTS and SCHEMAS. A string column
    ``after_id`` of ``calls``, if there is one, names the call whose results a
    call builds on. ``kind`` is message, call or result. An event that claims an earlier turn than what it depends on
    moves to that turn, and ``depth`` (of a call's chain, and of its results)
    orders a turn, so ``seq`` is a topological order. ``linked`` says whether a
    call has a result or a result a call; it is null for messages. Of calls that
    repeat an identifier in a conversation, results link to the first and the
    calls share their errors and their chain. A call that depends on itself
    stays in its turn and has an error. Null texts, roles and identifiers are
    left out of the JSON; a null identifier links to nothing; arguments that are
    not JSON are kept as ``raw``. Ties are ordered by identifier, role and text;
    repeated rows each come out. Empty tables give an empty result; other
    columns are not read.
    """
    spark = messages.sparkSession
    after = F.col("after_id") if calls is not None and "after_id" in calls.columns else F.lit(None).cast("string").alias("after_id")
    calls = _empty(spark, CALLS + ", after_id string") if calls is None else calls.select("conv_id", "turn", "call_id", "name", "arguments", after)
    results = _empty(spark, RESULTS) if results is None else results.select("conv_id", "turn", "call_id", "content")
    schemas = _empty(spark, SCHEMAS) if schemas is None else schemas

    said = messages.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.lit(0).cast("long").alias("level"), F.lit(None).cast("string").alias("call_id"), "role",
        F.to_json(F.struct(F.col("text").alias("content"), F.col("role").alias("role"))).alias("json"),
        F.lit(None).cast("boolean").alias("linked"), F.lit(None).cast("array<string>").alias("errors"),
    )
    events = said.unionByName(_call_events(calls, results, schemas))
    numbered = number_events(events, ["level", "call_id", "role", "json"])
    level = F.col("level")
    kind = F.when(level == 0, "message").when(level % 2 == 1, "call").otherwise("result")
    depth = F.when(level > 0, F.floor((level - 1) / 2))
    return numbered.select("conv_id", "seq", "turn", kind.alias("kind"), "role", "call_id", depth.cast("long").alias("depth"), "linked", "errors", "json")


def _call_events(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """Calls and results as events, with the turn and level (odd for calls, even for results) that their links give them."""
    order = dependency_order(calls, results).hint("shuffle_hash")
    answered = results.filter(F.col("call_id").isNotNull()).select("conv_id", "call_id").distinct().withColumn("answered", F.lit(True))
    errors = validate_arguments(calls, schemas).select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"), F.col("errors").alias("found"))
    asked = calls.join(answered.hint("shuffle_hash"), ["conv_id", "call_id"], "left").join(order, ["conv_id", "call_id"], "left")
    asked = asked.join(errors, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("call_id").eqNullSafe(F.col("i")), "left")
    nothing = F.array().cast("array<string>")
    circle = F.when(F.col("circular"), F.array(F.lit("depends on itself"))).otherwise(nothing)
    arguments = F.coalesce(canonical(F.col("arguments")), F.to_json(F.struct(F.col("arguments").alias("raw"))))
    head = F.to_json(F.struct(F.col("call_id").alias("id"), "name", F.lit("call").alias("type")))
    asked = asked.select(
        "conv_id", F.greatest("turn", "due").cast("long").alias("turn"), (1 + 2 * F.coalesce("depth", F.lit(0))).cast("long").alias("level"), "call_id",
        F.lit("assistant").alias("role"), F.concat(F.lit('{"arguments":'), arguments, F.lit(","), F.substr(head, F.lit(2))).alias("json"),
        F.coalesce("answered", F.lit(False)).alias("linked"), F.array_sort(F.concat(F.coalesce("found", nothing), circle)).alias("errors"),
    )
    given = results.join(order, ["conv_id", "call_id"], "left").select(
        "conv_id", F.greatest("turn", "call_turn", "due").cast("long").alias("turn"), (2 + 2 * F.coalesce("depth", F.lit(0))).cast("long").alias("level"), "call_id",
        F.lit("tool").alias("role"), F.to_json(F.struct("content", F.col("call_id").alias("id"), F.lit("result").alias("type"))).alias("json"),
        F.col("call_turn").isNotNull().alias("linked"), F.lit(None).cast("array<string>").alias("errors"),
    )
    return asked.unionByName(given)
