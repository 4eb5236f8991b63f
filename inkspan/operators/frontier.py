"""Breadth-first closure over an edge table."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.functions import tex


def expand(edges: DataFrame, start: DataFrame, depth: int | None = None) -> DataFrame:
    """Rows ``(root, node, depth)``: every node that a root reaches, at its least depth.

    With ``depth``, only nodes within that many edges; without, rounds go on
    until nothing new is found, which cycles do not prevent.

    Rounds join only the pairs that the last round found; each round is cut off
    from the ones before by a checkpoint, and an empty frontier ends it. Roots
    that nothing leads to take no part in the rounds: they reach what the nodes
    after them reach, one edge further.
    """
    spark = edges.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder)
    steps = edges.select(F.col("parent").alias("node"), F.col("child").alias("next")).distinct()
    within = lambda: steps.select(F.col("next").alias("root")).distinct()
    inner, outer = start.join(within(), "root", "left_semi"), start.join(within(), "root", "left_anti")
    first = outer.join(steps.withColumnRenamed("node", "root"), "root")
    core = _rounds(steps, inner.unionByName(first.select(F.col("next").alias("root"))).distinct(), depth)
    through = core.select(F.col("root").alias("next"), "node", (F.col("depth") + 1).alias("depth"))
    if depth is not None:
        through = through.filter(F.col("depth") <= depth)
    reached = first.repartition("root").join(through, "next").groupBy("root", "node").agg(F.min("depth").alias("depth"))
    own = outer.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"))
    return core.join(inner, "root").select("root", "node", "depth").unionByName(own).unionByName(reached)


def _rounds(steps: DataFrame, roots: DataFrame, depth: int | None) -> DataFrame:
    frontier = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"))
    found = frontier
    for at in count(1) if depth is None else range(1, depth + 1):
        reached = frontier.join(steps, "node").select("root", F.col("next").alias("node"), F.lit(at).alias("depth")).distinct()
        frontier = reached.join(found.select("root", "node"), ["root", "node"], "left_anti").checkpoint()
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def clean_path(c: Column) -> Column:
    """A relative path without empty, ``.`` and inner ``..`` steps."""

    def step(done, part):
        up = (part == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("..")) != "..")
        return F.when(part.isin("", "."), done).when(up, F.slice(done, 1, F.size(done) - 1)).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(F.split(c, "/"), F.array().cast("array<string>"), step), "/")


def include_edges(files: DataFrame) -> DataFrame:
    """Edges ``(parent, child)`` between rows of ``files`` (project, path, text), as structs of project and path.

    A target gets ``.tex`` where it lacks it. It is sought beside the including
    file first, unless it starts with that folder, and then from the project's
    top; targets that no file has give no edge.
    """
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    wanted = files.select("project", "path", folder.alias("folder"), F.explode(tex.includes(F.col("text"))).alias("target"))
    wanted = wanted.select("project", "path", clean_path(F.concat_ws("/", "folder", "target")).alias("near"), clean_path(F.col("target")).alias("far"), (~F.col("target").startswith("/") & ~F.startswith("target", "folder")).alias("beside"))
    there = files.select("project", F.col("path").alias("found"))
    near = wanted.filter("beside").join(there, [wanted["project"] == there["project"], wanted["near"] == there["found"]], "left_semi")
    left = wanted.join(near.select("project", "path", "far").distinct(), ["project", "path", "far"], "left_anti")
    far = left.join(there, [left["project"] == there["project"], left["far"] == there["found"]], "left_semi")
    node = lambda path: F.struct("project", F.col(path).alias("path"))
    return near.select(node("path").alias("parent"), node("near").alias("child")).unionByName(far.select(node("path").alias("parent"), node("far").alias("child")))


def included_files(files: DataFrame, mains: DataFrame) -> DataFrame:
    """Rows ``(project, main, path, depth)``: every file that a project's main file (project, path) includes, directly or not."""
    start = mains.select(F.struct("project", "path").alias("root"))
    reached = expand(include_edges(files), start).filter("depth > 0")
    return reached.select("root.project", F.col("root.path").alias("main"), "node.path", "depth")
