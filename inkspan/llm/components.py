"""Connected components by alternating large-star and small-star steps.

Every step is one aggregation and one equi-join over edge rows, so no
neighbourhood is ever held in memory; the edges of one node, 16 bytes each, are
sorted and joined in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.scratch import discard, materialise


def unbroadcast(side: DataFrame) -> DataFrame:
    """``side``, to be joined by sorting whatever size Spark takes it for.

    Spark sizes a table by its compressed files and takes an explode to add
    nothing, so a side of many times the broadcast limit can pass under it, and
    would go through the driver whole.
    """
    return side.hint("merge")


def _large_star(edges: DataFrame) -> DataFrame:
    """Point every larger neighbour of a node at the least node of its closed neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(unbroadcast(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Point a node and its smaller neighbours at the least of them. Edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    inner = edges.join(unbroadcast(least), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return inner.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """Rows ``(node long, component long)`` for every node that has a link to another node.

    ``component`` is the least node id that is reachable. Null ends and self
    links are ignored; repeated links and either direction are allowed; an
    empty input gives an empty result. Rounds grow with the logarithm of the
    largest component's size; a RuntimeError says so if ``max_rounds`` did not suffice.
    """
    ends = links.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    ends = ends.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    edges = materialise(ends.distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        new = materialise(_small_star(_large_star(edges)), "edges")
        discard(edges)
        edges = new
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
