"""Connected components by alternating stars, on tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placerank.sources.scratch import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours of each node to the smallest one: its larger ones, or its smaller ones."""
    both = edges.select("u", "v")
    if large:
        both = both.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = both.join(least, "u")
    if large:
        return linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    kept = linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kept.union(least.where("u <> m").select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of all nodes of ``edges`` (``u``, ``v``).

    Edges are rewritten by large and small stars in turn until nothing changes, in
    about ``log^2(nodes)`` steps at worst and few in practice.  Minima are aggregated
    before the shuffle and no step grows the number of edges, so a hub of any degree
    costs what its edges cost.  Every second step is written to the shared folder.
    Loops and repeated edges are allowed; nodes of loops alone are left out.
    """
    now = written(
        edges.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    state = None
    while True:
        now = written(_star(_star(now, True).distinct(), False).distinct(), "stars")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == state:
            break
        state = mark
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    heads = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.union(heads)
