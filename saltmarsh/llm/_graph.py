"""Connected components of a graph given by its edges, as joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm._store import dropped, stored


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One large-star or small-star step over edges (u, v) with u > v."""
    mins = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    mins = mins.groupBy("u").agg(F.min("v").alias("m"))
    if small:  # all smaller neighbours, and the node itself, to the smallest one
        moved = edges.join(mins, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.unionByName(mins.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
    # all larger neighbours to the smallest one of the node and its neighbours
    larger = edges.select(F.col("v").alias("w"), F.col("u").alias("x"))
    least = mins.select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return larger.join(least, "w").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has an edge to another one; component: the smallest node that it reaches.

    Alternates large-star and small-star steps until the edges are stars; each round is written to the shared folder.
    """
    high, low = F.greatest(a, b), F.least(a, b)
    now = stored(edges.select(high.alias("u"), low.alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        if not state[0]:
            break
        after = stored(_star(_star(now, small=False), small=True), "edges")
        dropped(now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
