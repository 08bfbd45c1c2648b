"""Connected components of an edge table, as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotline.session import stage, unstage


def connected_components(edges: DataFrame) -> DataFrame:
    """v, root of every end of the edges (a, b: long): root is the smallest v of its component.

    In a round every vertex points to its smallest neighbour if that is smaller, pointers are followed
    once more, vertices already placed move to where their root went, and the edges go on between the
    ends' new places; edges within one place drop out.  Paths shorten fourfold a round, and a star
    takes one, so rounds grow with the logarithm of the longest path.  Each round is written under
    ``spark.checkpoint.dir``, which cuts lineage; the caller removes the result."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    live = stage(both.where("a <> b").distinct(), "component-edges")
    placed = stage(both.select(F.col("a").alias("v"), F.col("a").alias("root")).distinct(), "component-roots")
    while not live.isEmpty():
        point = stage(live.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")), "component-points")
        after = point.select(F.col("a").alias("to"), F.col("to").alias("then"))
        step = stage(point.join(after, "to").select("a", "then"), "component-steps")
        moved = placed.join(step.withColumnRenamed("a", "root"), "root", "left").select("v", F.coalesce("then", "root").alias("root"))
        moved = stage(moved, "component-roots")
        ends = (live.join(step.select("a", F.col("then").alias("x")), "a")
                .join(step.select(F.col("a").alias("b"), F.col("then").alias("y")), "b"))
        rest = stage(ends.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "component-edges")
        unstage(live, placed, point, step)
        live, placed = rest, moved
    unstage(live)
    return placed
