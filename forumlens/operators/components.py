"""Minimum spanning forests and components by rounds in which every component picks its least edge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select("a", "b", "w", F.col("cb").alias("ca"), F.col("ca").alias("cb")))


def _roots(picked: DataFrame, scratch: Scratch) -> DataFrame:
    """picked(c, other): each component's choice -> c, root. Choices form trees whose two topmost choose each other; the lesser is the root.

    Chains are halved in every round (pointer doubling).
    """
    back = picked.select(F.col("c").alias("other"), F.col("other").alias("again"))
    up = picked.join(back, "other").select("c", F.when((F.col("again") == F.col("c")) & (F.col("c") < F.col("other")), F.col("c")).otherwise(F.col("other")).alias("root"))
    up = scratch.staged(up, "up")
    while True:
        above = up.select(F.col("c").alias("root"), F.col("root").alias("top"))
        new = scratch.staged(up.join(above, "root").select("c", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")), "up")
        scratch.drop(up)
        up = new
        if up.where("moved").isEmpty():
            return up.select("c", "root")


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges(a, b, w) between longs -> (the minimum spanning forest's edges a < b, w; and id, component for every end of an edge).

    Equal weights are ordered by the ends, so the forest is one; a component is called by its least id. In each round edges inside a component go,
    of several edges between two components the least stays, and the number of components falls by half at least. Both results are staged tables.
    """
    spark = edges.sparkSession
    with Scratch(spark) as scratch:
        lo, hi = F.least("a", "b"), F.greatest("a", "b")
        left = edges.where("a != b").select(lo.alias("a"), hi.alias("b"), "w").groupBy("a", "b").agg(F.min("w").alias("w"))
        left = scratch.staged(left.withColumns({"ca": F.col("a"), "cb": F.col("b")}), "edges")
        names = scratch.staged(left.select(F.col("a").alias("id")).union(left.select("b")).distinct().withColumn("component", F.col("id")), "names")
        forest = []
        while not left.isEmpty():
            least = both_ways(left).groupBy(F.col("ca").alias("c")).agg(F.min(F.struct("w", "a", "b", "cb")).alias("e"))
            picked = scratch.staged(least.select("c", F.col("e.cb").alias("other"), "e.a", "e.b", "e.w"), "picked")
            forest.append(scratch.staged(picked.select("a", "b", "w").distinct(), "forest"))
            roots = _roots(picked.select("c", "other"), scratch)
            one, two = roots.toDF("ca", "ra"), roots.toDF("cb", "rb")
            moved = left.join(one, "ca").join(two, "cb").where("ra != rb")
            pair = [F.least("ra", "rb").alias("ca"), F.greatest("ra", "rb").alias("cb")]
            fewer = moved.groupBy(*pair).agg(F.min(F.struct("w", "a", "b")).alias("e")).select("e.a", "e.b", "e.w", "ca", "cb")
            fewer = scratch.staged(fewer, "edges")
            renamed = names.join(roots.toDF("component", "root"), "component", "left")
            renamed = scratch.staged(renamed.select("id", F.coalesce("root", "component").alias("component")), "names")
            scratch.drop(left, names, picked)
            left, names = fewer, renamed
        out = left.select("a", "b", "w")  # by now empty
        for part in forest:
            out = out.union(part)
        least_id = names.groupBy("component").agg(F.min("id").alias("least"))
        labels = names.join(least_id, "component").select("id", F.col("least").alias("component"))
        return scratch.keep(scratch.staged(out, "forest")), scratch.keep(scratch.staged(labels, "components"))
