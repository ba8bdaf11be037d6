"""Connected components by alternating large-star and small-star rounds over staged edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import stage, unstage


def _staged(edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """The staged table, and the count and checksum of its rows, taken while it is written."""
    seen = Observation()
    hashed = F.xxhash64("u", "v").cast("decimal(38,0)")
    table = stage(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(hashed).alias("sum")), name)
    return table, (seen.get["n"], seen.get["sum"])


def components(links: DataFrame) -> DataFrame:
    """links(a long, b long) -> (id, component): the least id reachable; ids without a link have no row.

    Nothing but one count and one checksum per round reaches the driver. A node with very many
    neighbours is pre-aggregated (its least neighbour) and joined back, never gathered.
    Null ids and self links are ignored; no links give no rows.
    """
    edges = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, seen = _staged(edges, "edges")
    while seen[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        before, was = seen, edges
        edges, seen = _staged(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        unstage(large, was)
        if seen == before:
            break
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
