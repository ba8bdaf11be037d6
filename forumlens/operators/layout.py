"""A two-dimensional layout that keeps neighbourhoods: a fuzzy neighbour graph, and sampled-edge descent in rounds over random parts.

The graph has each point's nearest neighbours, weighted so that every point sees the same local density. Points begin on the two principal axes.
A round deals all points at random to parts of PART points at most; a task moves its own points for some epochs, pulled
along their edges (drawn in proportion to weight; ends outside the part stand still meanwhile) and pushed by random points of the part, which
are a random sample of all. Draws come from the seed, the round and the part, and rows are sorted first, so a lost task repeats exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vector import projected
from ..session import ship
from ..sources.scratch import Scratch
from .density import neighbour_graph
from .vector_index import usable

#: Points moved in one task, and pushes an edge.
PART, PUSHES = 20_000, 5
#: Edges of a part that move at once.
BATCH = 4096


def curve(least: float, spread: float = 1.0) -> tuple[float, float]:
    """a, b of 1 / (1 + a x**2b), fitted to 1 up to `least` and exp(-(x - least) / spread) beyond."""
    x = np.linspace(0, 3 * spread, 300)
    y = np.where(x < least, 1.0, np.exp(-(x - least) / spread))
    best = (np.inf, 1.0, 1.0)
    a_range, b_range = np.linspace(0.2, 5, 40), np.linspace(0.3, 2, 40)
    for _ in range(6):
        for a in a_range:
            for b in b_range:
                off = ((1 / (1 + a * x ** (2 * b)) - y) ** 2).sum()
                best = min(best, (off, a, b))
        da, db = a_range[1] - a_range[0], b_range[1] - b_range[0]
        a_range, b_range = np.linspace(max(1e-3, best[1] - da), best[1] + da, 15), np.linspace(max(1e-3, best[2] - db), best[2] + db, 15)
    return best[1], best[2]


def memberships(d: np.ndarray, rounds: int = 64) -> np.ndarray:
    """Distances [point, neighbour] in order (nan: none) -> weights: 1 for the nearest, summing to log2 of the number of neighbours."""
    n = (~np.isnan(d)).sum(axis=1)
    over = np.nan_to_num(np.maximum(d - d[:, :1], 0), nan=np.inf)
    target = np.log2(np.maximum(n, 2))
    low, high = np.zeros(len(d)), np.full(len(d), 1e3)
    for _ in range(rounds):
        mid = (low + high) / 2
        more = np.exp(-over / np.maximum(mid, 1e-12)[:, None]).sum(axis=1) > target
        high, low = np.where(more, mid, high), np.where(more, low, mid)
    return np.exp(-over / np.maximum((low + high) / 2, 1e-12)[:, None])


def fuzzy_graph(pairs: DataFrame) -> DataFrame:
    """pairs(a, b, d) -> a, b, w in both directions: p + q - pq of the two points' weights for each other."""

    def weigh(batches):
        for batch in batches:
            near = batch["near"].flatten()
            size = np.diff(batch["near"].offsets.to_numpy())
            row = np.repeat(np.arange(len(size)), size)
            column = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            d = np.full((len(size), int(size.max(initial=0))), np.nan)
            d[row, column] = near.field("d").to_numpy(zero_copy_only=False)
            w = memberships(d)[row, column] if d.size else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch["a"].take(pa.array(row)), near.field("b"), pa.array(w)], names=["a", "b", "w"])

    lists = pairs.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("d", "b"))).alias("near"))  # as many as neighbours asked for
    one = lists.mapInArrow(weigh, "a long, b long, w double")
    both = one.union(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    total = both.groupBy("a", "b").agg(F.sum("w").alias("s"), F.when(F.count("*") == 2, F.min("w") * F.max("w")).otherwise(0.0).alias("p"))
    return total.select("a", "b", (F.col("s") - F.col("p")).alias("w"))


def moved(points: pd.DataFrame, edges: pd.DataFrame, a: float, b: float, rates: list[float], seed: list[int]) -> pd.DataFrame:
    """One part's epochs. points: id, x, y; edges: a (a point of the part), b, w, bx, by (where b stood before the round)."""
    points, edges = points.sort_values("id"), edges.sort_values(["a", "b"])
    r = np.random.default_rng(seed)
    ids, y = points["id"].to_numpy(), points[["x", "y"]].to_numpy(float)
    far, at = np.unique(edges["b"].to_numpy(), return_inverse=True)
    still = np.zeros((len(far), 2))
    still[at] = edges[["bx", "by"]].to_numpy(float)
    own = np.searchsorted(ids, far)
    here = (own < len(ids)) & (ids[np.minimum(own, len(ids) - 1)] == far)
    i, j = np.searchsorted(ids, edges["a"].to_numpy()), at
    chance = edges["w"].to_numpy() / max(edges["w"].max(), 1e-12) if len(edges) else np.zeros(0)
    for rate in rates:
        drawn = r.permutation(np.flatnonzero(r.random(len(i)) < chance))
        for k in range(0, len(drawn), BATCH):
            e = drawn[k : k + BATCH]
            other = np.where(here[j[e], None], y[np.minimum(own[j[e]], len(ids) - 1)], still[j[e]])
            off = y[i[e]] - other
            d2 = (off**2).sum(axis=1, keepdims=True)
            with np.errstate(divide="ignore", invalid="ignore"):
                pull = np.where(d2 > 0, -2 * a * b * d2 ** (b - 1) / (1 + a * d2**b), 0.0)
            step = np.clip(pull * off, -4, 4)
            for _ in range(PUSHES):
                off = y[i[e]] - y[r.integers(0, len(ids), len(e))]
                d2 = (off**2).sum(axis=1, keepdims=True)
                step += np.where(d2 > 0, np.clip(2 * b / ((0.001 + d2) * (1 + a * d2**b)) * off, -4, 4), 0.0)
            count = np.bincount(i[e], minlength=len(ids))[i[e], None]  # several moves of one point in a batch are averaged
            np.add.at(y, i[e], rate * step / np.sqrt(count))
    return pd.DataFrame({"id": ids, "x": y[:, 0], "y": y[:, 1]})


def _epochs(a: float, b: float, rates: list[float], seed: int, turn: int):
    def task(key, points: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        return moved(points, edges, a, b, rates, [seed, turn, int(key[0])])

    return task


def layout(vectors: DataFrame, *, neighbours: int = 15, least: float = 0.1, rounds: int = 12, epochs: int = 15, seed: int = 42, cells: int = 64, probes: int = 8, exact: bool = False) -> DataFrame:
    """vectors(id, vector) -> id, x, y: near vectors come to lie near each other. The result is a staged table.

    Rows without an id or with a vector that is null, empty or not finite are left out; equal vectors lie at one place.
    """
    spark = vectors.sparkSession
    ship(spark)
    a, b = curve(least)
    with Scratch(spark) as scratch:
        rows = scratch.staged(usable(vectors), "rows")
        points = scratch.staged(rows.groupBy("vector").agg(F.min("id").alias("id")).select("id", "vector"), "points")
        n = points.count()
        pairs = neighbour_graph(points, neighbours, scratch, cells=cells, probes=probes, exact=exact)
        graph = scratch.staged(fuzzy_graph(pairs), "graph")
        jitter = lambda k: (F.pmod(F.xxhash64("id", F.lit(seed + k)), F.lit(10_000)) / 10_000 - 0.5) * 1e-3
        at = projected(points).select("id", (F.col("x") * 10 + jitter(0)).alias("x"), (F.col("y") * 10 + jitter(1)).alias("y"))
        at = scratch.staged(at, "at")
        parts = max(1, -(-n // PART))
        rates = [1 - t / (rounds * epochs) for t in range(rounds * epochs)]
        for k in range(rounds):
            part = F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(parts)).cast("int")
            own = at.withColumn("part", part)
            ends = graph.join(at.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by")), "b").join(own.select(F.col("id").alias("a"), "part"), "a")
            ends = scratch.staged(ends, "ends")
            now = rates[k * epochs : (k + 1) * epochs]

            new = own.groupBy("part").cogroup(ends.groupBy("part")).applyInPandas(_epochs(a, b, now, seed, k), "id long, x double, y double")
            new = scratch.staged(new, "at")
            scratch.drop(at, ends)
            at = new
        placed = points.join(at, "id").select("vector", "x", "y")
        return scratch.keep(scratch.staged(rows.join(placed, "vector").select("id", "x", "y"), "layout"))
