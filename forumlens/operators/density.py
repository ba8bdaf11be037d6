"""Density clusters with outliers and membership probabilities: a hierarchy of mutual-reachability levels, cut by excess of mass.

1. Equal vectors become one point with a number of copies. The cell index gives each point's nearest neighbours.
2. A point's core distance is that within which `samples` rows lie, itself included; an edge weighs the greatest of its length and
   both core distances. The minimum spanning forest of the neighbour graph holds all levels of the hierarchy.
3. The hierarchy is condensed from the top down: at each level, heaviest first, all edges of one weight go at once. Parts below `least` rows fall out
   of their cluster there; two or more larger parts are new clusters. The heaviest `limit` edges of a group are one task; the parts
   that hold together below them are groups of the next round, so no task holds more than that (but edges of one weight stay together).
4. A cluster's excess of mass sums, over its rows, how much longer (as 1 / distance) they stay than the cluster exists.
   From the leaves up a cluster is taken if it has no less than its parts together; the whole is never one cluster. A task takes as many
   depths of the hierarchy as have `limit` clusters together, so the number of jobs does not follow the depth.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import OUTLIER_TOPIC
from ..session import ship
from ..sources.scratch import Scratch
from .components import spanning_forest
from .vector_index import VectorIndex, usable

#: Distances below this count as this: copies of one vector part here, at the greatest density there is.
NEAREST = 1e-6
ROOT = "0-root"
STEP = "kind string, u long, cluster string, parent string, depth int, density double, mass double"


def neighbour_graph(points: DataFrame, k: int, scratch: Scratch, *, cells: int = 64, probes: int = 8, exact: bool = False) -> DataFrame:
    """points(id, vector, ...) -> a, b, d: each point's k nearest others by Euclidean distance of unit vectors."""
    index = VectorIndex.build(points, cells=cells)
    if exact:
        found = index.neighbours(k, digits=10)
    else:
        found = index.search(points, k + 1, probes=probes, digits=10, floor=None, staged=scratch.staged)
    pairs = found.where("query_id != id").select(F.col("query_id").alias("a"), F.col("id").alias("b"), F.sqrt(F.greatest(2 - 2 * F.col("score"), F.lit(0.0))).alias("d"))
    nth = F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))
    out = scratch.staged(pairs.withColumn("n", nth).where(F.col("n") <= k).drop("n"), "neighbours")
    index.remove()
    return out


def reachability(points: DataFrame, pairs: DataFrame, samples: int) -> DataFrame:
    """points(id, n), pairs(a, b, d) -> a, b, w: the greatest of d and both core distances."""
    near = pairs.join(points.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b").join(points.select(F.col("id").alias("a"), "n"), "a")
    upto = F.sum("nb").over(Window.partitionBy("a").orderBy("d", "b")) + F.col("n")
    core = F.when(F.first("n") >= samples, 0.0).otherwise(F.coalesce(F.min(F.when(F.col("upto") >= samples, F.col("d"))), F.max("d")))
    cores = near.withColumn("upto", upto).groupBy("a").agg(core.alias("core"))
    both = pairs.join(cores, "a").join(cores.toDF("b", "other"), "b", "left")
    return both.select("a", "b", F.greatest("d", "core", F.coalesce("other", F.lit(0.0)), F.lit(NEAREST)).alias("w"))


def condense(nodes: pd.DataFrame, edges: pd.DataFrame, least: int) -> list[tuple]:
    """One group's part of the condensed tree, as rows of STEP.

    nodes: u, size, single (whether it is one point), and the group's cluster, depth, density (of its birth); edges: u, v, w form a tree over u.
    """
    if not len(nodes):
        return []
    u, size, single = nodes["u"].to_numpy(), nodes["size"].to_numpy(), nodes["single"].to_numpy()
    at = {x: i for i, x in enumerate(u.tolist())}
    children: list[list[int]] = [[] for _ in u]
    weight, rows, first = [0.0] * len(u), size.tolist(), u.tolist()
    up, top = list(range(len(u))), list(range(len(u)))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    e = edges.sort_values("w")
    ends = [(at[a], at[b], w) for a, b, w in zip(e["u"].tolist(), e["v"].tolist(), e["w"].tolist())]
    i = 0
    while i < len(ends):
        w, merged = ends[i][2], {}
        while i < len(ends) and ends[i][2] == w:
            a, b = find(ends[i][0]), find(ends[i][1])
            if a != b:
                up[b] = a
                merged[a] = merged.get(a, [top[a]]) + merged.pop(b, [top[b]])
            i += 1
        for root, kids in merged.items():
            top[root] = len(children)
            children.append(kids)
            weight.append(w)
            rows.append(sum(rows[k] for k in kids))
            first.append(min(first[k] for k in kids))
    head = nodes.iloc[0]
    out: list[tuple] = []
    stack = [(top[find(0)], head["cluster"], int(head["depth"]), float(head["density"]))]
    while stack:
        node, cluster, depth, born = stack.pop()
        if not children[node]:
            if single[node]:
                out.append(("fall", first[node], cluster, None, None, 1 / NEAREST, None))
                out.append(("stay", None, cluster, None, None, 1 / NEAREST, rows[node] * (1 / NEAREST - born)))
            else:
                out.append(("go", first[node], cluster, None, depth, born, None))
            continue
        density = 1 / weight[node]
        large = [k for k in children[node] if rows[k] >= least]
        small = [k for k in children[node] if rows[k] < least]
        gone = sum(rows[k] for k in small)
        if len(large) > 1:
            gone += sum(rows[k] for k in large)
            for k in large:
                name = f"{depth + 1}-{first[k]}"
                out.append(("cluster", None, name, cluster, depth + 1, density, None))
                stack.append((k, name, depth + 1, density))
        elif large:
            stack.append((large[0], cluster, depth, born))
        if gone:
            out.append(("stay", None, cluster, None, None, density, gone * (density - born)))
        while small:
            k = small.pop()
            small += children[k]
            if not children[k]:
                out.append(("fall", first[k], cluster, None, None, density, None))
    return out


def _condensed(points: DataFrame, forest: DataFrame, components: DataFrame, least: int, limit: int, scratch: Scratch) -> DataFrame:
    """points(id, n), forest(a, b, w), components(id, component) -> rows of STEP whose u are points."""
    members = points.join(components, "id", "left").select("id", "n", F.coalesce("component", "id").alias("g"))
    sizes = members.groupBy("g").agg(F.sum("n").alias("size"))
    large = scratch.staged(sizes.where(F.col("size") >= least), "large")
    several = large.limit(2).count() > 1
    named = [F.concat(F.lit("1-"), "g") if several else F.lit(ROOT), F.lit(1 if several else 0)]
    groups = large.select("g", named[0].alias("cluster"), named[1].alias("depth"), F.lit(0.0).alias("density"))
    none = [F.lit(None).cast(t) for t in ("long", "string", "int", "double")]
    born = groups.select(F.lit("cluster").alias("kind"), none[0].alias("u"), "cluster", F.lit(ROOT if several else None).alias("parent"), "depth", "density", none[3].alias("mass"))
    lost = members.join(large, "g", "left_anti").select(F.lit("fall").alias("kind"), F.col("id").alias("u"), F.lit(ROOT).alias("cluster"), none[1].alias("parent"), none[2].alias("depth"), F.lit(0.0).alias("density"), none[3].alias("mass"))
    steps = [scratch.staged(born.union(lost), "steps")]
    members = scratch.staged(members.join(large, "g", "left_semi"), "members")
    edges = scratch.staged(forest.join(members.select(F.col("id").alias("a"), "g"), "a"), "edges")
    groups = scratch.staged(groups, "groups")
    while not groups.isEmpty():
        counts = edges.groupBy("g").agg(F.count("*").alias("k"))
        if counts.where(F.col("k") > limit).isEmpty():
            labelled = members.withColumn("u", F.col("id"))
            heavy, light = edges.withColumns({"u": F.col("a"), "v": F.col("b")}), None
        else:  # the limit-th heaviest edge of each group parts what this round takes from what it leaves
            cut = edges.join(counts, "g").groupBy("g").agg(F.max(F.when(F.col("k") <= limit, -1.0)).alias("all"), F.expr(f"percentile_approx(w, array({', '.join(str(i / 1000) for i in range(1000))}), 10000)").alias("q"), F.first("k").alias("k"), F.max("w").alias("top"))
            share = F.least(F.lit(999), F.ceil((1 - F.lit(float(limit)) / F.col("k")) * 1000).cast("int"))
            cut = cut.select("g", F.coalesce("all", F.least(F.col("q")[share], F.col("top"))).alias("cut"))
            split = scratch.staged(edges.join(cut, "g"), "split")
            light = split.where("w < cut").drop("cut")
            _, parts = spanning_forest(light.select("a", "b", "w"))
            labelled = scratch.staged(members.join(parts.withColumnRenamed("component", "u"), "id", "left").withColumn("u", F.coalesce("u", "id")), "labelled")
            heavy = scratch.staged(split.where("w >= cut").join(labelled.select(F.col("id").alias("a"), "u"), "a").join(labelled.select(F.col("id").alias("b"), F.col("u").alias("v")), "b"), "heavy")
        nodes = labelled.groupBy("g", "u").agg(F.sum("n").alias("size"), (F.count("*") == 1).alias("single")).join(groups, "g")
        nodes = scratch.staged(nodes, "nodes")
        task = lambda n, e: pd.DataFrame(condense(n, e, least), columns=[c.split()[0] for c in STEP.split(", ")])
        step = scratch.staged(nodes.groupBy("g").cogroup(heavy.select("g", "u", "v", "w").groupBy("g")).applyInPandas(task, STEP), "step")
        fell = step.where("kind = 'fall'").join(labelled.select("id", "u"), "u").select("kind", F.col("id").alias("u"), "cluster", "parent", "depth", "density", "mass")
        steps.append(scratch.staged(step.where("kind in ('cluster', 'stay')").union(fell), "steps"))
        groups = scratch.staged(step.where("kind = 'go'").select(F.col("u").alias("g"), "cluster", "depth", "density"), "groups")
        if light is not None:
            members = scratch.staged(labelled.join(groups.select(F.col("g").alias("u")), "u").select("id", "n", F.col("u").alias("g")), "members")
            edges = scratch.staged(light.drop("g").join(members.select(F.col("id").alias("a"), "g"), "a"), "edges")
    out = steps[0]
    for s in steps[1:]:
        out = out.union(s)
    return out


def _bands(counts: list[tuple[int, int]], limit: int) -> list[tuple[int, int, int]]:
    """(depth, clusters) in order -> first and last depth, clusters: bands of depths with `limit` clusters at most, or of one depth."""
    out: list[tuple[int, int, int]] = []
    for depth, n in counts:
        if out and out[-1][2] + n <= limit:
            out[-1] = (out[-1][0], depth, out[-1][2] + n)
        else:
            out.append((depth, depth, n))
    return out


def weighed(band: pd.DataFrame) -> pd.DataFrame:
    """cluster, parent, depth, mass, below (what its parts under the band have at best) -> with taken and best, from the leaves up."""
    band = band.sort_values(["depth", "cluster"], ascending=False)
    below: dict[str, float] = {}
    rows = []
    for cluster, parent, depth, mass, more in zip(*(band[c].tolist() for c in ("cluster", "parent", "depth", "mass", "below"))):
        parts = more + below.get(cluster, 0.0)
        rows.append((cluster, parent, depth, mass >= parts, max(mass, parts)))
        below[parent] = below.get(parent, 0.0) + rows[-1][4]
    return pd.DataFrame(rows, columns=["cluster", "parent", "depth", "taken", "best"])


def named(band: pd.DataFrame) -> pd.DataFrame:
    """cluster, parent, depth, taken, above (what was taken over the band) -> cluster, chosen, from the top down."""
    band = band.sort_values(["depth", "cluster"])
    chosen: dict[str, str | None] = {}
    for cluster, parent, taken, above in zip(*(band[c].tolist() for c in ("cluster", "parent", "taken", "above"))):
        chosen[cluster] = chosen.get(parent) or (above if isinstance(above, str) else None) or (cluster if taken else None)
    return pd.DataFrame({"cluster": list(chosen), "chosen": pd.Series(list(chosen.values()), dtype=object)})


def _chosen(steps: DataFrame, scratch: Scratch, limit: int) -> DataFrame:
    """Condensed steps -> cluster, chosen: the taken cluster that each lies in, if any. Depths go by in bands of `limit` clusters, a task each."""
    stayed = steps.where("kind = 'stay'").groupBy("cluster").agg(F.sum("mass").alias("mass"))
    tree = steps.where("kind = 'cluster' and depth > 0").select("cluster", "parent", "depth").join(stayed, "cluster", "left").na.fill(0.0, ["mass"])
    tree = scratch.staged(tree, "tree")
    bands = _bands(sorted(map(tuple, tree.groupBy("depth").count().collect())), limit)  # one row a depth
    key = lambda lo, hi, n: F.pmod(F.xxhash64("cluster"), F.lit(-(-n // limit) if lo == hi else 1))
    upward, below = [], None
    for lo, hi, n in reversed(bands):
        band = tree.where(F.col("depth").between(lo, hi))
        band = band.withColumn("below", F.lit(0.0)) if below is None else band.join(below, "cluster", "left").na.fill(0.0, ["below"])
        done = scratch.staged(band.groupBy(key(lo, hi, n)).applyInPandas(weighed, "cluster string, parent string, depth int, taken boolean, best double"), "band")
        upward.append((done, (lo, hi, n)))
        below = done.where(F.col("depth") == lo).groupBy(F.col("parent").alias("cluster")).agg(F.sum("best").alias("below"))
    out = last = None
    for done, (lo, hi, n) in reversed(upward):
        band = done.withColumn("above", F.lit(None).cast("string")) if last is None else done.join(last.toDF("parent", "above"), "parent", "left")
        last = scratch.staged(band.groupBy(key(lo, hi, n)).applyInPandas(named, "cluster string, chosen string"), "named")
        out = last if out is None else out.union(last)
    return out if out is not None else steps.select("cluster", F.col("cluster").alias("chosen")).limit(0)


def density_clusters(vectors: DataFrame, *, least: int = 30, samples: int | None = None, neighbours: int | None = None, cells: int = 64, probes: int = 8, exact: bool = False, limit: int = 500_000) -> DataFrame:
    """vectors(id, vector) -> id, topic_id, probability. Topics are numbered by size; -1 holds the rows of no cluster, with probability 0.

    `least` rows make a cluster, `samples` of them (as many by default) the core distance; `neighbours` edges a point form the graph.
    Rows without an id or with a vector that is null, empty or not finite are left out; equal vectors share their topic. The result is a staged table.
    """
    spark = vectors.sparkSession
    ship(spark)
    samples = samples or least
    k = max(samples, neighbours or samples)
    with Scratch(spark) as scratch:
        rows = scratch.staged(usable(vectors), "rows")
        points = scratch.staged(rows.groupBy("vector").agg(F.min("id").alias("id"), F.count("*").alias("n")), "points")
        pairs = neighbour_graph(points, k, scratch, cells=cells, probes=probes, exact=exact)
        graph = scratch.staged(reachability(points.select("id", "n"), pairs, samples), "graph")
        forest, components = spanning_forest(graph)
        steps = scratch.staged(_condensed(points.select("id", "n"), forest, components, least, limit, scratch), "steps")
        chosen = scratch.staged(_chosen(steps, scratch, limit), "chosen")
        ends = steps.where("kind = 'stay'").groupBy(F.col("cluster").alias("chosen")).agg(F.max("density").alias("end"))
        fell = steps.where("kind = 'fall'").select(F.col("u").alias("id"), "cluster", "density").join(chosen, "cluster", "left").join(ends, "chosen", "left")
        share = F.when(F.col("chosen").isNull(), 0.0).otherwise(F.least("density", "end") / F.col("end"))
        placed = scratch.staged(points.join(fell.select("id", "chosen", share.alias("probability")), "id").select("vector", "id", "n", "chosen", "probability"), "placed")
        topics = placed.where("chosen is not null").groupBy("chosen").agg(F.sum("n").alias("n"), F.min("id").alias("id"))
        numbered = topics.select("chosen", (F.row_number().over(Window.orderBy(F.desc("n"), "id")) - 1).alias("topic_id"))  # one row a topic
        out = placed.join(numbered, "chosen", "left").select("vector", F.coalesce("topic_id", F.lit(OUTLIER_TOPIC)).alias("topic_id"), "probability")
        return scratch.keep(scratch.staged(rows.join(out, "vector").select("id", "topic_id", "probability"), "clusters"))
