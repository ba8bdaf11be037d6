import math

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from forumlens.operators import components as C
from forumlens.operators import density as D


def parts(ids, edges):
    """Connected parts of a graph, by plain search."""
    near = {i: set() for i in ids}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    out, seen = [], set()
    for i in ids:
        if i not in seen:
            stack, part = [i], set()
            while stack:
                x = stack.pop()
                if x not in part:
                    part.add(x)
                    stack += near[x]
            seen |= part
            out.append(part)
    return out


def plain(rows, least, samples, k):
    """The same clusters from all pairs and all edges of the neighbour graph, level by level, without a spanning tree."""
    copies = {}
    for i, v in rows:
        copies.setdefault(tuple(v), []).append(i)
    points = {min(x): (np.array(v), len(x), x) for v, x in copies.items()}
    ids = sorted(points)
    m = np.array([points[i][0] for i in ids])
    m = m / np.where(np.linalg.norm(m, axis=1, keepdims=True) > 0, np.linalg.norm(m, axis=1, keepdims=True), 1)
    d = np.sqrt(np.maximum(2 - 2 * np.round(m @ m.T, 10), 0))
    near, core = {}, {}
    for x, i in enumerate(ids):
        near[i] = sorted((d[x, y], j) for y, j in enumerate(ids) if j != i)[:k]
        n, core[i] = points[i][1], 0.0
        for far, j in near[i]:
            if n >= samples:
                break
            n, core[i] = n + points[j][1], far
    weight = {}
    for i in ids:
        for far, j in near[i]:
            weight[min(i, j), max(i, j)] = max(far, core[i], core[j], D.NEAREST)
    size = lambda part: sum(points[i][1] for i in part)
    mass, end, tree, fell = {}, {}, {}, {}

    def walk(part, name, depth, born):
        inner = {e: w for e, w in weight.items() if e[0] in part and e[1] in part}
        while True:
            if len(part) == 1:
                [i] = part
                density, pieces = 1 / D.NEAREST, [set()]
                fell[i] = (name, density)
                mass[name] = mass.get(name, 0) + size(part) * (density - born)
                end[name] = density
                return
            top = max(inner.values())
            pieces = parts(sorted(part), [e for e, w in inner.items() if w < top])
            inner = {e: w for e, w in inner.items() if w < top}
            if len(pieces) == 1:
                continue
            density = 1 / top
            large, small = [p for p in pieces if size(p) >= least], [p for p in pieces if size(p) < least]
            for p in small:
                for i in p:
                    fell[i] = (name, density)
            gone = sum(map(size, small)) + (sum(map(size, large)) if len(large) > 1 else 0)
            if gone:
                mass[name] = mass.get(name, 0) + gone * (density - born)
                end[name] = density
            if len(large) != 1:
                for p in large:
                    child = (depth + 1, min(p))
                    tree[child] = name
                    walk(p, child, depth + 1, density)
                return
            [part] = large
            inner = {e: w for e, w in inner.items() if e[0] in part and e[1] in part}

    first = parts(ids, weight)
    large = [p for p in first if size(p) >= least]
    for p in first:
        if size(p) < least:
            fell.update({i: ("root", 0.0) for i in p})
    if len(large) == 1:
        walk(large[0], "root", 0, 0.0)
    for p in large if len(large) > 1 else []:
        tree[1, min(p)] = "root"
        walk(p, (1, min(p)), 1, 0.0)
    best, taken = {}, {}
    for c in sorted(tree, reverse=True):
        below = sum(best[x] for x, up in tree.items() if up == c)
        taken[c], best[c] = mass.get(c, 0) >= below, max(mass.get(c, 0), below)

    def owner(c):
        chain = []
        while c != "root":
            chain.append(c)
            c = tree[c]
        return next((x for x in reversed(chain) if taken[x]), None)

    out = {}
    for i in ids:
        c, density = fell[i]
        o = owner(c)
        for j in points[i][2]:
            out[j] = (o, 0.0 if o is None else min(density, end[o]) / end[o])
    rank = sorted({o for o, _ in out.values() if o}, key=lambda o: (-sum(x == o for x, _ in out.values()), min(i for i in ids if out[i][0] == o)))
    number = {o: k for k, o in enumerate(rank)} | {None: -1}
    return {i: (number[o], p) for i, (o, p) in out.items()}


def blobs(seed, n, dims=6, noise=30):
    r = np.random.default_rng(seed)
    heart = r.normal(size=(4, dims))
    rows = [(i, (heart[i % 4] + (0.12 + 0.1 * (i % 4)) * r.normal(size=dims)).round(3)) for i in range(n)]
    rows += [(n + i, r.normal(size=dims).round(3)) for i in range(noise)]
    return [(i, np.array(v, np.float32).astype(float)) for i, v in rows]


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "id long, vector array<double>")
    return {r.id: (r.topic_id, r.probability) for r in D.density_clusters(df, exact=True, cells=4, probes=1, **options).collect()}


def same(got, want):
    assert got.keys() == want.keys()
    assert {i: t for i, (t, _) in got.items()} == {i: t for i, (t, _) in want.items()}
    assert all(math.isclose(got[i][1], want[i][1], rel_tol=1e-6, abs_tol=1e-9) for i in want)


@pytest.mark.parametrize("limit", [500_000, 25])
def test_equals_a_plain_hierarchy(spark, limit):
    rows = blobs(7, 160)
    want = plain(rows, 12, 6, 8)
    assert {t for t, _ in want.values()} == {-1, 0, 1, 2, 3}
    same(found(spark, rows, least=12, samples=6, neighbours=8, limit=limit), want)


def test_copies_are_a_cluster_and_odd_rows_stay_out(spark):
    rows = blobs(2, 60, noise=5)
    rows += [(1000 + i, rows[0][1]) for i in range(40)]
    same(found(spark, [*rows, (2000, [float("nan")] * 6)], least=15, samples=5), plain(rows, 15, 5, 5))


def test_nothing_dense_is_all_outliers(spark):
    r = np.random.default_rng(3)
    got = found(spark, [(i, r.normal(size=8)) for i in range(12)], least=20)
    assert set(got.values()) == {(-1, 0.0)} and len(got) == 12
    assert found(spark, [], least=20) == {}


def test_spanning_forest_equals_a_plain_one(spark):
    r = np.random.default_rng(4)
    for n, m in ((40, 60), (30, 20), (5, 10)):
        edges = [(int(a), int(b), float(w)) for a, b, w in zip(r.integers(0, n, m), r.integers(0, n, m), r.integers(1, 6, m))]
        up = {i: i for i in range(n)}

        def find(i):
            while up[i] != i:
                i = up[i]
            return i

        want = set()
        for w, a, b in sorted((w, min(a, b), max(a, b)) for a, b, w in edges if a != b):
            if find(a) != find(b):
                up[max(find(a), find(b))] = min(find(a), find(b))
                want.add((a, b, w))
        forest, names = C.spanning_forest(spark.createDataFrame(edges, "a long, b long, w double"))
        assert set(map(tuple, forest.collect())) == want
        ends = {x for a, b, _ in edges if a != b for x in (a, b)}
        assert {(r_.id, r_.component) for r_ in names.collect()} == {(i, find(i)) for i in ends}


def test_one_task_holds_no_more_than_its_edges():
    nodes = pd.DataFrame({"u": [1, 2, 3], "size": [5, 4, 1], "single": [False, False, True], "cluster": "c", "depth": 1, "density": 0.0})
    out = D.condense(nodes, pd.DataFrame({"u": [1, 2], "v": [2, 3], "w": [0.5, 1.0]}), 4)
    assert ("fall", 3, "c", None, None, 1.0, None) in out and [x for x in out if x[0] == "go"] == [("go", 2, "2-2", None, 2, 2.0, None), ("go", 1, "2-1", None, 2, 2.0, None)]
    assert sum(x[6] for x in out if x[0] == "stay") == 1 * 1.0 + 9 * 2.0


def test_the_registered_query(spark, sf):
    got = {r.id: (r.topic_id, r.probability) for r in entry.queries()["topic_density"](spark, sf).collect()}
    t = pq.read_table(f"{sf}/embeddings.parquet")
    rows = [(i, np.array(v, float)) for i, v in zip(t.column("vec_id").to_pylist(), t.column("embedding").to_pylist())]
    want = plain(rows, 10, 3, 15)
    assert {i: (t, round(p, 6)) for i, (t, p) in want.items()} == got


def test_jobs_do_not_follow_the_depth_of_the_hierarchy(spark):
    """A chain of 40 clusters, each with a leaf beside it; two staged tables a depth before."""
    names = [(f"{k}-{side}", None if k == 1 else f"{k - 1}-a", k) for k in range(1, 41) for side in "ab"]
    names = [(c, p or D.ROOT, k) for c, p, k in names]
    mass = {c: (50.0 if c in ("7-a", "3-b") else 1.0) for c, _, _ in names}
    rows = [("cluster", None, c, p, k, 1.0, None) for c, p, k in names] + [("stay", None, c, None, None, 1.0, m) for c, m in mass.items()]
    steps = spark.createDataFrame(rows, D.STEP)
    want = {c: c if c.endswith("b") and k <= 7 else "7-a" if c == "7-a" or k > 7 else None for c, _, k in names}
    for limit, most in ((500, 4), (20, 16)):
        made = []

        class Counted(D.Scratch):
            def staged(self, df, name):
                made.append(name)
                return super().staged(df, name)

        with Counted(spark) as scratch:
            assert {r.cluster: r.chosen for r in D._chosen(steps, scratch, limit).collect()} == want
        assert len(made) <= most + 1
