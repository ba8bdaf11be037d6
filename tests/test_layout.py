import numpy as np
import pandas as pd
import pytest

from forumlens.operators import layout as L
from forumlens.operators import vector_index as V
from forumlens.operators.vector_index import unit


def table(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "id long, vector array<double>").repartition(3)


def sheet(n=300, dims=24, seed=3):
    """Points of twelve groups on strips in many dimensions."""
    r = np.random.default_rng(seed)
    base = r.normal(size=(12, 2, dims))
    rows = []
    for i in range(n):
        t = r.random() * 2
        rows.append((i, base[i % 12, 0] + t * base[i % 12, 1] + 0.05 * r.normal(size=dims)))
    return rows


def kept_neighbours(v, y, k=10):
    """The share of each point's k nearest (by cosine) that are among its k nearest in the layout."""
    u = unit(np.array(v))
    near = np.argsort(2 - 2 * (u @ u.T) + 9 * np.eye(len(u)), axis=1)[:, :k]
    d = ((y[:, None] - y[None]) ** 2).sum(axis=2) + 1e9 * np.eye(len(y))
    lay = np.argsort(d, axis=1)[:, :k]
    return np.mean([len(set(a) & set(b)) / k for a, b in zip(near, lay)])


def run(spark, rows, **options):
    got = {r.id: (r.x, r.y) for r in L.layout(table(spark, rows), exact=True, cells=4, probes=1, **options).collect()}
    assert got.keys() == {i for i, _ in rows}
    return np.array([got[i] for i, _ in rows])


@pytest.mark.parametrize("part", [20_000, 120])
def test_keeps_more_neighbours_than_principal_axes(spark, monkeypatch, part):
    monkeypatch.setattr(L, "PART", part)
    rows = sheet()
    v = np.array([x for _, x in rows])
    u = v - v.mean(axis=0)
    axes = np.linalg.svd(u, full_matrices=False)[2][:2]
    flat = kept_neighbours(v, u @ axes.T)
    y = run(spark, rows, rounds=6, epochs=20)
    assert 1 - kept_neighbours(v, y) < 0.7 * (1 - flat), "a third fewer neighbours are lost"
    own = np.array([i % 12 for i, _ in rows])
    d = ((y[:, None] - y[None]) ** 2).sum(axis=2) + 1e9 * np.eye(len(y))
    assert (own[d.argmin(axis=1)] == own).mean() > 0.95


def test_a_seed_gives_one_layout(spark):
    rows = sheet(80)
    a, b, c = (run(spark, rows, rounds=2, epochs=3, seed=s) for s in (1, 1, 2))
    assert (a == b).all() and (a != c).any() and np.isfinite(a).all()


def test_weights_of_neighbours():
    r = np.random.default_rng(1)
    d = np.sort(r.random((50, 15)), axis=1)
    w = L.memberships(d)
    assert np.allclose(w.sum(axis=1), np.log2(15), atol=1e-6) and np.allclose(w[:, 0], 1) and (np.diff(w, axis=1) <= 0).all()


def test_curve_is_near_the_known_one():
    a, b = L.curve(0.1)
    assert abs(a - 1.577) < 0.02 and abs(b - 0.895) < 0.02


def test_graph_is_symmetric(spark):
    pairs = spark.createDataFrame([(1, 2, 0.1), (1, 3, 0.4), (2, 1, 0.1), (2, 3, 0.2), (3, 1, 0.4), (3, 2, 0.2), (4, 1, 0.9)], "a long, b long, d double")
    w = {(r.a, r.b): r.w for r in L.fuzzy_graph(pairs).collect()}
    assert all(abs(w[a, b] - w[b, a]) < 1e-12 and 0 < x <= 1 for (a, b), x in w.items()) and len(w) == 8


def test_ends_outside_the_part_stand_still():
    points = pd.DataFrame({"id": [5, 1], "x": [1.0, 0.0], "y": [0.0, 0.0]})
    edges = pd.DataFrame({"a": [1], "b": [9], "w": [1.0], "bx": [3.0], "by": [0.0]})
    out = L.moved(points, edges, 1.5, 0.9, [0.1] * 5, [0])
    assert out["id"].tolist() == [1, 5] and out["x"][0] != 0.0 and out["x"][1] == 1.0


def test_equal_and_odd_vectors(spark):
    rows = sheet(60)
    rows += [(100, rows[0][1]), (101, rows[0][1])]
    df = table(spark, rows).union(spark.createDataFrame([(200, None), (201, [])], "id long, vector array<double>"))
    got = {r.id: (r.x, r.y) for r in L.layout(df, rounds=1, epochs=2).collect()}
    assert got[0] == got[100] == got[101] and 200 not in got and 201 not in got and len(got) == 62


def test_no_task_holds_a_vector_once_a_cell(spark, monkeypatch):
    """The rows of a batch were held with all cells that they ask, 64 times the batch."""
    batch = pd.DataFrame({"query_id": range(50), "vector": [np.ones(4)] * 50})
    at, cell = np.nonzero(np.ones((50, 9), bool))
    monkeypatch.setattr(V, "BLOCK", 100)
    parts = list(V.asked_of(batch, at, cell))
    assert max(map(len, parts)) == 100 and sum(map(len, parts)) == 450 and pd.concat(parts)["cell"].tolist() == cell.tolist()

    def probed(*_):
        raise AssertionError("vectors are paired with cells")

    monkeypatch.setattr(V.VectorIndex, "probed", probed)
    run(spark, sheet(40), rounds=1, epochs=1)
