"""The queries that SQL cannot express, against plain NumPy over the same tables."""

import collections
import datetime as dt

import numpy as np
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from forumlens.operators import series


@pytest.fixture(scope="module")
def daily(sf):
    """event type -> dates and mean values by day, in order."""
    rows = pq.read_table(f"{sf}/events.parquet", columns=["event_type", "ts", "value"]).to_pylist()
    sums = collections.defaultdict(list)
    for r in rows:
        if r["value"] is not None:
            sums[r["event_type"], r["ts"].date()].append(r["value"])
    out = collections.defaultdict(list)
    for (kind, day), values in sorted(sums.items()):
        out[kind].append((day, float(np.mean(values))))
    return {k: ([d for d, _ in v], np.array([x for _, x in v])) for k, v in out.items()}


def segment_cost(x, gamma):
    """Kernel cost of one segment: its length less the mean similarity of its points, summed."""
    k = np.exp(-np.clip((x[:, None] - x[None, :]) ** 2 * gamma, 1e-2, 1e2))
    np.fill_diagonal(k, 1.0)
    return len(x) - k.sum() / len(x)


def all_partitions(x, penalty, jump=5, least=2):
    """The least cost over every admissible partition, without pruning."""
    n = len(x)
    d2 = (x[:, None] - x[None, :]) ** 2
    spread = np.median(d2[np.triu_indices(n, 1)])
    gamma = 1 / spread if spread > 0 else 1.0
    ends = [k for k in range(0, n, jump) if k >= least] + [n]
    best = {0: (0.0, ())}
    for end in ends:
        options = [(best[a][0] + segment_cost(x[a:end], gamma) + penalty, (*best[a][1], end)) for a in best if end - a >= least]
        if options:
            best[end] = min(options)
    return best[n]


def test_change_points(spark, sf, daily):
    want = set()
    for kind, (days, x) in daily.items():
        for b in all_partitions(x, 1.0)[1][:-1] if len(x) >= 4 else ():
            i = b - 1
            want.add((kind, days[i], round(float(x[i : i + 3].mean() - x[max(0, i - 3) : i].mean()), 6)))
    got = {(r.subreddit, r.date, r.magnitude) for r in entry.queries()["change_points"](spark, sf).collect()}
    assert {x[:2] for x in got} == {x[:2] for x in want}
    assert sorted(x[2] for x in got) == pytest.approx(sorted(x[2] for x in want), abs=2e-6)


def test_breakpoints_are_the_best_of_all_partitions():
    for seed in range(40):
        r = np.random.default_rng(seed)
        x = np.concatenate([r.normal(m, 0.3, r.integers(3, 20)) for m in r.integers(-3, 4, r.integers(1, 5))])
        if len(x) < 4:
            continue
        cost, ends = all_partitions(x, 1.0)
        d2 = (x[:, None] - x[None, :]) ** 2
        spread = np.median(d2[np.triu_indices(len(x), 1)])
        found = series.breakpoints(x, 1.0)
        total = sum(segment_cost(x[a:b], 1 / spread if spread > 0 else 1.0) + 1.0 for a, b in zip([0, *found], found))
        assert found[-1] == len(x) and total == pytest.approx(cost, abs=1e-9)


def test_forecast(spark, sf, daily):
    got = collections.defaultdict(dict)
    for r in entry.queries()["forecast"](spark, sf).collect():
        got[r.subreddit][r.date] = (r.yhat, r.yhat_lower, r.yhat_upper)
    assert got.keys() == {k for k, (days, _) in daily.items() if len(days) >= 7}
    for kind, found in got.items():
        days, x = daily[kind]
        t = np.array([d.toordinal() for d in days], float)
        ahead = [days[-1] + dt.timedelta(k) for k in range(1, 15)]
        assert sorted(found) == ahead

        def design(at):
            cells = [np.ones(len(at)), (at - t[0]) / max(t[-1] - t[0], 1)]
            for k in (1, 2, 3):
                cells += [np.sin(2 * np.pi * k * at / 7), np.cos(2 * np.pi * k * at / 7)]
            return np.stack(cells, axis=1)

        a = design(t)
        stacked, target = np.vstack([a, np.sqrt(1e-3) * np.eye(a.shape[1])]), np.concatenate([x, np.zeros(a.shape[1])])
        w = np.linalg.lstsq(stacked, target, rcond=None)[0]
        rest = x - a @ w
        low, high = np.quantile(rest, [0.1, 0.9])
        y = design(np.array([d.toordinal() for d in ahead], float)) @ w
        assert [found[d][0] for d in ahead] == pytest.approx(list(y), abs=1e-6)
        assert [found[d][1] for d in ahead] == pytest.approx(list(y + low), abs=1e-6)
        assert [found[d][2] for d in ahead] == pytest.approx(list(y + high), abs=1e-6)


@pytest.fixture(scope="module")
def vectors(sf):
    t = pq.read_table(f"{sf}/embeddings.parquet")
    return t.column("vec_id").to_pylist(), np.array(t.column("embedding").to_pylist(), float)


def test_projection(spark, sf, vectors):
    ids, v = vectors
    u, s, axes = np.linalg.svd(v - v.mean(axis=0), full_matrices=False)
    want = np.empty((len(v), 2))
    for k in range(2):
        axis = axes[k] * np.sign(axes[k][np.argmax(np.abs(axes[k]))])
        x = (v - v.mean(axis=0)) @ axis
        want[:, k] = x / np.abs(x).max()
    got = {r.id: (r.x, r.y) for r in entry.queries()["embedding_project_2d"](spark, sf).collect()}
    assert got.keys() == set(ids)
    assert np.abs(np.array([got[i] for i in ids]) - want).max() < 1e-5


def test_clusters(spark, sf, vectors):
    """Every vector goes to the nearest centre of its cluster's members, the farthest twentieth to none, and plain Lloyd rounds from there change little."""
    from forumlens.operators import topics
    from forumlens.sources.domain import Domain

    ids, v = vectors
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    found = {r.id: r.topic_id for r in topics.clustered(Domain(spark, sf).vectors, 10).collect()}
    own = np.array([found[i] for i in ids])
    assert abs((own == -1).mean() - 0.05) < 0.02 and set(own) == {-1, *range(10)}
    counts = {r.topic_id: r.n for r in entry.queries()["topic_clusters"](spark, sf).collect()}
    assert counts == dict(collections.Counter(own.tolist()))
    kept = own >= 0
    centres = np.stack([v[own == k].mean(axis=0) for k in range(10)])
    near = ((v[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (near[kept].argmin(axis=1) == own[kept]).mean() > 0.97
    spent = near[kept, own[kept]].sum()
    for _ in range(20):
        near = ((v[kept][:, None, :] - centres[None]) ** 2).sum(axis=2)
        pick = near.argmin(axis=1)
        centres = np.stack([v[kept][pick == k].mean(axis=0) if (pick == k).any() else centres[k] for k in range(10)])
    assert spent < 1.05 * near.min(axis=1).sum()
