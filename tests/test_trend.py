import datetime as dt

import numpy as np

from forumlens.operators import trend as T


def test_the_fit_is_the_minimum():
    r = np.random.default_rng(1)
    x, y = r.normal(size=(60, 9)), r.normal(size=60)
    ridge, lasso = np.full(9, 0.3), np.array([0.0] * 3 + [4.0] * 6)
    w = T.fitted(x, y, ridge, lasso)
    slope = x.T @ (x @ w - y) + ridge * w
    for j in range(9):  # what the derivative must be at a minimum
        assert abs(slope[j] + lasso[j] * np.sign(w[j])) < 1e-6 if w[j] else abs(slope[j]) <= lasso[j] + 1e-6
    cost = lambda v: ((y - x @ v) ** 2).sum() / 2 + (ridge * v**2).sum() / 2 + (lasso * np.abs(v)).sum()
    assert all(cost(w) <= cost(w + 1e-3 * r.normal(size=9)) for _ in range(200))


def series(seed, n=120, ahead=14, noise=0.05):
    """A line that changes its slope once or twice, a weekly wave and noise."""
    r = np.random.default_rng(seed)
    t = np.arange(n + ahead, dtype=float)
    y = 0.3 + 0.002 * t + 0.1 * np.sin(2 * np.pi * t / 7)
    for at in r.choice(np.arange(20, 80), r.integers(1, 3), replace=False):
        y += r.normal(0, 0.01) * np.maximum(t - at, 0)
    return t + 738000, y + r.normal(0, noise, len(t))


def test_the_band_holds_about_its_share_of_days_to_come():
    held, better = [], 0
    for seed in range(60):
        t, y = series(seed)
        out = T.predicted(t[:120], y[:120], 14, seed=seed)
        held.append(((out[:, 1] <= y[120:]) & (y[120:] <= out[:, 2])).mean())
        line = np.polyval(np.polyfit(t[:120] - t[0], y[:120], 1), t[120:] - t[0])
        better += np.abs(out[:, 0] - y[120:]).mean() < np.abs(line - y[120:]).mean()
    assert 0.68 <= np.mean(held) <= 0.92
    assert better >= 55, "a straight line is worse"


def test_a_seed_gives_one_forecast_and_short_groups_none(spark):
    day = dt.date(2024, 1, 1)
    rows = [("a", day + dt.timedelta(k), float(k % 7)) for k in range(40)] + [("b", day, 1.0), ("c", day, None)] + [("d", day + dt.timedelta(k), 2.0) for k in range(9)]
    df = spark.createDataFrame(rows, "subreddit string, date date, mean_score double")
    one, two = (sorted(map(tuple, T.trend_forecast(df.repartition(n), 5).collect())) for n in (1, 4))
    assert one == two and {r[0] for r in one} == {"a", "d"} and len(one) == 10
    assert all(r[3] <= r[2] <= r[4] for r in one) and all(abs(r[2] - 2.0) < 0.01 for r in one if r[0] == "d")
