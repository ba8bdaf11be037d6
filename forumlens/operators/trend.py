"""Forecasts with a changing trend: a piecewise-linear trend under a sparse prior for its changes, and weekly waves.

A series is level, slope, weekly waves and hinges at CHANGES places in the first SPAN of its days. Hinges have a Laplace prior, so most are zero; the fit is the
most probable one, found by coordinate descent on the Gram matrix (hinges x hinges: small whatever the length). Bands come from simulated futures:
the slope goes on changing as often as there are places and as much as it did, and noise is added. Each group is a task of its own days only.
"""

from __future__ import annotations

import zlib
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..session import ship

CHANGES, SPAN, PRIOR = 25, 0.8, 0.05
WAVES, WAVE_PRIOR = 3, 10.0
LEAST_DAYS = 7


def waves(days: np.ndarray) -> np.ndarray:
    at = 2 * np.pi * days[:, None] / 7 * np.arange(1, WAVES + 1)
    return np.concatenate([np.sin(at), np.cos(at)], axis=1)


def fitted(design: np.ndarray, y: np.ndarray, ridge: np.ndarray, lasso: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """The minimum of |y - Xw|^2 / 2 + sum(ridge w^2) / 2 + sum(lasso |w|), by coordinate descent."""
    gram, target = design.T @ design + np.diag(ridge), design.T @ y
    w = np.zeros(len(target))
    for _ in range(rounds):
        was = w.copy()
        for j in range(len(w)):
            if gram[j, j] > 0:
                rest = target[j] - gram[j] @ w + gram[j, j] * w[j]
                w[j] = np.sign(rest) * max(abs(rest) - lasso[j], 0.0) / gram[j, j]
        if np.abs(w - was).max() < 1e-10:
            break
    return w


def predicted(days: np.ndarray, values: np.ndarray, ahead: int, *, prior: float = PRIOR, futures: int = 500, band: float = 0.8, seed: int = 42) -> np.ndarray:
    """days (numbers) and values in order -> [ahead, 3]: forecast, lower and upper end of the band for the days after the last."""
    scale = max(np.abs(values).max(), 1e-12)
    y = values / scale
    length = max(days[-1] - days[0], 1)
    t = (days - days[0]) / length
    inside = np.unique(t[(t > 0) & (t <= SPAN)])
    places = inside[np.unique(np.linspace(0, len(inside) - 1, min(CHANGES, len(inside))).astype(int))] if len(inside) else np.zeros(0)
    hinges = np.maximum(t[:, None] - places, 0)
    x = np.concatenate([np.ones((len(t), 1)), t[:, None], waves(days), hinges], axis=1)
    n_waves = 2 * WAVES
    noise = max(float(np.std(np.diff(y))) / np.sqrt(2), 1e-6) if len(y) > 1 else 1e-6
    for _ in range(3):  # the noise that the fit leaves is the noise that it is weighed by
        ridge = np.concatenate([[1e-9, noise**2 / 25], np.full(n_waves, noise**2 / WAVE_PRIOR**2), np.zeros(len(places))])
        lasso = np.concatenate([np.zeros(2 + n_waves), np.full(len(places), noise**2 / prior)])
        w = fitted(x, y, ridge, lasso)
        noise = max(float(np.sqrt(np.mean((y - x @ w) ** 2))), 1e-6)
    future = days[-1] + np.arange(1, ahead + 1)
    tf = (future - days[0]) / length
    mean = np.concatenate([np.ones((ahead, 1)), tf[:, None], waves(future), np.maximum(tf[:, None] - places, 0)], axis=1) @ w
    r = np.random.default_rng(seed)
    size = float(np.abs(w[2 + n_waves :]).mean()) if len(places) else 0.0
    chance = min(1.0, len(places) / SPAN / length)  # of a change, a day
    change = r.laplace(0, max(size, 1e-12), (futures, ahead)) * (r.random((futures, ahead)) < chance)
    slopes = np.cumsum(change, axis=1) / length
    paths = mean + np.cumsum(slopes, axis=1) - slopes + r.normal(0, noise, (futures, ahead))
    low, high = np.quantile(paths, [(1 - band) / 2, (1 + band) / 2], axis=0)
    return np.stack([mean, low, high], axis=1) * scale


def trend_forecast(daily: DataFrame, ahead: int = 14, seed: int = 42) -> DataFrame:
    """daily(subreddit, date, mean_score) -> subreddit, date, yhat, yhat_lower, yhat_upper for the days after each group's last.

    Null scores are left out; groups of fewer than seven days have no forecast. Draws come from the seed and the group's name.
    """
    ship(daily.sparkSession)

    def task(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.dropna(subset=["date", "mean_score"]).sort_values("date")
        if len(rows) < LEAST_DAYS:
            return pd.DataFrame(columns=["subreddit", "date", "yhat", "yhat_lower", "yhat_upper"])
        name, last = rows["subreddit"].iloc[0], rows["date"].iloc[-1]
        out = predicted(np.array([d.toordinal() for d in rows["date"]], float), rows["mean_score"].to_numpy(float), ahead, seed=zlib.crc32(f"{seed}:{name}".encode()))
        return pd.DataFrame({"subreddit": name, "date": [last + timedelta(k) for k in range(1, ahead + 1)], "yhat": out[:, 0], "yhat_lower": out[:, 1], "yhat_upper": out[:, 2]})

    return daily.select("subreddit", "date", "mean_score").groupBy("subreddit").applyInPandas(task, "subreddit string, date date, yhat double, yhat_lower double, yhat_upper double")
