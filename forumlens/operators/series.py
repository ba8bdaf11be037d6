"""Time series by group: daily scores, trailing means, change points, forecasts, calendar roll-ups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import LABEL_SCORE
from ..session import ship


def score_of(label: Column) -> Column:
    """positive 1, negative -1, anything else 0."""
    return F.when(label == "positive", LABEL_SCORE["positive"]).when(label == "negative", LABEL_SCORE["negative"]).otherwise(0)


def daily_sentiment(scored: DataFrame, group: str = "subreddit") -> DataFrame:
    """scored(group, timestamp, label) -> mean score and label counts by group and day; null groups are left out."""
    s = score_of(F.col("label"))
    count = lambda name: F.sum(F.when(F.col("label") == name, 1).otherwise(0)).alias(f"{name[:3]}_count")
    return scored.where(F.col(group).isNotNull()).groupBy(group, F.to_date("timestamp").alias("date")).agg(F.avg(s).alias("mean_score"), count("positive"), count("neutral"), count("negative"))


def trailing_means(daily: DataFrame, group: str = "subreddit", value: str = "mean_score", rows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Means of the last rows (not days: missing days are not filled) of each group."""
    w = Window.partitionBy(group).orderBy("date")
    return daily.select(group, "date", *(F.avg(value).over(w.rowsBetween(1 - n, 0)).alias(f"rolling_{n}d") for n in rows))


def shift_sizes(daily: DataFrame, group: str = "subreddit", value: str = "mean_score", rows: int = 3) -> DataFrame:
    """At each row the mean of the next rows (itself first) less the mean of the rows before it."""
    w = Window.partitionBy(group).orderBy("date")
    before, after = F.avg(value).over(w.rowsBetween(-rows, -1)), F.avg(value).over(w.rowsBetween(0, rows - 1))
    return daily.select(group, "date", (after - before).alias("magnitude"))


def breakpoints(values: np.ndarray, penalty: float = 1.0, min_size: int = 2, jump: int = 5) -> list[int]:
    """Ends of the segments of least penalised Gaussian-kernel cost (pruned exact linear time); the last is len(values)."""
    n = len(values)
    d2 = (values[:, None] - values[None, :]) ** 2
    spread = np.median(d2[np.triu_indices(n, 1)]) if n > 1 else 0.0
    gram = np.exp(-np.clip(d2 / spread if spread > 0 else d2, 1e-2, 1e2))
    np.fill_diagonal(gram, 1.0)
    total = np.zeros((n + 1, n + 1))
    total[1:, 1:] = gram.cumsum(0).cumsum(1)

    def cost(a: int, b: int) -> float:
        return (b - a) - (total[b, b] - total[a, b] - total[b, a] + total[a, a]) / (b - a)

    ends = [k for k in range(0, n, jump) if k >= min_size] + [n]
    best, back, live = {0: 0.0}, {0: 0}, [0]
    for end in ends:
        options = {a: best[a] + cost(a, end) + penalty for a in live if end - a >= min_size}
        if not options:
            continue
        a = min(options, key=options.get)
        best[end], back[end] = options[a], a
        live = [a for a in live if a not in options or options[a] <= best[end] + penalty] + [end]
    out, at = [], n
    while at:
        out.append(at)
        at = back[at]
    return out[::-1]


def change_points(daily: DataFrame, group: str = "subreddit", value: str = "mean_score", penalty: float = 1.0, include_terminal: bool = False) -> DataFrame:
    """daily(group, date, value) -> group, date, magnitude of each change point; groups of under 4 days have none.

    One group's days are one task's rows: days are few, however many rows they sum up. include_terminal
    also reports the last day of each series, as an index convention of the reference did.
    """

    def of_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        x = pdf["v"].to_numpy(float)
        rows = []
        if len(x) >= 4:
            for b in breakpoints(x, penalty):
                i = b - 1
                if i <= 0 or b == len(x) and not include_terminal:
                    continue
                rows.append((pdf["g"].iloc[0], pdf["date"].iloc[i], float(x[i : i + 3].mean() - x[max(0, i - 3) : i].mean())))
        return pd.DataFrame(rows, columns=["g", "date", "magnitude"])

    ship(daily.sparkSession)
    kind = daily.schema[group].dataType.simpleString()
    out = daily.select(F.col(group).alias("g"), "date", F.col(value).cast("double").alias("v")).where("v is not null").groupBy("g").applyInPandas(of_group, f"g {kind}, date date, magnitude double")
    return out.withColumnRenamed("g", group)


def fitted(days: np.ndarray, values: np.ndarray, ahead: np.ndarray, harmonics: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Least squares on a linear trend and weekly harmonics: values ahead, and residuals on what is known."""

    def design(t: np.ndarray) -> np.ndarray:
        angle = 2 * np.pi * t / 7
        waves = [f(k * angle) for k in range(1, harmonics + 1) for f in (np.sin, np.cos)]
        return np.stack([np.ones(len(t)), (t - days[0]) / max(days[-1] - days[0], 1), *waves], axis=1)

    a = design(days)
    ridge = 1e-3 * np.eye(a.shape[1])
    w = np.linalg.solve(a.T @ a + ridge, a.T @ values)
    return design(ahead) @ w, values - a @ w


def forecast(daily: DataFrame, group: str = "subreddit", value: str = "mean_score", horizon: int = 14, interval: float = 0.80, least: int = 7) -> DataFrame:
    """A declared substitute for a library model: trend and weekly season by group, with a band of residual quantiles.

    Groups with fewer than `least` days are skipped.
    """

    def of_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        if len(pdf) < least:
            return pd.DataFrame(columns=["g", "date", "yhat", "yhat_lower", "yhat_upper"])
        dates = pd.to_datetime(pdf["date"])
        t = dates.map(pd.Timestamp.toordinal).to_numpy(float)
        ahead = t[-1] + np.arange(1, horizon + 1)
        y, rest = fitted(t, pdf["v"].to_numpy(float), ahead)
        low, high = np.quantile(rest, [(1 - interval) / 2, (1 + interval) / 2])
        return pd.DataFrame({"g": pdf["g"].iloc[0], "date": [pd.Timestamp.fromordinal(int(d)).date() for d in ahead], "yhat": y, "yhat_lower": y + low, "yhat_upper": y + high})

    ship(daily.sparkSession)
    kind = daily.schema[group].dataType.simpleString()
    out = daily.select(F.col(group).alias("g"), "date", F.col(value).cast("double").alias("v")).where("v is not null").groupBy("g").applyInPandas(of_group, f"g {kind}, date date, yhat double, yhat_lower double, yhat_upper double")
    return out.withColumnRenamed("g", group)


def weekly_topics(assigned: DataFrame) -> DataFrame:
    """assigned(topic_id, timestamp, label) -> documents and mean score by topic and week (from Monday); unlabelled rows count but don't score."""
    s = F.when(F.col("label").isNotNull(), score_of(F.col("label")))
    return assigned.groupBy("topic_id", F.to_date(F.date_trunc("week", "timestamp")).alias("week_start")).agg(F.count("*").alias("doc_count"), F.avg(s).alias("avg_sentiment"))


def topic_trend(assigned: DataFrame) -> DataFrame:
    """Daily mean score of each topic (outliers left out) and its trailing mean of 7 rows."""
    daily = assigned.where((F.col("topic_id") != -1) & F.col("label").isNotNull()).groupBy("topic_id", F.to_date("timestamp").alias("date")).agg(F.avg(score_of(F.col("label"))).alias("mean_sentiment"))
    w = Window.partitionBy("topic_id").orderBy("date").rowsBetween(-6, 0)
    return daily.withColumn("rolling_7d", F.avg("mean_sentiment").over(w))
