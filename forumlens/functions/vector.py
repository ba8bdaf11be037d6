"""Vectors as arrays of numbers: cosine, softmax, projection to two axes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a norm is 0 or the result is no number."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, F.nanvl(dot(a, b) / norm, F.lit(0.0))).otherwise(0.0)


def softmax(logits: Column) -> Column:
    exps = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(exps, lambda e: e / F.aggregate(exps, F.lit(0.0), lambda s, x: s + x))


def best_label(probabilities: Column, labels: list[str]) -> Column:
    """The label of the greatest probability, the first of equal ones."""
    return F.element_at(F.array(*map(F.lit, labels)), F.array_position(probabilities, F.array_max(probabilities)).cast("int"))


def projected(df: DataFrame, vector: str = "vector") -> DataFrame:
    """df with x and y: centred, on the first two principal axes, each scaled by its largest absolute value.

    The axes' signs are fixed so that the largest loading of each is positive. One row gives zeros, vectors
    of one dimension a y of zero. The covariance is summed over partitions; only it (d x d) reaches the driver.
    """
    import numpy as np
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    wide = F.col(vector).cast("array<double>")
    mean = df.select(Summarizer.mean(array_to_vector(wide)).alias("m")).first()["m"] if not df.isEmpty() else None
    if mean is None:
        return df.withColumns({"x": F.lit(0.0), "y": F.lit(0.0)})
    mean = mean.toArray()

    def moments(batches):
        total = np.zeros((len(mean), len(mean)))
        for batch in batches:
            part = np.array(batch["v"].tolist(), float).reshape(-1, len(mean)) - mean
            total += part.T @ part
        yield pd.DataFrame({"i": np.repeat(np.arange(len(mean)), len(mean)), "j": np.tile(np.arange(len(mean)), len(mean)), "c": total.ravel()})

    sums = df.select(wide.alias("v")).mapInPandas(moments, "i int, j int, c double").groupBy("i", "j").agg(F.sum("c").alias("c")).toPandas()
    cov = np.zeros((len(mean), len(mean)))
    cov[sums["i"], sums["j"]] = sums["c"]
    _, axes = np.linalg.eigh(cov)
    axes = axes[:, ::-1][:, :2]
    for k in range(axes.shape[1]):
        axes[:, k] *= np.sign(axes[np.argmax(np.abs(axes[:, k])), k]) or 1

    def on(k: int) -> Column:
        if k >= axes.shape[1]:
            return F.lit(0.0)
        centred = F.zip_with(wide, F.lit([float(m) for m in mean]), lambda a, m: a - m)
        return dot(centred, F.lit([float(a) for a in axes[:, k]]))

    out = df.withColumns({"x": on(0), "y": on(1)})
    top = out.agg(F.max(F.abs("x")).alias("x"), F.max(F.abs("y")).alias("y")).first()
    return out.withColumns({c: F.col(c) / max(top[c] or 0.0, 1e-9) for c in "xy"})
