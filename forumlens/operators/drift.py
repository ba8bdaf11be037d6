"""Drift checks between a reference period and a current one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from .ordered import running


def label_shift(reference: DataFrame, current: DataFrame, label: str = "label") -> DataFrame:
    """One row: chi-square statistic of the current label counts against the reference's shares, and its degrees of freedom.

    Labels that only the current period has count against a share of one row.
    """
    a = reference.groupBy(label).agg(F.count("*").alias("a"))
    b = current.groupBy(label).agg(F.count("*").alias("b"))
    t = a.join(b, label, "full").select(F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    sums = t.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    t = t.crossJoin(F.broadcast(sums)).withColumn("e", F.greatest("a", F.lit(1)) * F.col("nb") / F.greatest("na", F.lit(1)))
    return t.agg(F.coalesce(F.sum(F.pow(F.col("b") - F.col("e"), 2) / F.col("e")), F.lit(0.0)).alias("chi_square"), F.greatest(F.count("*") - 1, F.lit(0)).alias("degrees"))


def value_shift(reference: DataFrame, current: DataFrame, value: str = "confidence") -> DataFrame:
    """One row: the Kolmogorov-Smirnov distance of the two distributions; nulls are left out.

    Counts are combined by distinct value first; the running sums go over ranges of these.
    """
    both = reference.select(F.col(value).alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b")).union(current.select(F.col(value), F.lit(0), F.lit(1)))
    steps = both.where("v is not null").groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    total = steps.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    sums = running(steps.toDF("v", "n", "m"), ["v"], {"a": F.col("n"), "b": F.col("m")}, Scratch(both.sparkSession))
    run = sums.crossJoin(F.broadcast(total))
    gap = F.abs(F.col("a") / F.greatest("na", F.lit(1)) - F.col("b") / F.greatest("nb", F.lit(1)))
    return run.agg(F.coalesce(F.max(gap), F.lit(0.0)).alias("distance"))


def confidence_alarm(current: DataFrame, least: float = 0.75) -> DataFrame:
    """One row: mean confidence, and whether it fell below the limit."""
    mean = F.avg("confidence")
    return current.agg(mean.alias("mean_confidence"), F.coalesce(mean < least, F.lit(False)).alias("alarm"))
