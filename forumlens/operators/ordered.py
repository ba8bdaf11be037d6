"""Places and running sums in a global order, or the order of very large groups, without one task for all rows.

Rows are dealt by ranges of the order; a range's own sums are taken within it, and what the ranges before it hold (one row a range and group) is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch


def running(df: DataFrame, order: list[str], sums: dict[str, Column], scratch: Scratch, by: list[str] | None = None, totals: bool = False) -> DataFrame:
    """df with, for each name of `sums`, the sum of its column over the rows up to this one in the order (ties in any order, so make it unique), within each group of `by`.

    With totals, also name_total: the sum over the whole group. The ranged rows are staged, so that a repeated task sees the same ranges.
    """
    by = by or []
    n = max(2, df.sparkSession.sparkContext.defaultParallelism)
    rows = df.withColumns({f"_{k}": c for k, c in sums.items()}).repartitionByRange(n, *by, *order).withColumn("_range", F.spark_partition_id())
    rows = scratch.staged(rows, "ranged")
    held = rows.groupBy(*by, "_range").agg(*(F.sum(f"_{k}").alias(f"_all_{k}") for k in sums))  # one row a range and group
    whole = Window.partitionBy(*by)
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_range").alias("_at"), *(F.coalesce(F.sum(f"_all_{k}").over(before), F.lit(0)).alias(f"_before_{k}") for k in sums), *(F.sum(f"_all_{k}").over(whole).alias(f"_total_{k}") for k in sums))
    same = F.col("_range") == F.col("_at")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    upto = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumns({f"_own_{k}": F.sum(f"_{k}").over(upto) for k in sums})
    out = own.join(held, same)
    return out.select(*df.columns, *((F.col(f"_own_{k}") + F.col(f"_before_{k}")).alias(k) for k in sums), *(F.col(f"_total_{k}").alias(f"{k}_total") for k in sums if totals))


def counted_within(df: DataFrame, seconds: int, time: Column, by: str, name: str, stretch: int = 10) -> DataFrame:
    """df with the number of rows of its group in the `seconds` up to and with each row's time.

    Time is cut into stretches of stretch * seconds; rows of a stretch's last `seconds` are seen by the next one too.
    """
    long = stretch * seconds
    rows = df.withColumn("_t", time.cast("timestamp").cast("long"))
    rows = rows.withColumn("_stretch", F.floor(F.col("_t") / long))
    copies = F.when(F.pmod(F.col("_t"), F.lit(long)) >= long - seconds, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("_later", F.explode(copies)).withColumn("_stretch", F.col("_stretch") + F.col("_later"))
    upto = Window.partitionBy(by, "_stretch").orderBy("_t").rangeBetween(-seconds, 0)
    return rows.withColumn(name, F.count("*").over(upto)).where("_later = 0").drop("_t", "_stretch", "_later")
