"""Incremental processing of landing folders with Structured Streaming, and late-data aggregates on event streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.readers import Store
from ..sources.sinks import upsert


def landed(store: Store, folder: str, ddl: str, fmt: str = "json") -> DataFrame:
    """A stream of the files that arrive in a folder."""
    return store.spark.readStream.schema(ddl).format(fmt).load(folder)


def drained(stream: DataFrame, store: Store, table: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Upsert all that has arrived since the last call, then stop. A batch that runs again writes the same rows."""

    def store_rows(batch: DataFrame, _: int) -> None:
        upsert(store, table, prepare(batch))

    stream.writeStream.foreachBatch(store_rows).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed(events: DataFrame, *, time: str = "ts", group: str = "event_type", value: str = "value", window: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event-time window and group; events later than `late` are dropped once their window closed."""
    span = F.window(time, window, slide) if slide else F.window(time, window)
    out = events.withWatermark(time, late).groupBy(span.alias("w"), group).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), group, "n", "total")


def sessions(events: DataFrame, *, time: str = "ts", user: str = "user_id", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Events of a user without a pause longer than the gap."""
    out = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("s"), user).agg(F.count("*").alias("n"))
    return out.select(user, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
