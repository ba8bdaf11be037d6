"""Predicates and ordered selections that the read queries share."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from .ordered import running


def in_groups(df: DataFrame, groups: tuple[str, ...] = (), column: str = "subreddit") -> DataFrame:
    """Rows of the groups; all rows if none is named."""
    return df.where(F.col(column).isin(*groups)) if groups else df


def between_days(df: DataFrame, start: str | None = None, end: str | None = None, column: str = "timestamp") -> DataFrame:
    """Rows from the start day to the end day, both included, as a half-open range that scans can push down."""
    if start:
        df = df.where(F.col(column) >= F.lit(datetime.fromisoformat(start)))
    if end:
        df = df.where(F.col(column) < F.lit(datetime.fromisoformat(end) + timedelta(days=1)))
    return df


def recent(df: DataFrame, days: int, as_of: datetime | date, column: str = "timestamp") -> DataFrame:
    """Rows of the last `days` days before as_of (an argument, so that results can be repeated)."""
    return df.where(F.col(column) >= F.lit(as_of - timedelta(days=days)))


def holds_any(keywords: list[str], *columns: str) -> Column:
    """Whether any column holds any keyword, case aside; true without keywords."""
    tests = [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(k.lower())) for k in keywords for c in columns]
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(True)


def usable(df: DataFrame) -> DataFrame:
    """Preprocessed rows that were kept and have text."""
    return df.where(~F.col("is_filtered") & F.col("clean_text").isNotNull() & (F.col("clean_text") != ""))


def first_rows(df: DataFrame, keys: list[str], *order: Column, n: int = 1) -> DataFrame:
    """The first n rows of each key in the given order."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def page(df: DataFrame, *order: Column, limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit) if offset else df.orderBy(*order).limit(limit)


def page_after(df: DataFrame, limit: int, after: tuple | None = None, time: str = "timestamp", key: str = "id") -> DataFrame:
    """The next `limit` rows by time (latest first) and key, after the row of that time and key. The token's range reaches the scan, so late pages cost what early ones do."""
    if after is not None:
        at, last = F.lit(after[0]), F.lit(after[1])
        df = df.where((F.col(time) <= at) & ((F.col(time) < at) | (F.col(key) > last)))
    return df.where(F.col(time).isNotNull() & F.col(key).isNotNull()).orderBy(F.desc(time), F.asc(key)).limit(limit)


def token_of(page: DataFrame, limit: int, time: str = "timestamp", key: str = "id") -> tuple | None:
    """The token of the page after this one; None after the last (one short of `limit` rows)."""
    rows = page.select(time, key).collect()  # `limit` rows at most
    return tuple(rows[-1]) if len(rows) == limit else None


def pages(df: DataFrame, limit: int, scratch: Scratch, time: str = "timestamp", key: str = "id") -> DataFrame:
    """df with `page`, from 0: all the pages that page_after gives one after the other, from places in the whole order; nothing comes to the driver."""
    rows = df.where(F.col(time).isNotNull() & F.col(key).isNotNull()).withColumn("_late", -F.unix_micros(F.col(time).cast("timestamp")))
    placed = running(rows, ["_late", key], {"_place": F.lit(1)}, scratch)
    return placed.select(*df.columns, F.floor((F.col("_place") - 1) / limit).alias("page"))


def digest_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, the same ones at every run and in every engine: those of least MD5 of key and seed."""
    return df.orderBy(F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def hashed_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, the same ones at every run: those of least hash of key and seed."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def unprocessed(df: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key is not in `done` yet. Rows with a null key stay, as a left anti join keeps them."""
    return df.join(done.select(*keys).distinct(), list(keys), "left_anti")
