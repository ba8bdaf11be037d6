"""Keeping tables in order: upserts, deduplication, retention, splits, migration transforms, duplicate and batch statistics."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import first_rows


def upserted(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """old with the rows of new in place of those of equal keys. Columns of `keep` (such as created_at) stay as they were.

    Of several new rows of one key the last by all columns wins, so that the outcome is the same every time. Nulls in keys equal each other.
    """
    rows = first_rows(new, keys, *(F.desc_nulls_last(c) for c in new.columns if c not in keys))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys))
    named = [F.col(k).alias(f"_key_{k}") for k in keys]
    if keep:
        was = old.select(*named, *(F.col(c).alias(f"_old_{c}") for c in keep))
        rows = rows.join(was, same, "left").select(*(F.coalesce(f"_old_{c}", c).alias(c) if c in keep else F.col(c) for c in new.columns))
    return old.join(new.select(*named).distinct(), same, "left_anti").unionByName(rows.select(*old.columns))


def inserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and those rows of new whose keys it lacks; equal new keys insert once."""
    return old.unionByName(first_rows(new.join(old.select(*keys), keys, "left_anti"), keys, *(F.asc_nulls_first(c) for c in new.columns if c not in keys)).select(*old.columns))


def first_of_copies(df: DataFrame, keys: list[str], id: str) -> DataFrame:
    """Of each key the least id, first_id, and the number of its rows, copies: sums, so that no key's rows are held together."""
    return df.groupBy(*keys).agg(F.min(id).alias("first_id"), F.count("*").alias("copies"))


def retained(df: DataFrame, cutoff: datetime, column: str = "timestamp") -> DataFrame:
    """Rows at or after the cutoff; rows without a time survive a retention delete."""
    return df.where((F.col(column) >= F.lit(cutoff)) | F.col(column).isNull())


def split_by_group(df: DataFrame, groups: list[str], column: str = "subreddit") -> tuple[DataFrame, DataFrame]:
    """(rows to keep, rows to move): rows outside the groups move, rows without a group stay."""
    stays = F.col(column).isin(*groups) | F.col(column).isNull()
    return df.where(stays), df.where(~stays)


def deduplicated(posts: DataFrame, comments: DataFrame, seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Posts and comments without duplicates; seq is the order of insertion.

    By id the last row stays; by content (posts: title, author, time; comments: text, author, time) the first;
    then comments whose post is gone go too, but those without a post_id stay. Null keys are keys.
    """

    def once(df: DataFrame, content: list[str]) -> DataFrame:
        return first_rows(first_rows(df, ["id"], F.desc(seq)), content, F.asc(seq))

    p = once(posts, ["title", "author", "timestamp"])
    c = once(comments, ["content", "author", "timestamp"])
    orphans = c.where(F.col("post_id").isNotNull()).join(p.select(F.col("id").alias("post_id")), "post_id", "left_anti").select("id")
    return p, c.join(orphans, "id", "left_anti")


def duplicate_counts(df: DataFrame, *columns: str) -> DataFrame:
    """One row: rows less distinct concatenations. A null in any column makes the concatenation null, and nulls aren't counted as distinct."""
    return df.agg((F.count("*") - F.countDistinct(F.concat(*(F.col(c).cast("string") for c in columns)))).alias("duplicates"))


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of children that name a parent which doesn't exist."""
    return children.where(F.col(child_key).isNotNull()).join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_anti").select(*children.columns)


def group_stats(posts: DataFrame) -> DataFrame:
    return posts.groupBy("subreddit").agg(F.count("*").alias("post_count"), F.avg("upvotes").alias("avg_upvotes"), F.avg("num_comments").alias("avg_comments"), F.max("timestamp").alias("latest_post"))


def efficiency(batches: DataFrame) -> DataFrame:
    """One row of totals and means over collection batches; zeros where there is none."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return batches.agg(
        F.count("*").alias("collections"),
        zero(F.sum("posts_collected")).alias("total_posts"),
        zero(F.sum("comments_collected")).alias("total_comments"),
        zero(F.avg("posts_collected")).alias("avg_posts"),
        zero(F.avg("comments_collected")).alias("avg_comments"),
    )


def resume_state(wanted: DataFrame, batches: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    """wanted(subreddit) -> subreddit, last collection, its posts, and whether it was completed within the hours before as_of."""
    done = batches.where((F.col("batch_status") == "completed") & (F.col("collection_timestamp") >= F.lit(as_of - timedelta(hours=hours))))
    last = done.groupBy("subreddit").agg(F.max("collection_timestamp").alias("last_collection"), F.max_by("posts_collected", "collection_timestamp").alias("posts_collected"))
    return wanted.distinct().join(last, "subreddit", "left").withColumn("completed", F.col("last_collection").isNotNull())


def completion_percentage(state: DataFrame) -> DataFrame:
    return state.agg(F.round(F.coalesce(F.avg(F.col("completed").cast("double")), F.lit(0.0)) * 100, 2).alias("completion_percentage"))


def migrated(df: DataFrame, timestamps: tuple[str, ...] = (), dates: tuple[str, ...] = (), flags: tuple[str, ...] = (), lists: tuple[str, ...] = ()) -> DataFrame:
    """Text columns of an export in their proper types; what can't be read becomes null, and so does NaN."""
    kinds = dict(df.dtypes)
    new = {c: F.try_to_timestamp(F.col(c)) for c in timestamps} | {c: F.try_to_timestamp(F.col(c)).cast("date") for c in dates}
    new |= {c: F.expr(f"try_cast(`{c}` as boolean)") for c in flags} | {c: F.from_json(c, "array<string>") for c in lists}
    new |= {c: F.when(~F.isnan(c), F.col(c)) for c, k in kinds.items() if k in ("double", "float")}
    return df.withColumns(new)


def chunks_of(start: datetime, end: datetime, days: int, spark) -> DataFrame:
    """(chunk, start, end) stretches of at most `days` days that cover [start, end), half-open, so that no row is in two."""
    span = spark.createDataFrame([(start, end)], "s timestamp, e timestamp")
    step = F.make_dt_interval(F.lit(days))
    one = span.select("e", F.posexplode(F.sequence("s", F.col("e") - F.expr("interval 1 microsecond"), step)).alias("chunk", "start"))
    return one.select("chunk", "start", F.least(F.col("start") + step, "e").alias("end"))
