"""The discussion domain over star-schema tables: orders are posts, line items comments, events collection batches.

One place maps names; everything else works on the domain's own tables (see schemas).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship


def dealt(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, if a small input has fewer; for work on whole texts."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


class Domain:
    """Lazy DataFrames over one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        ship(spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def posts(self) -> DataFrame:
        o = self.table("orders")
        key = F.col("o_orderkey")
        label = F.when(F.col("o_orderstatus") == "F", "positive").when(F.col("o_orderstatus") == "O", "neutral").otherwise("negative")
        return o.select(
            F.concat(F.lit("p"), key).alias("id"),
            F.col("o_orderpriority").alias("subreddit"),
            F.col("o_orderdate").alias("timestamp"),
            F.concat(F.lit("user"), "o_custkey").alias("author"),
            F.floor(F.col("o_totalprice") / 1000).cast("int").alias("upvotes"),
            (key % 7).cast("int").alias("num_comments"),
            F.concat("o_orderpriority", F.lit(" order "), key).alias("title"),
            label.alias("label"),
            ((key % 101).cast("double") / 100).alias("confidence"),
        )

    @cached_property
    def comments(self) -> DataFrame:
        line = self.table("lineitem")
        parent = self.table("orders").select("o_orderkey", "o_orderpriority")
        label = F.when(F.col("l_returnflag") == "A", "positive").when(F.col("l_returnflag") == "N", "neutral").otherwise("negative")
        return line.join(parent, line["l_orderkey"] == parent["o_orderkey"]).select(
            F.concat(F.lit("c"), "l_orderkey", F.lit("-"), "l_linenumber").alias("id"),
            F.concat(F.lit("p"), "l_orderkey").alias("post_id"),
            F.col("o_orderpriority").alias("subreddit"),
            F.col("l_shipdate").alias("timestamp"),
            F.concat(F.lit("supplier"), "l_suppkey").alias("author"),
            F.col("l_quantity").cast("int").alias("upvotes"),
            label.alias("label"),
            F.round(F.col("l_discount") * 10, 1).alias("confidence"),
        )

    @cached_property
    def content(self) -> DataFrame:
        """Posts and comments as one view; filters and column selections after it reach both scans."""
        common = ["id", "subreddit", "timestamp", "author", "upvotes", "label", "confidence"]
        p = self.posts.select(*common, "num_comments", F.lit("post").alias("content_type"))
        c = self.comments.select(*common, F.lit(0).alias("num_comments"), F.lit("comment").alias("content_type"))
        return p.unionByName(c).withColumn("weight", 1 + F.coalesce("upvotes", F.lit(0)) + F.coalesce("num_comments", F.lit(0)))

    @cached_property
    def documents(self) -> DataFrame:
        d = self.table("documents")
        day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 90).cast("int"))
        author = F.when(F.col("doc_id") % 17 == 0, "AutoModerator").otherwise(F.concat(F.lit("user"), F.col("doc_id") % 50))
        return d.select(F.col("doc_id").alias("id"), "text", F.col("source").alias("subreddit"), "lang", day.alias("timestamp"), author.alias("author"))

    @cached_property
    def predictions(self) -> DataFrame:
        lab = self.table("labels")
        label = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
        return lab.select(F.col("doc_id").alias("id"), label.alias("label"), ((F.col("doc_id") % 100) / 100).alias("confidence"))

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))

    @cached_property
    def assignments(self) -> DataFrame:
        e = self.table("embeddings")
        return e.select(F.col("vec_id").alias("id"), F.when(F.col("label") == 9, -1).otherwise(F.col("label")).alias("topic_id"))

    @cached_property
    def assigned(self) -> DataFrame:
        """Documents with topic and, where there is one, label."""
        return self.assignments.join(self.documents, "id").join(self.predictions, "id", "left")

    @cached_property
    def topic_sizes(self) -> DataFrame:
        """topic_id, doc_count: no text is read."""
        ids = self.assignments.join(self.documents.select("id"), "id")
        return ids.groupBy("topic_id").agg(F.count("*").alias("doc_count"))

    @cached_property
    def topics(self) -> DataFrame:
        """topic_id, keywords (the eight most frequent words), doc_count."""
        from ..operators.filters import first_rows
        from ..operators.topics import words_by_topic

        texts = self.assignments.join(dealt(self.documents).select("id", "text"), "id")
        top = first_rows(words_by_topic(texts), ["topic_id"], F.desc("n"), F.asc("word"), n=8)
        words = top.groupBy("topic_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "word"))).alias("w"))
        return self.topic_sizes.join(words.select("topic_id", F.transform("w", lambda x: x["word"]).alias("keywords")), "topic_id", "left")

    @cached_property
    def batches(self) -> DataFrame:
        e = self.table("events")
        return e.select(
            F.col("event_type").alias("subreddit"),
            F.col("ts").alias("collection_timestamp"),
            (F.col("user_id") % 20).cast("int").alias("posts_collected"),
            (F.col("event_id") % 50).cast("int").alias("comments_collected"),
            F.col("value").alias("processing_time_seconds"),
            F.when(F.col("event_id") % 5 == 0, "failed").otherwise("completed").alias("batch_status"),
            F.col("event_id").alias("batch_id"),
        )

    @cached_property
    def artifacts(self) -> DataFrame:
        e = self.table("events")
        status = F.element_at(F.array(*map(F.lit, ("queued", "running", "succeeded", "failed", "stale", "canceled"))), (F.col("event_id") % 6 + 1).cast("int"))
        return e.select(
            F.concat(F.lit("a"), "event_id").alias("artifact_id"),
            F.concat("event_type", F.lit("_event")).alias("kind"),
            status.alias("status"),
            F.when(status == "succeeded", F.col("ts")).alias("freshness_timestamp"),
            F.col("ts").alias("created_at"),
            (F.col("ts") + F.expr("interval 1 hour")).alias("updated_at"),
            (F.col("ts") + F.expr("interval 10 minutes")).alias("lease_expires_at"),
        )


def day(column: str | Column) -> Column:
    """A date as text, equal in every engine."""
    return F.date_format(column, "yyyy-MM-dd")


def moment(column: str | Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


#: The same mapping in SQL, for comparison.
SQL = """
posts AS (SELECT 'p' || o_orderkey AS id, o_orderpriority AS subreddit, o_orderdate AS timestamp, 'user' || o_custkey AS author, CAST(floor(o_totalprice / 1000) AS INTEGER) AS upvotes,
  CAST(o_orderkey % 7 AS INTEGER) AS num_comments, o_orderpriority || ' order ' || o_orderkey AS title,
  CASE o_orderstatus WHEN 'F' THEN 'positive' WHEN 'O' THEN 'neutral' ELSE 'negative' END AS label, CAST(o_orderkey % 101 AS DOUBLE) / 100 AS confidence FROM orders),
comments AS (SELECT 'c' || l_orderkey || '-' || l_linenumber AS id, 'p' || l_orderkey AS post_id, o_orderpriority AS subreddit, l_shipdate AS timestamp, 'supplier' || l_suppkey AS author,
  CAST(l_quantity AS INTEGER) AS upvotes, CASE l_returnflag WHEN 'A' THEN 'positive' WHEN 'N' THEN 'neutral' ELSE 'negative' END AS label, round(l_discount * 10, 1) AS confidence
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
content AS (SELECT id, subreddit, timestamp, author, upvotes, label, confidence, num_comments, 'post' AS content_type, 1 + upvotes + num_comments AS weight FROM posts
  UNION ALL SELECT id, subreddit, timestamp, author, upvotes, label, confidence, 0, 'comment', 1 + upvotes FROM comments),
docs AS (SELECT doc_id AS id, text, source AS subreddit, lang, DATE '2024-01-01' + CAST(doc_id % 90 AS INTEGER) AS timestamp,
  CASE WHEN doc_id % 17 = 0 THEN 'AutoModerator' ELSE 'user' || (doc_id % 50) END AS author FROM documents),
predictions AS (SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS label, (doc_id % 100) / 100.0 AS confidence FROM labels),
assignments AS (SELECT vec_id AS id, CASE WHEN label = 9 THEN -1 ELSE label END AS topic_id FROM embeddings),
assigned AS (SELECT a.id, a.topic_id, d.text, d.subreddit, d.timestamp, d.author, p.label, p.confidence FROM assignments a JOIN docs d USING (id) LEFT JOIN predictions p USING (id)),
words AS (SELECT topic_id, word, count(*) AS n FROM (SELECT topic_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS word FROM assigned) GROUP BY topic_id, word),
topics AS (SELECT s.topic_id, s.doc_count, w.keywords FROM (SELECT topic_id, count(*) AS doc_count FROM assigned GROUP BY topic_id) s
  LEFT JOIN (SELECT topic_id, list(word ORDER BY n DESC, word) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY n DESC, word) AS k FROM words) WHERE k <= 8 GROUP BY topic_id) w USING (topic_id)),
over_time AS (SELECT topic_id, CAST(date_trunc('week', timestamp) AS DATE) AS week_start, count(*) AS doc_count, avg(CASE label WHEN 'positive' THEN 1.0 WHEN 'negative' THEN -1.0 WHEN 'neutral' THEN 0.0 END) AS avg_sentiment FROM assigned GROUP BY 1, 2),
daily AS (SELECT subreddit, CAST(timestamp AS DATE) AS date, avg(CASE label WHEN 'positive' THEN 1.0 WHEN 'negative' THEN -1.0 ELSE 0.0 END) AS mean_score,
  sum(CASE WHEN label = 'positive' THEN 1 ELSE 0 END) AS pos_count, sum(CASE WHEN label = 'neutral' THEN 1 ELSE 0 END) AS neu_count, sum(CASE WHEN label = 'negative' THEN 1 ELSE 0 END) AS neg_count FROM content GROUP BY 1, 2),
batches AS (SELECT event_type AS subreddit, ts AS collection_timestamp, CAST(user_id % 20 AS INTEGER) AS posts_collected, CAST(event_id % 50 AS INTEGER) AS comments_collected, value AS processing_time_seconds,
  CASE WHEN event_id % 5 = 0 THEN 'failed' ELSE 'completed' END AS batch_status, event_id AS batch_id FROM events),
artifacts AS (SELECT 'a' || event_id AS artifact_id, event_type || '_event' AS kind, (['queued', 'running', 'succeeded', 'failed', 'stale', 'canceled'])[CAST(event_id % 6 + 1 AS INTEGER)] AS status, ts FROM events)
"""
