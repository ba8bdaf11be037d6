"""Readers: tables, SQL with named parameters, CSV with checked columns, JDBC, vectors, landing files, a pull source."""

from __future__ import annotations

import itertools
import json
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schemas import TABLES, keys, require, schema


class Conflict(RuntimeError):
    """Another writer changed the same table in the meantime."""


#: Shares of a bucket that are written in tasks of their own.
SHARES = 16


@dataclass
class Store:
    """Parquet tables with fixed schemas, and a log of commits: small files that name the folders each table consists of.

    Tables with keys are dealt to `buckets` folders by hash of the key, so a writer replaces only the folders of the keys it brings. A commit appears
    whole, by one rename, for all tables it changes: readers see the tables before or after it. Of each table the state before the
    last is kept for readers that have begun. Two writers may change different tables at once; of two that change one, the later fails.
    """

    spark: SparkSession
    root: str
    buckets: int = 16

    def path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"

    def _at(self, path: str):
        """A path and its file system."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _commits(self) -> list[str]:
        at, files = self._at(self.path("_commits"))
        return sorted(s.getPath().getName() for s in files.listStatus(at) if s.getPath().getName().startswith("c")) if files.exists(at) else []

    def tables(self) -> dict[str, dict]:
        """Of each table its last commit (rev), folders by bucket (parts) and others (loose), and the same of the state before."""
        for _ in range(3):  # a commit may be cleared away between being listed and read
            names = self._commits()
            if not names:
                return {}
            at, files = self._at(f"{self.path('_commits')}/{names[-1]}")
            try:
                stream = files.open(at)
            except Exception:
                continue
            try:
                return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
        raise Conflict("the store changes faster than it can be read")

    def commit(self, base: dict[str, dict], changed: dict[str, dict]) -> None:
        """Make the changed tables' new states the current ones, if nobody else changed those tables since `base` was read."""
        now = self.tables()
        for table in changed:
            if now.get(table, {}).get("rev") != base.get(table, {}).get("rev"):
                raise Conflict(table)
        names = self._commits()
        rev = int(names[-1][1:-5]) + 1 if names else 0
        gone: set[str] = set()
        for table, state in changed.items():
            was = now.get(table)
            before = {k: was[k] for k in ("rev", "parts", "loose")} if was else None
            gone |= set(folders(was["before"])) if was and was["before"] else set()
            now[table] = {"rev": rev, "parts": state["parts"], "loose": state["loose"], "before": before}
        text = json.dumps(now, sort_keys=True)
        temporary, files = self._at(f"{self.path('_commits')}/.{uuid.uuid4().hex}")
        stream = files.create(temporary, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        final, _ = self._at(f"{self.path('_commits')}/c{rev:012d}.json")
        if files.exists(final) or not files.rename(temporary, final):
            files.delete(temporary, False)
            raise Conflict(f"commit {rev}")
        used = {f for s in now.values() for x in (s, s["before"]) if x for f in folders(x)}
        for folder in gone - used:
            files.delete(self._at(f"{self.root.rstrip('/')}/{folder}")[0], True)
        for name in names[:-4]:
            files.delete(self._at(f"{self.path('_commits')}/{name}")[0], False)

    def written(self, table: str, rows: DataFrame) -> dict:
        """Write rows (dealt already or not) to new folders, one a bucket if the table has keys; returns them as a table's state. Nothing is committed."""
        name = f"{table}/data-{uuid.uuid4().hex}"
        at = f"{self.root.rstrip('/')}/{name}"
        if not self.keys(table):
            rows.write.parquet(at)
            return {"parts": {}, "loose": [name]}
        dealt = rows if "key_bucket" in rows.columns else self.dealt(table, rows)
        dealt.drop("key_share").write.option("compression", "zstd").partitionBy("key_bucket").parquet(at)
        path, files = self._at(at)
        found = [s.getPath().getName() for s in files.listStatus(path) if s.isDirectory()]
        return {"parts": {f.split("=")[1]: [f"{name}/{f}"] for f in found if f.startswith("key_bucket=")}, "loose": []}

    def dealt(self, table: str, rows: DataFrame) -> DataFrame:
        """rows with bucket and share, shuffled by both: a bucket's shares are tasks of their own, and windows by bucket, share and key need no further shuffle."""
        share = F.pmod(F.xxhash64(F.lit(1), *self.keys(table)), F.lit(SHARES)).cast("int")
        return rows.withColumns({"key_bucket": self.bucket(table), "key_share": share}).repartition("key_bucket", "key_share")

    def bucket(self, table: str):
        return F.pmod(F.xxhash64(*self.keys(table)), F.lit(self.buckets)).cast("int")

    def of(self, table: str, names: list[str]) -> DataFrame:
        """The rows of some of a table's folders."""
        if not names:
            return self.spark.createDataFrame([], schema(table))
        return self.spark.read.schema(schema(table)).parquet(*(f"{self.root.rstrip('/')}/{n}" for n in names))

    def versions(self, table: str) -> list[int]:
        """The commits whose states of the table are still there, the older one first."""
        state = self.tables().get(table)
        return [x["rev"] for x in (state["before"], state) if x] if state else []

    def exists(self, table: str) -> bool:
        return table in self.tables()

    def read(self, table: str) -> DataFrame:
        """The table, or its empty form if nothing was written yet."""
        state = self.tables().get(table)
        return self.of(table, folders(state) if state else [])

    def missing(self, *tables: str) -> list[str]:
        return [t for t in tables or TABLES if not self.exists(t)]

    def state(self, *tables: str) -> dict:
        """missing_schema, unpopulated or ready."""
        missing = self.missing(*tables)
        if missing:
            return {"state": "missing_schema", "missing_tables": missing}
        return {"state": "unpopulated" if all(self.read(t).isEmpty() for t in tables) else "ready", "missing_tables": []}

    def create(self, *tables: str) -> None:
        """Empty tables for those that don't exist."""
        base = self.tables()
        new = {t: {"parts": {}, "loose": []} for t in self.missing(*tables)}
        if new:
            self.commit(base, new)

    def keys(self, table: str) -> list[str]:
        return list(keys(table))


def folders(state: dict) -> list[str]:
    """All folders of a table's state."""
    return [f for names in state["parts"].values() for f in names] + state["loose"]


def sql(spark: SparkSession, text: str, views: dict[str, DataFrame] | None = None, **parameters) -> DataFrame:
    """A query with named parameters (:name) over views."""
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(text, args=parameters)


def read_csv(spark: SparkSession, path: str, ddl: str, required: tuple[str, ...] = ()) -> DataFrame:
    """A CSV file with a header, quoted line breaks and an explicit schema; missing required columns are an error."""
    header = spark.read.option("header", True).csv(path).limit(0)
    require(header, *required)
    return spark.read.schema(ddl).csv(path, header=True, multiLine=True, escape='"', enforceSchema=False)


def read_jdbc(spark: SparkSession, url: str, table: str, *, column: str | None = None, bounds: tuple[int, int] = (0, 0), partitions: int = 8, **properties: str) -> DataFrame:
    """A database table; with a numeric column it is read in ranges, `partitions` connections at a time."""
    if column is None:
        return spark.read.jdbc(url, table, properties=properties)
    return spark.read.jdbc(url, table, column=column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions, properties=properties)


def gathered(vectors: DataFrame, wanted: DataFrame, key: str = "id", position: str | None = None) -> DataFrame:
    """The vectors of the wanted keys; keys without a vector are left out.

    With `position`, the column of row numbers, a wanted key that no vector has but that reads as a number takes the vector
    at that row instead; its rows come under the key that was wanted.
    """
    keys = wanted.select(F.col(key).cast("string").alias("_wanted")).where("_wanted is not null").distinct()
    named = vectors.withColumn("_key", F.col(key).cast("string"))
    found = named.join(keys, F.col("_key") == F.col("_wanted"), "left_semi").drop("_key")
    if position is None:
        return found
    rest = keys.join(named.select("_key"), F.col("_wanted") == F.col("_key"), "left_anti").select("_wanted", F.expr("try_cast(_wanted as bigint)").alias("_at")).where("_at is not null")
    placed = vectors.join(rest, F.col(position) == F.col("_at"))
    return found.unionByName(placed.withColumn(key, F.col("_wanted").cast(vectors.schema[key].dataType)).select(*vectors.columns))


def extracted_posts(raw: DataFrame) -> DataFrame:
    """Landing records -> posts: epoch seconds as UTC time, empty body for none, [deleted] for no author, summed karma."""
    raw = _with(raw, id="string", title="string", selftext="string", score="int", created_utc="double", subreddit="string", author="string", link_karma="int", comment_karma="int", url="string", num_comments="int")
    return raw.select("id", "title", F.coalesce("selftext", F.lit("")).alias("content"), F.col("score").alias("upvotes"), F.timestamp_seconds("created_utc").alias("timestamp"), "subreddit", F.coalesce("author", F.lit("[deleted]")).alias("author"), _karma().alias("author_karma"), "url", "num_comments", F.lit("post").alias("content_type"))


def extracted_comments(raw: DataFrame) -> DataFrame:
    """Landing records -> comments; those whose body is [deleted] are dropped."""
    raw = _with(raw, id="string", parent_id="string", body="string", score="int", created_utc="double", subreddit="string", author="string", link_karma="int", comment_karma="int", post_id="string")
    raw = raw.where(F.coalesce("body", F.lit("")) != "[deleted]")
    return raw.select("id", "parent_id", F.coalesce("body", F.lit("")).alias("content"), F.col("score").alias("upvotes"), F.timestamp_seconds("created_utc").alias("timestamp"), "subreddit", F.coalesce("author", F.lit("[deleted]")).alias("author"), _karma().alias("author_karma"), "post_id", F.lit("comment").alias("content_type"))


def flattened_comments(trees: DataFrame, limit: int | None = None, depth: int | None = None) -> DataFrame:
    """trees(post_id, tree: a JSON list of comments with nested `replies`) -> post_id, place, comment (JSON), parents first.

    Level by level, as deep as there are replies, or `depth` levels below the first; `limit` keeps the first so many of each post.
    """
    level = trees.select("post_id", F.posexplode(F.from_json("tree", "array<string>")).alias("k", "comment"))
    level = level.select("post_id", F.array("k").alias("path"), "comment")
    out = level
    for _ in itertools.count() if depth is None else range(depth):
        level = level.select("post_id", "path", F.posexplode(F.from_json(F.get_json_object("comment", "$.replies"), "array<string>")).alias("k", "comment"))
        level = level.select("post_id", F.concat("path", F.array("k")).alias("path"), "comment")
        if level.isEmpty():
            break
        out = out.union(level)
    place = F.row_number().over(Window.partitionBy("post_id").orderBy(F.size("path"), "path"))
    out = out.select("post_id", place.alias("place"), "comment")
    return out.where(F.col("place") <= limit) if limit is not None else out


def _karma():
    return F.coalesce("link_karma", F.lit(0)) + F.coalesce("comment_karma", F.lit(0))


def _with(df: DataFrame, **columns: str) -> DataFrame:
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()))


@dataclass
class Settings:
    """Collection settings; lists in the environment are separated by commas."""

    groups: list[str] = field(default_factory=list)
    keywords: list[str] = field(default_factory=list)
    posts_per_group: int = 100
    comments_per_post: int = 50
    requests: int = 600
    window_seconds: int = 600

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None, prefix: str = "FORUMLENS_") -> Settings:
        env = os.environ if env is None else env
        parts = lambda name: [x.strip() for x in env.get(prefix + name, "").split(",") if x.strip()]
        number = lambda name, default: int(env.get(prefix + name) or default)
        return cls(parts("GROUPS"), parts("KEYWORDS"), number("POSTS_PER_GROUP", 100), number("COMMENTS_PER_POST", 50), number("REQUESTS", 600), number("WINDOW_SECONDS", 600))


class _Group(InputPartition):
    def __init__(self, name: str):
        self.name = name


class PullReader(DataSourceReader):
    """One partition a group; `pull(group, listing, limit)` yields records."""

    def __init__(self, options: dict, pull: Callable[[str, str, int], Iterator[dict]], fields: list[str]):
        self.groups = [g for g in options.get("groups", "").split(",") if g]
        self.listing, self.limit = options.get("listing", "new"), int(options.get("limit", "100"))
        if self.listing not in ("hot", "new", "top", "rising"):
            raise ValueError(f"unknown listing: {self.listing}")
        self.pull, self.fields = pull, fields

    def partitions(self):
        return [_Group(g) for g in self.groups]

    def read(self, partition):
        for k, record in enumerate(self.pull(partition.name, self.listing, self.limit)):
            if k >= self.limit:
                return
            yield tuple(record.get(f) for f in self.fields)


def pull_source(name: str, ddl: str, pull: Callable[[str, str, int], Iterator[dict]]) -> type[DataSource]:
    """A data source class to register: spark.dataSource.register(pull_source(...)), then spark.read.format(name)."""
    fields = [c.split()[0] for c in ddl.split(",")]

    class Pull(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return ddl

        def reader(self, schema) -> DataSourceReader:
            return PullReader(dict(self.options), pull, fields)

    return Pull
