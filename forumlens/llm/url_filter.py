"""URL filtering against dated lists, in DataFrame functions only.

List entries carry a date and an action. Per entry they become validity intervals, so that the state as
of any moment is the one interval that holds it. A capture is looked up under each domain suffix of
its host and each path prefix below the host, and is blocked by the entries active when it was fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

URL = r"^\s*[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)([^?#]*)"


def intervals(entries: DataFrame) -> DataFrame:
    """entries(entry, category, action, at) -> entry, category, since, until (null: open).

    The latest action at or before a moment decides; at one moment `remove` overrides `add`. Repeated
    entries are one. Rows with a null entry, action or date, or another action, say nothing.
    """
    e = entries.select(F.lower(F.trim(entries["entry"])).alias("entry"), F.coalesce(entries["category"].cast("string"), F.lit("")).alias("category"), entries["action"].alias("action"), entries["at"].cast("timestamp").alias("at"))
    e = e.where("entry != '' and action in ('add', 'remove') and at is not null")
    e = e.groupBy("entry", "category", "at").agg(F.max("action").alias("action"))
    e = e.withColumn("until", F.lead("at").over(Window.partitionBy("entry", "category").orderBy("at")))
    return e.where("action = 'add'").select("entry", "category", F.col("at").alias("since"), "until")


def host_of(url: str) -> Column:
    """The host in a column of URLs, in lower case, without user, port and closing dots; empty if there is none."""
    authority = F.lower(F.regexp_extract(F.col(url), URL, 1))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", ""), r"\.+$", "")


def keyed(captures: DataFrame, labels: int, steps: int) -> DataFrame:
    """captures with host and keys: every domain suffix of the host, and host plus every path prefix at a slash.

    Only as long as the longest entry, of `labels` domain labels and `steps` path steps: longer ones can match none, and
    a URL of very many steps would otherwise have keys of the square of its length.
    """
    host = host_of("url")
    path = F.regexp_replace(F.regexp_extract(F.col("url"), URL, 2), r"/+$", "")
    c = captures.withColumn("host", F.when(host != "", host)).withColumn("_labels", F.split("host", r"\.")).withColumn("_steps", F.filter(F.split(path, "/"), lambda x: x != ""))
    first = F.greatest(F.lit(1), F.size("_labels") - (max(labels, 1) - 1))
    domains = F.transform(F.sequence(first, F.size("_labels")), lambda i: F.array_join(F.slice("_labels", i, F.size("_labels")), "."))
    paths = F.when((F.size("_steps") > 0) & F.lit(steps > 0), F.transform(F.sequence(F.lit(1), F.least(F.size("_steps"), F.lit(max(steps, 1)))), lambda i: F.concat(F.col("host"), F.lit("/"), F.lower(F.array_join(F.slice("_steps", F.lit(1), i), "/")))))
    keys = F.when(F.col("host").isNotNull(), F.array_distinct(F.concat(domains, F.coalesce(paths, F.array().cast("array<string>")))))
    return c.withColumn("keys", keys).drop("_labels", "_steps")


#: Intervals of a list that is broadcast; a longer list is joined by key, where skew handling splits a hot host.
BROADCAST_INTERVALS = 200_000


def url_filter(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures(page_id, url, fetched), entries(entry, category, action, at) -> one row per capture.

    Columns: page_id, url, fetched, host, blocked, n_entries, categories (sorted, joined by a comma).
    An entry is a domain (it covers its subdomains) or host/path prefix, without scheme. A null or
    unreadable URL has no host and is never blocked, nor is a capture without a fetch time. Repeated
    captures are judged each. URLs of any length are read whole. Empty tables and empty lists give no rows and no blocks; other columns
    are ignored. The join is by key, with the interval as its condition; see BROADCAST_INTERVALS.
    """
    c = captures.select(captures["page_id"].cast("long").alias("page_id"), captures["url"].cast("string").alias("url"), captures["fetched"].cast("timestamp").alias("fetched"))
    span = intervals(entries)
    parts = F.split("entry", "/")
    longest = span.agg(F.max(F.size(F.split(F.get(parts, F.lit(0)), r"\."))).alias("labels"), F.max(F.size(parts) - 1).alias("steps")).first()
    c = keyed(c, longest["labels"] or 0, longest["steps"] or 0)
    if span.limit(BROADCAST_INTERVALS + 1).count() <= BROADCAST_INTERVALS:
        span = F.broadcast(span)
    looked = c.where("fetched is not null").select("page_id", "url", "fetched", F.explode("keys").alias("entry"))
    active = looked.join(span, "entry").where("since <= fetched and (until is null or fetched < until)")
    found = active.distinct().groupBy("page_id", "url", "fetched").agg(F.count("*").alias("n_entries"), F.array_join(F.sort_array(F.collect_set("category")), ",").alias("categories"))
    found = found.select(F.col("page_id").alias("_p"), F.col("url").alias("_u"), F.col("fetched").alias("_f"), "n_entries", "categories")
    out = c.join(found, c["page_id"].eqNullSafe(found["_p"]) & (c["url"] == found["_u"]) & (c["fetched"] == found["_f"]), "left")
    return out.select("page_id", "url", "fetched", "host", F.col("n_entries").isNotNull().alias("blocked"), F.coalesce("n_entries", F.lit(0)).alias("n_entries"), F.coalesce("categories", F.lit("")).alias("categories"))
