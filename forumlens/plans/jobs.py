"""Producers of derived artifacts: cluster labels, map positions, narrative events, the brief, and text enrichment.

The text generator is a callable, so that any host, or none, can be behind it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as words
from ..functions.vector import projected
from ..operators.filters import first_rows
from .artifacts import ArtifactLog, checksum

Chat = Callable[[str], str]


def cluster_labels(topics: DataFrame) -> DataFrame:
    """topics(topic_id, keywords, doc_count) -> cluster_labels rows."""
    return topics.select(F.col("topic_id").alias("cluster_id"), words.cluster_label(F.col("keywords")).alias("label"), "keywords", "doc_count")


def embedding_map(vectors: DataFrame, assignments: DataFrame) -> DataFrame:
    """Positions of all vectors on two axes, with their clusters; outliers are left out."""
    kept = assignments.where("topic_id >= 0").select("id", F.col("topic_id").alias("cluster_id"))
    return projected(vectors.join(kept, "id")).select(F.col("id").alias("post_id"), "x", "y", "cluster_id")


def narrative_events(changes: DataFrame, posts: DataFrame, assigned: DataFrame, topics: DataFrame, limit: int = 20) -> DataFrame:
    """changes(subreddit, date, magnitude) -> the strongest shifts, each with its day's top posts and topic terms.

    posts(id, subreddit, timestamp, upvotes, num_comments); assigned(topic_id, subreddit, timestamp); topics(topic_id, keywords).
    One join a fact table for all events together.
    """
    top = changes.where("magnitude is not null").orderBy(F.desc(F.abs("magnitude")), "subreddit", "date").limit(limit)
    key = ["subreddit", "date"]
    days = F.broadcast(top.select(*key))
    on_day = posts.withColumn("date", F.to_date("timestamp")).join(days, key)
    weight = F.coalesce("upvotes", F.lit(0)) + F.coalesce("num_comments", F.lit(0))
    best = first_rows(on_day.withColumn("w", weight), key, F.desc("w"), F.asc("id"), n=3)
    best = best.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("w")).alias("o"), "id"))), lambda x: x["id"]).alias("top_post_ids"))
    named = assigned.where("topic_id >= 0").withColumn("date", F.to_date("timestamp")).join(days, key).groupBy(*key, "topic_id").agg(F.count("*").alias("n"))
    named = first_rows(named, key, F.desc("n"), F.asc("topic_id"), n=5).join(topics.select("topic_id", "keywords"), "topic_id")
    terms = named.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "topic_id", "keywords"))).alias("t"))
    terms = terms.select(*key, F.slice(F.array_distinct(F.flatten(F.transform("t", lambda x: x["keywords"]))), 1, 5).alias("top_terms"))
    label = F.concat(F.when(F.col("magnitude") >= 0, "Positive").otherwise("Negative"), F.lit(" sentiment shift in r/"), "subreddit")
    out = top.join(best, key, "left").join(terms, key, "left")
    default = F.array(F.col("subreddit"), F.lit("sentiment"), F.lit("change"))
    return out.select(
        F.col("date").alias("start_date"),
        F.col("date").alias("end_date"),
        F.col("date").alias("peak_date"),
        F.abs("magnitude").alias("peak_anomaly_score"),
        F.col("magnitude").alias("sentiment_delta"),
        F.array("subreddit").alias("dominant_subreddits"),
        F.when(F.size("top_terms") > 0, F.col("top_terms")).otherwise(default).alias("top_terms"),
        F.coalesce("top_post_ids", F.array().cast("array<string>")).alias("top_post_ids"),
        label.alias("auto_label"),
    )


# Kinds of artifacts and the texts of the brief.
EVENT_ROW, EVENT_SET, BRIEF = "narrative_event_row", "narrative_events", "analyst_brief"
BRIEF_SECTIONS = [
    ("Narrative events", "{events} persisted event signals are available."),
    ("Topic labels", "{topics} topic labels are available."),
    ("Model enrichment", "{models} configured LLM models are currently registered."),
]


def backfill_events(log: ArtifactLog, events: DataFrame) -> int:
    """Logs each event once, by date and label, and one aggregate artifact for the set; returns how many are new.

    events are the strongest shifts, a few dozen rows. All their transitions are written at once.
    """
    rows = [(str(r["peak_date"]), r["auto_label"], list(r["top_post_ids"])) for r in events.orderBy("peak_date", "auto_label").collect()]
    source = {(d, x): checksum({"narrative_event": f"{d}:{x}"}) for d, x, _ in rows}
    known, steps, new = log.known(EVENT_ROW, list(source.values())), [], set()
    for date, label, posts in rows:
        if source[date, label] not in known | new:
            payload = {"peak_date": date, "label": label, "top_post_ids": posts}
            row = log.queued(EVENT_ROW, source[date, label], payload, provider="deterministic")
            steps += [(row, None, "enqueued"), (log.succeeded(row, payload), "queued", "completed")]
            new.add(source[date, label])
    log.record(steps)
    total = log.state().where(F.col("kind") == EVENT_ROW).select("source_input_hash").distinct().count()
    whole = log.enqueue(EVENT_SET, checksum({"events": sorted(f"{d}:{x}" for d, x, _ in rows)}), {"event_count": total}, provider="deterministic")
    if whole["status"] != "succeeded":
        log.complete(whole["artifact_id"], {"event_count": total})
    return len(new)


def brief(log: ArtifactLog, events: int, topics: int, models: int) -> dict:
    """The latest brief from counts alone; logged once for each pair of event and topic counts."""
    counts = {"events": events, "topics": topics, "models": models}
    payload = {"brief_id": "latest", "period": "latest", "sections": [{"title": t, "body": b.format(**counts)} for t, b in BRIEF_SECTIONS]}
    made = log.enqueue(BRIEF, checksum({"event_count": events, "topic_count": topics}), payload, provider="deterministic")
    return made if made["status"] == "succeeded" else log.complete(made["artifact_id"], payload)


@dataclass
class Prompts:
    """Versioned prompt texts; each takes plain values and gives one prompt."""

    version: str = "v1"

    def thread(self, title: str, comments: list[tuple[str, str]]) -> str:
        lines = "\n".join(f"- [{label}] {body[:240]}" for label, body in comments)
        return f"Say in three sentences what this discussion is about and where people disagree.\nTitle: {title}\nComments:\n{lines}"

    def event(self, label: str, date: str, delta: float, terms: list[str], posts: list[str]) -> str:
        titles = "\n".join(f"- {p[:160]}" for p in posts)
        return f"Give a short headline on the first line and a summary below it.\nEvent: {label} on {date} (change {delta:+.3f})\nTerms: {', '.join(terms)}\nPosts:\n{titles}"

    def brief(self, events: list[str], topics: list[str]) -> str:
        return "Write a headline on the first line and a brief below it.\nEvents:\n" + "\n".join(f"- {e}" for e in events) + "\nTopics: " + ", ".join(topics)

    def topic(self, keywords: list[str]) -> str:
        return f"Name this topic in at most five words, on one line.\nKeywords: {', '.join(keywords[:10])}"


def offline(prompt: str) -> str:
    """A stand-in generator: the same words for the same prompt."""
    first = prompt.rsplit(": ", 1)[-1].split("\n")[0]
    return f"{first[:60].strip() or 'Summary'}\n{checksum(prompt)[:12]}"


def preferred(wanted: list[str], available: list[str]) -> str | None:
    """The first wanted model that is available, else any, else none."""
    return next((m for m in wanted if m in available), available[0] if available else None)


def registered(models: DataFrame) -> DataFrame:
    """Models with a name; blank ones are left out."""
    return models.where(F.trim(F.coalesce("model_name", F.lit(""))) != "")


def category(error: Exception) -> str:
    name = type(error).__name__.lower()
    return "timeout" if "timeout" in name else "provider_unavailable" if "connection" in name else "rate_limited" if "limit" in name else "provider_error"


def enriched(log: ArtifactLog, kind: str, sources: list[tuple[object, str]], chat: Chat = offline, batch: int = 32) -> dict[str, str]:
    """Generate a text for each (source, prompt) that has none yet; failures are logged by category and don't stop the rest.

    Transitions are written `batch` sources at a time, so that a run that breaks off loses no more than those.
    """
    out: dict[str, str] = {}
    keyed = {checksum(source): prompt for source, prompt in sources}
    done = log.known(kind, list(keyed), "succeeded")
    todo = [(k, p) for k, p in keyed.items() if k not in done]
    for at in range(0, len(todo), batch):
        part = todo[at : at + batch]
        rows = [log.queued(kind, key, {"prompt": prompt}, prompt=Prompts().version) for key, prompt in part]
        before = {r["artifact_id"]: r.asDict() for r in log.state().where(F.col("artifact_id").isin([r["artifact_id"] for r in rows])).collect()}
        steps = [(r, None, "enqueued") for r in rows if r["artifact_id"] not in before]
        for row, (key, prompt) in zip(rows, part):
            row = before.get(row["artifact_id"], row)
            try:
                answer = chat(prompt)
            except Exception as error:
                steps.append((log.failed(row, category(error), str(error)), row["status"], category(error)))
                continue
            lines = [x.strip() for x in answer.split("\n") if x.strip()]
            steps.append((log.succeeded(row, {"headline": lines[0] if lines else "", "body": "\n".join(lines[1:])}), row["status"], "completed"))
            out[key] = answer
        log.record(steps)
    return out


def overlaid(events: DataFrame, artifacts: DataFrame) -> DataFrame:
    """events with the headline and body of generated artifacts where there are any (by event_id in the payload)."""
    done = artifacts.where("status = 'succeeded'").select(F.get_json_object("payload", "$.event_id").cast("long").alias("event_id"), F.get_json_object("payload", "$.headline").alias("llm_label_new"), F.get_json_object("payload", "$.body").alias("llm_summary_new"), "updated_at")
    latest = first_rows(done.where("event_id is not null"), ["event_id"], F.desc("updated_at"))
    out = events.join(latest.drop("updated_at"), "event_id", "left")
    return out.withColumns({"llm_label": F.coalesce("llm_label_new", "llm_label"), "llm_summary": F.coalesce("llm_summary_new", "llm_summary")}).drop("llm_label_new", "llm_summary_new")
