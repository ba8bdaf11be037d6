"""The batch pipeline: nine steps over a store, gates between them, stop at the first failure."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon, text
from ..operators import model, series, topics
from ..operators.filters import usable, unprocessed
from ..schemas import GATE_TOPICS, GATE_WEAK_LABELS
from ..sources import sinks
from ..sources.readers import Store


def content(store: Store) -> DataFrame:
    p = store.read("posts").select("id", "title", "content", "subreddit", "timestamp", "author", "upvotes", "num_comments", F.lit("post").alias("content_type"))
    c = store.read("comments").select("id", F.lit(None).cast("string").alias("title"), "content", "subreddit", "timestamp", "author", "upvotes", F.lit(0).alias("num_comments"), F.lit("comment").alias("content_type"))
    return p.unionByName(c)


#: Rows that a step must have left before the next may run; one row unless stated here.
LEAST = {3: GATE_WEAK_LABELS, 6: GATE_TOPICS}


def step_states(tables: dict[int, DataFrame]) -> DataFrame:
    """Step number -> the rows it leaves: num, done, state. A step is done with enough rows, else idle if the one before it is done, else locked.

    One row a step; no table is counted further than its gate.
    """
    counts = [t.limit(LEAST.get(k, 1)).agg(F.count("*").alias("n")).select(F.lit(k).alias("num"), (F.col("n") >= LEAST.get(k, 1)).alias("done")) for k, t in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.union(c)
    before = out.select((F.col("num") + 1).alias("num"), F.col("done").alias("before"))
    state = F.when(F.col("done"), "done").when((F.col("num") == min(tables)) | F.coalesce("before", F.lit(False)), "idle").otherwise("locked")
    return out.join(before, "num", "left").select("num", "done", state.alias("state"))


@dataclass
class Pipeline:
    """Steps by number and name; each reads and writes the store and can be run again."""

    store: Store
    as_of: datetime
    topics: int = 20
    lemmatize: bool = False
    model: object = field(default=None)

    def preprocess(self) -> dict[str, float]:
        """Clean what was not cleaned yet, mark bots, empty and short texts, and keep a vector key for the rest."""
        new = unprocessed(content(self.store), self.store.read("preprocessed"), "id")
        rows = new.select("id", "content_type", text.raw_text(F.col("title"), F.col("content")).alias("raw_text"), "author")
        rows = rows.withColumn("clean_text", text.lemmas(text.clean(F.col("raw_text"))) if self.lemmatize else text.clean(F.col("raw_text"))).withColumn("token_count", text.token_count(F.col("clean_text")))
        rows = rows.withColumn("filter_reason", text.filter_reason(F.col("author"), F.col("token_count"))).withColumn("is_filtered", F.col("filter_reason").isNotNull())
        rows = rows.withColumn("embedding_key", F.when(~F.col("is_filtered"), F.col("id"))).withColumn("processed_at", F.lit(self.as_of))
        sinks.insert_ignore(self.store, "preprocessed", rows, F.desc_nulls_last)  # new ones only: what was prepared before is not written again
        done = self.store.read("preprocessed").where(F.col("processed_at") == F.lit(self.as_of)).agg(F.count("*").alias("record_count"), F.count_if(~F.col("is_filtered")).alias("kept_count"), F.count_if("is_filtered").alias("filtered_count"))
        kept = usable(self.store.read("preprocessed")).select("id", F.col("clean_text").alias("text"))
        sinks.insert_ignore(self.store, "embeddings", model.embedded(unprocessed(kept, self.store.read("embeddings"), "id")))
        return done.first().asDict()

    def weak_labels(self) -> DataFrame:
        """Kept texts whose lexicon score decides a label."""
        kept = usable(self.store.read("preprocessed"))
        scored = lexicon.with_compound(kept.select("id", F.col("clean_text").alias("text")), "text")
        return scored.withColumn("label", lexicon.weak_label(F.col("compound"))).where("label is not null")

    def train(self) -> dict[str, float]:
        labelled = model.stratified_split(self.weak_labels())
        self.model = model.trained(labelled.where("split = 'train'"))
        judged = model.predicted(self.model, labelled.where("split = 'validation'")).select("id", F.col("label").alias("predicted")).join(labelled.select("id", "label"), "id")
        report = model.f1_report(judged).agg(F.avg("f1").alias("f1_macro")).first()
        return {"rows": labelled.count(), "f1_macro": report["f1_macro"] or 0.0}

    def score(self) -> dict[str, float]:
        """Label what has no prediction yet: by the trained model, or by the lexicon where none was trained."""
        todo = unprocessed(usable(self.store.read("preprocessed")), self.store.read("sentiment_predictions"), "id")
        if self.model is not None:
            rows = model.predicted(self.model, todo.select("id", F.col("clean_text").alias("text"))).join(todo.select("id", "content_type"), "id")
        else:
            rows = lexicon.with_compound(todo.select("id", "content_type", "clean_text"), "clean_text", "c").select("id", "content_type", lexicon.sign_label(F.col("c")).alias("label"), F.greatest(F.abs("c"), F.lit(0.5)).alias("confidence"))
        rows = rows.withColumn("predicted_at", F.lit(self.as_of)).withColumn("model_version", F.lit("v1"))
        return {"scored": sinks.upsert(self.store, "sentiment_predictions", rows)}

    def topic_model(self) -> dict[str, float]:
        """Clusters, keywords, coherence and weekly trend; the three topic tables are written anew."""
        kept = usable(self.store.read("preprocessed")).select("id", F.col("clean_text").alias("text"))
        vectors = self.store.read("embeddings").join(kept.select("id"), "id", "left_semi")
        k = min(self.topics, vectors.count())
        if k < 2:
            return {"topics": 0, "passed": 0}
        found = topics.clustered(vectors, k)
        sinks.overwrite(self.store, "topic_assignments", found.withColumn("assigned_at", F.lit(self.as_of)))
        docs = self.store.read("topic_assignments").join(kept, "id").select("topic_id", "text")
        terms = topics.topic_keywords(docs)
        lists = terms.groupBy("topic_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]).alias("keywords"))
        rows = docs.groupBy("topic_id").agg(F.count("*").alias("doc_count")).join(lists, "topic_id", "left").join(topics.coherence(docs, terms), "topic_id", "left").withColumn("created_at", F.lit(self.as_of))
        sinks.overwrite(self.store, "topics", rows)
        sinks.overwrite(self.store, "topic_over_time", series.weekly_topics(self._assigned()))
        gate = topics.gate(self.store.read("topics")).first()
        return {"topics": gate["coherent"], "passed": float(gate["passed"])}

    def _assigned(self) -> DataFrame:
        found = self.store.read("topic_assignments").select("id", "topic_id")
        return found.join(content(self.store).select("id", "subreddit", "timestamp"), "id").join(self.store.read("sentiment_predictions").select("id", "label"), "id", "left")

    def time_series(self) -> dict[str, float]:
        scored = self.store.read("sentiment_predictions").select("id", "content_type", "label").join(content(self.store), ["id", "content_type"])
        sinks.upsert(self.store, "sentiment_daily", series.daily_sentiment(scored))
        daily = self.store.read("sentiment_daily")
        sinks.upsert(self.store, "sentiment_moving_avg", series.trailing_means(daily))
        sinks.upsert(self.store, "change_points", series.change_points(daily))
        sinks.upsert(self.store, "sentiment_forecast", series.forecast(daily))
        sinks.upsert(self.store, "topic_sentiment_trends", series.topic_trend(self._assigned()))
        return {"days": daily.count()}

    def steps(self) -> dict[int, tuple[str, Callable[[], dict[str, float]]]]:
        return {
            1: ("check", lambda: {"missing": len(self.store.missing("posts", "comments"))}),
            2: ("preprocess", self.preprocess),
            3: ("weak_labels", lambda: {"labels": self.weak_labels().count()}),
            4: ("train", self.train),
            5: ("score", self.score),
            6: ("topics", self.topic_model),
            7: ("time_series", self.time_series),
            8: ("labels", self._labels),
            9: ("events", self._events),
        }

    def _labels(self) -> dict[str, float]:
        from .jobs import cluster_labels

        return {"labels": sinks.upsert(self.store, "cluster_labels", cluster_labels(self.store.read("topics")))}

    def _events(self) -> dict[str, float]:
        from .jobs import narrative_events

        events = narrative_events(self.store.read("change_points"), self.store.read("posts"), self._assigned(), self.store.read("topics"))
        rows = events.withColumn("event_id", F.abs(F.xxhash64("peak_date", "auto_label")))
        return {"events": sinks.upsert(self.store, "narrative_events", rows, keep=())}

    def done(self) -> dict[str, bool]:
        """Which gates are open, from what the store holds."""
        some = lambda t: not self.store.read(t).isEmpty()
        return {
            "preprocess": some("preprocessed"),
            "score": some("sentiment_predictions"),
            "topics": self.store.read("topics").where("topic_id >= 0").count() >= min(self.topics, GATE_TOPICS),
            "time_series": some("sentiment_daily"),
            "labels": some("cluster_labels"),
            "events": some("narrative_events"),
        }

    def status(self) -> list[dict]:
        """done, idle (may run) or locked (waits for a step before it)."""
        out, open_ = [], True
        gates = self.done()
        for name, ok in gates.items():
            out.append({"step": name, "state": "done" if ok else "idle" if open_ else "locked"})
            open_ = open_ and ok
        return out

    def run(self, numbers: list[int] | None = None) -> Iterator[str]:
        """Runs the steps in order and yields a line for each; ends at the first that fails."""
        for k, (name, step) in self.steps().items():
            if numbers and k not in numbers:
                continue
            began = time.monotonic()
            try:
                metrics = step()
            except Exception as error:
                yield f"[{k}] {name} failed: {error}"[:500]
                return
            sinks.log_metrics(self.store, self.as_of.isoformat(), name, {m: float(v) for m, v in metrics.items()}, self.as_of)
            yield f"[{k}] {name} done in {time.monotonic() - began:.1f} s: {metrics}"
