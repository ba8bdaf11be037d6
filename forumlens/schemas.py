"""Schemas of the runtime tables, their keys, and the constants of the domain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: table -> (DDL, key columns). Types are Spark's; lists are arrays rather than JSON text.
TABLES: dict[str, tuple[str, tuple[str, ...]]] = {
    "posts": ("id string, title string, content string, upvotes int, timestamp timestamp, subreddit string, author string, author_karma int, url string, num_comments int, content_type string, created_at timestamp", ("id",)),
    "comments": ("id string, parent_id string, content string, upvotes int, timestamp timestamp, subreddit string, author string, author_karma int, post_id string, content_type string, created_at timestamp", ("id",)),
    "api_metrics": ("timestamp timestamp, requests_made int, requests_failed int, rate_limit_hits int, circuit_breaker_trips int", ()),
    "collection_metadata": ("subreddit string, collection_timestamp timestamp, posts_collected int, comments_collected int, created_at timestamp", ("subreddit", "collection_timestamp")),
    "batch_collections": ("subreddit string, collection_timestamp timestamp, posts_collected int, comments_collected int, processing_time_seconds double, batch_status string, storage_timestamp timestamp, created_at timestamp", ("subreddit", "collection_timestamp")),
    "preprocessed": ("id string, content_type string, raw_text string, clean_text string, token_count int, is_filtered boolean, filter_reason string, embedding_key string, processed_at timestamp", ("id",)),
    "sentiment_predictions": ("id string, content_type string, label string, confidence double, logits array<double>, model_version string, predicted_at timestamp", ("id",)),
    "topics": ("topic_id int, keywords array<string>, doc_count int, coherence_score double, created_at timestamp", ("topic_id",)),
    "topic_assignments": ("id string, topic_id int, probability double, assigned_at timestamp", ("id",)),
    "topic_over_time": ("topic_id int, week_start date, doc_count int, avg_sentiment double", ("topic_id", "week_start")),
    "sentiment_daily": ("subreddit string, date date, mean_score double, pos_count int, neu_count int, neg_count int", ("subreddit", "date")),
    "sentiment_moving_avg": ("subreddit string, date date, rolling_7d double, rolling_30d double", ("subreddit", "date")),
    "change_points": ("subreddit string, date date, magnitude double", ("subreddit", "date")),
    "sentiment_forecast": ("subreddit string, date date, yhat double, yhat_lower double, yhat_upper double", ("subreddit", "date")),
    "topic_sentiment_trends": ("topic_id int, date date, mean_sentiment double, rolling_7d double", ("topic_id", "date")),
    "analysis_schema_version": ("key string, version int, applied_at timestamp", ("key",)),
    "llm_model_registry": ("model_name string, provider string, available boolean, metadata string, discovered_at timestamp", ("model_name",)),
    "analysis_artifacts": (
        "artifact_id string, kind string, status string, idempotency_key string, payload string, checksum string, schema_version int, source_input_hash string, provider string, model_name string, prompt_version string,"
        " freshness_timestamp timestamp, attempts int, max_attempts int, lease_owner string, lease_expires_at timestamp, retry_after timestamp, error_category string, error_message string, created_at timestamp, updated_at timestamp",
        ("artifact_id",),
    ),
    "artifact_status_history": ("artifact_id string, from_status string, to_status string, reason string, worker_id string, created_at timestamp", ()),
    "embedding_2d": ("post_id string, x double, y double, cluster_id int", ("post_id",)),
    "cluster_labels": ("cluster_id int, label string, keywords array<string>, doc_count int", ("cluster_id",)),
    "narrative_events": ("event_id long, start_date date, end_date date, peak_date date, peak_anomaly_score double, sentiment_delta double, dominant_subreddits array<string>, top_terms array<string>, top_post_ids array<string>, auto_label string, llm_label string, llm_summary string", ("event_id",)),
    "embeddings": ("id string, vector array<float>", ("id",)),
    "run_metrics": ("run_id string, stage string, metric string, value double, logged_at timestamp", ()),
}

#: Fixed values of the domain.
LABEL_SCORE = {"positive": 1, "neutral": 0, "negative": -1}
LABEL_ID = {"negative": 0, "neutral": 1, "positive": 2}
MIN_TOKENS = 10
LEXICON_CUT = 0.05
WEAK_POSITIVE, WEAK_NEGATIVE, WEAK_NEUTRAL = 0.5, -0.5, 0.1
LOW_CONFIDENCE, HIGH_CONFIDENCE = 0.6, 0.75
OUTLIER_TOPIC = -1
GATE_TOPICS, GATE_COHERENCE, GATE_WEAK_LABELS = 20, 0.50, 30_000


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table][0])


def keys(table: str) -> tuple[str, ...]:
    return TABLES[table][1]


def require(df: DataFrame, *columns: str) -> DataFrame:
    """df, or a ValueError that names the columns it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
