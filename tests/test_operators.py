import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from forumlens.operators import filters, model, search, series, topics, upkeep

T = dt.datetime(2026, 5, 1, 12)


def days(spark, values, group="a"):
    return spark.createDataFrame([(group, dt.date(2026, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)], "subreddit string, date date, mean_score double")


def test_daily_sentiment_drops_null_groups(spark):
    rows = [("a", T, "positive"), ("a", T, "negative"), ("a", T, "odd"), (None, T, "positive")]
    out = series.daily_sentiment(spark.createDataFrame(rows, "subreddit string, timestamp timestamp, label string")).collect()
    assert [tuple(r) for r in out] == [("a", T.date(), 0.0, 1, 0, 1)]


def test_trailing_means_count_rows_not_days(spark):
    df = spark.createDataFrame([("a", dt.date(2026, 1, d), float(d)) for d in (1, 2, 20, 21)], "subreddit string, date date, mean_score double")
    out = {r.date.day: r.rolling_2d for r in series.trailing_means(df, rows=(2,)).collect()}
    assert out == {1: 1.0, 2: 1.5, 20: 11.0, 21: 20.5}


def test_shift_sizes_at_the_edges(spark):
    out = [r.magnitude for r in series.shift_sizes(days(spark, [0, 0, 0, 3, 3, 3])).orderBy("date").collect()]
    assert out == [None, 1.0, 2.0, 3.0, 2.25, 1.5] or out[0] is None and out[3] == 3.0


def test_breakpoints_of_a_step():
    x = np.r_[np.zeros(20), np.ones(20) * 5] + np.tile([0.01, -0.01], 20)
    assert series.breakpoints(x) == [20, 40]
    assert series.breakpoints(np.zeros(12)) == [12]


def test_change_points(spark):
    step = days(spark, [0.0] * 20 + [1.0] * 20)
    out = series.change_points(step).collect()
    assert [(r.date - dt.date(2026, 1, 1)).days for r in out] == [19]
    assert series.change_points(step, include_terminal=True).count() == 2
    assert series.change_points(days(spark, [1, 2, 3])).count() == 0


def test_forecast_needs_a_week(spark):
    assert series.forecast(days(spark, range(6))).count() == 0
    out = series.forecast(days(spark, [k * 0.1 for k in range(28)])).orderBy("date").collect()
    assert len(out) == 14 and out[-1].yhat == pytest.approx(4.1, abs=0.15)
    assert all(r.yhat_lower <= r.yhat_upper for r in out)


def test_weekly_topics(spark):
    rows = [(0, dt.datetime(2026, 3, 30, 10), lab) for lab in ("positive", "negative") * 2] + [(1, dt.datetime(2026, 4, 6, 10), None)] * 4
    out = series.weekly_topics(spark.createDataFrame(rows, "topic_id int, timestamp timestamp, label string")).orderBy("topic_id").collect()
    assert [tuple(r) for r in out] == [(0, dt.date(2026, 3, 30), 4, 0.0), (1, dt.date(2026, 4, 6), 4, None)]


def test_similarity_edges(spark):
    nodes = spark.createDataFrame([(1, ["ai"]), (2, ["ai", "policy"]), (3, ["crypto", "token"]), (4, [])], "topic_id int, terms array<string>")
    assert [tuple(r) for r in topics.similarity_edges(nodes, 0.1).collect()] == [(1, 2, 0.5, ["ai"])]
    assert topics.similarity_edges(nodes, 0.95).count() == 0


@pytest.mark.parametrize("scores, want", [([0.65] * 25, (25, True)), ([0.65] * 15, (15, False)), ([0.65] * 10 + [0.3] * 15, (10, False)), ([], (0, False))])
def test_gate(spark, scores, want):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(scores)] + [(-1, 0.99)], "topic_id int, coherence_score double")
    r = topics.gate(df).first()
    assert (r.coherent, r.passed) == want


def test_coherence(spark):
    docs = spark.createDataFrame([(0, "gpu ram"), (0, "gpu ram disk"), (0, "gpu"), (1, "x")], "topic_id int, text string")
    words = spark.createDataFrame([(0, 1, "gpu"), (0, 2, "ram"), (0, 3, "disk"), (2, 1, "none")], "topic_id int, place int, word string")
    out = {r.topic_id: r.coherence_score for r in topics.coherence(docs, words).collect()}
    want = np.exp(np.mean([np.log(3 / 4), np.log(2 / 4), np.log(2 / 3)]))
    assert out[0] == pytest.approx(want) and out[2] == 0.0


def test_clusters(spark):
    r = np.random.default_rng(0)
    rows = [(i, (np.eye(3)[i % 3] + r.normal(0, 0.01, 3)).tolist()) for i in range(60)]
    out = {x.id: x.topic_id for x in topics.clustered(spark.createDataFrame(rows, "id int, vector array<double>"), 3).collect()}
    real = [{out[i] for i in range(k, 60, 3)} - {-1} for k in range(3)]
    assert all(len(s) == 1 for s in real) and len(set.union(*real)) == 3


def test_search(spark):
    docs = spark.createDataFrame([("p1", "open source local model benchmark"), ("p2", "open thread about coffee"), ("p3", None)], "id string, text string")
    out = search.search("lexical", "open model benchmark", docs=docs).collect()
    assert [r.id for r in out] == ["p1", "p2"] and out[0].score == 0.6 and out[0].algorithm == "lexical_overlap_fallback"
    assert [r.id for r in search.search("like", "COFFEE", docs=docs).collect()] == ["p2"]
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [-1.0, 0.0]), ("c", [1.0, 1.0])], "id string, vector array<double>")
    assert [(r.id, r.score) for r in search.search("vector", [1.0, 0.0], vectors=vectors).collect()] == [("a", 1.0), ("c", 0.7071), ("b", 0.0)]


def test_filters(spark):
    df = spark.createDataFrame([(1, "a", T, "x GPU"), (2, "b", T - dt.timedelta(days=40), None), (3, None, None, "y")], "id int, subreddit string, timestamp timestamp, title string")
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(filters.in_groups(df)) == [1, 2, 3] and ids(filters.in_groups(df, ("a",))) == [1]
    assert ids(filters.between_days(df, "2026-05-01", "2026-05-01")) == [1]
    assert ids(filters.recent(df, 30, T)) == [1]
    assert ids(df.where(filters.holds_any(["gpu"], "title"))) == [1] and ids(df.where(filters.holds_any([], "title"))) == [1, 2, 3]
    assert ids(filters.page(df, F.asc("id"), limit=1, offset=1)) == [2]
    assert ids(filters.unprocessed(df, df.where("id = 1"), "id")) == [2, 3]
    assert len(filters.hashed_sample(df, "id", 2).collect()) == 2


def test_upsert_keeps_and_replaces(spark):
    ddl = "id int, v string, created_at int"
    old, new = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], ddl), spark.createDataFrame([(2, "c", 9), (2, "d", 9), (3, "e", 9)], ddl)
    assert sorted(map(tuple, upkeep.upserted(old, new, ["id"], ("created_at",)).collect())) == [(1, "a", 1), (2, "d", 1), (3, "e", 9)]
    assert sorted(map(tuple, upkeep.inserted(old, new, ["id"]).collect())) == [(1, "a", 1), (2, "b", 1), (3, "e", 9)]


def test_deduplication(spark):
    posts = spark.createDataFrame([(1, "p1", "t", "x", T), (2, "p1", "t2", "x", T), (3, "p2", "t2", "x", T), (4, "p3", "u", None, T), (5, "p4", "u", None, T)], "seq int, id string, title string, author string, timestamp timestamp")
    comments = spark.createDataFrame([(1, "c1", "a", "x", T, "p1"), (2, "c2", "a", "x", T, "p1"), (3, "c3", "b", "x", T, "p2"), (4, "c4", "d", "x", T, None)], "seq int, id string, content string, author string, timestamp timestamp, post_id string")
    p, c = upkeep.deduplicated(posts, comments)
    assert sorted(r.id for r in p.collect()) == ["p1", "p3"] and {r.title for r in p.collect()} == {"t2", "u"}
    assert sorted(r.id for r in c.collect()) == ["c1", "c4"]


def test_duplicate_counts_follow_null_concatenation(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", None)], "t string, a string")
    assert upkeep.duplicate_counts(df, "t", "a").first()[0] == 2


def test_resume_state(spark):
    rows = [("test1", T - dt.timedelta(hours=2), 5, "completed"), ("test2", T - dt.timedelta(days=2), 5, "completed")]
    batches = spark.createDataFrame(rows, "subreddit string, collection_timestamp timestamp, posts_collected int, batch_status string")
    state = upkeep.resume_state(spark.createDataFrame([("test1",), ("test2",), ("test3",)], "subreddit string"), batches, T)
    assert sorted(r.subreddit for r in state.where("not completed").collect()) == ["test2", "test3"]
    assert upkeep.completion_percentage(state).first()[0] == 33.33


def test_split_retention_chunks_migration(spark):
    df = spark.createDataFrame([("a", T), ("b", None), (None, T - dt.timedelta(days=9))], "subreddit string, timestamp timestamp")
    stays, moves = upkeep.split_by_group(df, ["a"])
    assert stays.count() == 2 and moves.count() == 1
    assert upkeep.retained(df, T - dt.timedelta(days=1)).count() == 2
    chunks = upkeep.chunks_of(dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 11), 5, spark).collect()
    assert [(c.start.day, c.end.day) for c in chunks] == [(1, 6), (6, 11)]
    raw = spark.createDataFrame([("2026-01-01T00:00:00Z", "2026-01-02", "1", '["a"]', float("nan")), ("junk", None, "x", "junk", 1.0)], "t string, d string, b string, k string, v double")
    out = upkeep.migrated(raw, ("t",), ("d",), ("b",), ("k",)).collect()
    assert out[0].t == dt.datetime(2026, 1, 1) and out[0].b is True and out[0].k == ["a"] and out[0].v is None
    assert (out[1].t, out[1].d, out[1].b, out[1].k, out[1].v) == (None, None, None, None, 1.0)


def test_model(spark):
    texts = {"positive": "great good love", "negative": "bad awful hate", "neutral": "table chair door"}
    rows = [(f"{lab}{i}", f"{t} word{i % 5}", lab) for lab, t in texts.items() for i in range(20)]
    split = model.stratified_split(spark.createDataFrame(rows, "id string, text string, label string")).cache()
    assert {(r.label, r.split): r["count"] for r in split.groupBy("label", "split").count().collect()} == {(lab, s): n for lab in texts for s, n in (("train", 16), ("validation", 4))}
    fitted = model.trained(split.where("split = 'train'"), features=1 << 10, rounds=10)
    said = model.predicted(fitted, split.where("split = 'validation'")).select("id", F.col("label").alias("predicted"))
    report = model.f1_report(split.join(said, "id")).collect()
    assert len(report) == 3 and all(r.f1 > 0.9 for r in report)


def test_drift(spark):
    from forumlens.operators import drift

    a = spark.createDataFrame([("x", 0.9)] * 50 + [("y", 0.5)] * 50, "label string, confidence double")
    b = spark.createDataFrame([("x", 0.9)] * 20 + [("z", 0.1)] * 20, "label string, confidence double")
    same = drift.label_shift(a, a).first()
    assert same.chi_square == 0 and same.degrees == 1
    assert drift.label_shift(a, b).first().chi_square > 20
    assert drift.value_shift(a, a).first().distance == 0 and drift.value_shift(a, b).first().distance == pytest.approx(0.5)
    assert not drift.confidence_alarm(a, 0.6).first().alarm and drift.confidence_alarm(b).first().alarm
    assert drift.value_shift(a.limit(0), b.limit(0)).first().distance == 0


def test_views(spark):
    from forumlens.operators import views

    df = spark.createDataFrame([(1, 2.0), (2, 4.0), (3, -4.0)], "id int, x double")
    assert [r.x for r in views.min_max(df, "x").orderBy("id").collect()] == [0.75, 1.0, 0.0]
    assert [r.x for r in views.max_abs(df, "x").orderBy("id").collect()] == [0.5, 1.0, -1.0]
    assert views.min_max(df.where("id = 1"), "x").first().x == 0.0
    edges = spark.createDataFrame([(1, 2), (1, 3)], "source int, target int")
    assert {r.node: (r.neighbours, r.degree) for r in views.neighbours(edges).collect()} == {1: ([2, 3], 2), 2: ([1], 1), 3: ([1], 1)}
    calls = spark.createDataFrame([(T + dt.timedelta(minutes=m), "a") for m in (0, 5, 10, 30)], "ts timestamp, event_type string")
    assert [r.recent for r in views.request_rate(calls).orderBy("ts").collect()] == [1, 2, 3, 1]
    counts = spark.createDataFrame([("negative", 1), ("odd", 2), ("positive", 3)], "label string, n int")
    assert [(r.label, r.place) for r in views.in_label_order(counts).orderBy("place").collect()] == [("positive", 1), ("negative", 3)]
    tones = spark.createDataFrame([(x,) for x in (None, 0.5, 0.2, 0.0, -0.2, -0.9)], "x double").select(views.tone(F.col("x"))).collect()
    assert [r[0] for r in tones] == ["none", "very_positive", "positive", "neutral", "negative", "very_negative"]


def test_embedding(spark):
    rows = model.embedded(spark.createDataFrame([("a", "Good post"), ("b", "good POST!"), ("c", None)], "id string, text string"), 64).orderBy("id").collect()
    assert rows[0].vector == rows[1].vector and sum(x * x for x in rows[0].vector) == pytest.approx(1) and not any(rows[2].vector)


def test_search_of_many(spark):
    rows = [(i, [float(i % 3), float(i % 2), 1.0]) for i in range(40)] + [(40, None), (41, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    some = df.where("id % 10 = 0")
    one, many = (sorted(map(tuple, search.vector_search_many(df, some, k=5, block=b).collect())) for b in (2, 100))
    assert one == many and len(one) == 20
    for q in (0, 10, 20, 30):
        want = [(r.id, r.score) for r in search.vector_search(df.where("vector is not null"), rows[q][1], 5).collect()]
        assert sorted(want) == sorted((i, s) for x, i, s in one if x == q)
    assert search.vector_search_many(df, some.limit(0)).count() == 0


def test_last_weeks_keeps_the_newest(spark):
    from forumlens.operators import views

    rows = [(t, f"2023-{m:02d}-01", m + t / 10) for t in (1, 2) for m in range(1, 13) if m != 5 or t == 1] + [(1, "2024-01-01", 13.1), (3, "2023-01-01", 1.3)]
    weeks = spark.createDataFrame(rows, "topic_id int, week_start string, v double").selectExpr("topic_id", "cast(week_start as date) week_start", "v")
    out = {r.topic_id: list(r)[1:] for r in views.last_weeks(weeks, "v").collect()}
    assert out == {1: [m + 0.1 for m in range(2, 14)], 2: [None if m in (5, 13) else m + 0.2 for m in range(2, 14)], 3: [None] * 12}


def test_search_goes_down_the_ladder(spark):
    docs = spark.createDataFrame([("p1", "Open model benchmark of today"), ("p2", "Coffee and an open door"), ("p3", None)], "id string, text string")
    vectors = spark.createDataFrame([("p1", [1.0, 0.0]), ("p2", [0.0, 1.0]), ("other", [0.0, 1.0])], "id string, vector array<double>")
    at = lambda found: [(r.id, r.algorithm, r.state) for r in found.collect()]
    assert at(search.semantic_search(docs, "coffee", vectors=vectors, encode=lambda q: [0.0, 1.0])) == [("p2", "vector_cosine", "ready"), ("p1", "vector_cosine", "ready")]
    assert at(search.semantic_search(docs, "open model")) == [("p1", "lexical_overlap_fallback", "missing_config"), ("p2", "lexical_overlap_fallback", "missing_config")]
    assert at(search.semantic_search(docs, "open model", vectors=vectors.where("id = 'other'"), encode=lambda q: [0.0, 1.0]))[0][1] == "lexical_overlap_fallback"

    def broken(_):
        raise OSError("no encoder")

    assert at(search.semantic_search(docs, "OPEN DOOR", vectors=vectors, encode=broken)) == [("p2", "like_fallback", "error")]
    assert at(search.semantic_search(docs, "  ")) == []


def test_upserts_take_null_keys_as_equal(spark):
    from forumlens.operators import upkeep

    old, new = (spark.createDataFrame([(None, "g", v), ("k", "g", v)], "a string, b string, v int") for v in (1, 2))
    assert sorted(r.v for r in upkeep.upserted(old, new, ["a", "b"]).collect()) == [2, 2]


def test_first_of_copies_passes_null_ids_over(spark):
    from forumlens.operators import upkeep

    df = spark.createDataFrame([("p", None, "c2"), ("p", None, None), ("p", None, "c1"), ("q", "x", None)], "post_id string, author string, id string")
    assert {tuple(r) for r in upkeep.first_of_copies(df, ["post_id", "author"], "id").collect()} == {("p", None, "c1", 3), ("q", "x", None, 1)}
