import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from forumlens.plans import jobs
from forumlens.plans.artifacts import ArtifactLog, activity, claimable, freshness
from forumlens.plans.stages import Pipeline
from forumlens.schemas import TABLES, schema
from forumlens.sources import ingest, readers, sinks
from forumlens.streaming import incremental

T = dt.datetime(2026, 5, 1, 12)


@pytest.fixture
def store(spark, tmp_path):
    return readers.Store(spark, f"file://{tmp_path}/store")


def posts(spark, rows):
    full = [(i, t, c, 1, T, g, a, 0, "", 2, "post", T) for i, t, c, g, a in rows]
    return spark.createDataFrame(full, schema("posts"))


LONG = "this is a good and great text about graphics cards with enough words in it"


def filled(spark, store):
    store.create(*TABLES)
    sinks.upsert(store, "posts", posts(spark, [("p1", "Good post", LONG, "g", "real_user"), ("p2", "Short", "Too short.", "g", "real_user"), ("p3", "T", LONG, "g", "AutoModerator"), ("p4", "Bad post", LONG.replace("good", "bad").replace("great", "awful"), "g", "user2"), ("p5", "T", LONG, "g", "[deleted]")]))


def test_states(spark, store):
    assert store.state("posts")["state"] == "missing_schema"
    store.create("posts")
    assert store.state("posts")["state"] == "unpopulated"
    sinks.upsert(store, "posts", posts(spark, [("a", "t", "c", "g", "u")]))
    assert store.state("posts")["state"] == "ready" and store.read("comments").count() == 0


def test_upsert_and_counts(spark, store):
    assert sinks.upsert(store, "posts", posts(spark, [("a", "t", "c", "g", "u"), ("b", "t", "c", "g", "u")])) == 2
    assert sinks.upsert(store, "posts", posts(spark, [("a", "new", "c", "g", "u")])) == 1
    assert {r.id: r.title for r in store.read("posts").collect()} == {"a": "new", "b": "t"}
    sinks.insert_ignore(store, "posts", posts(spark, [("a", "x", "c", "g", "u"), ("z", "x", "c", "g", "u")]))
    assert {r.id: r.title for r in store.read("posts").collect()} == {"a": "new", "b": "t", "z": "x"}


def test_batches_are_all_or_nothing(spark, store):
    comment = spark.createDataFrame([("c1", "p", "x", 25, T, "g", "u", 0, "a", "comment", T)], schema("comments"))
    meta = spark.createDataFrame([("g", T, 1, 1, 0.5, "completed", T, T)], schema("batch_collections"))
    assert sinks.store_batch(store, posts(spark, [("a", "t", "c", "g", "u")]), comment, meta) == {"posts": 1, "comments": 1, "batch_collections": 1}
    broken = comment.withColumn("content", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(sinks.BatchError):
        sinks.store_batch(store, posts(spark, [("b", "t", "c", "g", "u")]), broken, meta)
    assert [r.id for r in store.read("posts").collect()] == ["a"]


def test_collect_isolates_and_resumes(spark, store):
    store.create("posts", "comments", "batch_collections")
    none = spark.createDataFrame([], schema("comments"))

    def pull(group):
        if group == "bad":
            raise ingest.Refused("no")
        return posts(spark, [(group, "t", "c", group, "u")]), none

    report = ingest.collect(spark, store, ["a", "bad", "b", "a"], pull, T)
    assert (report.completed, list(report.failed), report.posts, report.success_rate) == (["a", "b"], ["bad"], 2, 66.67)
    again = ingest.collect(spark, store, ["a", "bad", "c"], pull, T + dt.timedelta(hours=3))
    assert again.skipped == ["a"] and again.completed == ["c"]


def test_limiter():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    limiter = ingest.Limiter(requests=2, window=10, failures=3, retries=5, clock=lambda: now[0], sleep=sleep)
    assert [limiter.call(lambda: k) for k in range(3)] == [0, 1, 2] and slept == [10.0] and limiter.waits == 1
    limiter = ingest.Limiter(failures=3, clock=lambda: now[0], sleep=sleep)
    slept.clear()

    def fail():
        raise OSError("x")

    with pytest.raises(ingest.Refused):
        limiter.call(fail)
    assert slept == [1.0, 2.0] and limiter.state == "open"
    with pytest.raises(ingest.Refused):
        limiter.call(lambda: 1)
    now[0] += 61
    assert limiter.call(lambda: 7) == 7 and limiter.state == "closed"


def test_delay_progress_frames():
    d = ingest.Delay()
    assert [d.after_error() for _ in range(9)][-1] == 300.0 and d.after_success() == 270.0 and ingest.Delay().between_chunks() == 5.0
    p = ingest.Progress(1, 4, 60)
    assert p.percentage == 25.0 and p.eta_minutes == 3.0 and ingest.Progress(0, 0, 0).eta_minutes is None
    frame = ingest.TimeFrame.parse("2026-01-01", "2026-01-11")
    assert [c.days for c in frame.chunks(4)] == [4, 4, 2] and frame.days == 10
    assert ingest.TimeFrame.last_days(3, T).end == T
    for bad in (("2026-01-02", "2026-01-01"), ("x", "y")):
        with pytest.raises(ValueError):
            ingest.TimeFrame.parse(*bad)


def test_fresh(spark):
    pulled, known = posts(spark, [("a", "GPU", "x", "g", "u"), ("b", "cat", "gpu", "g", "u"), ("c", "cat", "dog", "g", "u")]), posts(spark, [("a", "t", "c", "g", "u")])
    assert [r.id for r in ingest.fresh(pulled, known, ["gpu"]).collect()] == ["b"]
    assert ingest.fresh(pulled, known, frame=ingest.TimeFrame(T, T + dt.timedelta(1)), limit=1).count() == 1


def test_readers(spark, tmp_path):
    spark.createDataFrame([("a", 'multi\nline "q"')], "id string, label string").coalesce(1).write.csv(f"{tmp_path}/x", header=True, escape='"')
    assert readers.read_csv(spark, f"{tmp_path}/x", "id string, label string", ("label",)).first().label == 'multi\nline "q"'
    with pytest.raises(ValueError, match="score"):
        readers.read_csv(spark, f"{tmp_path}/x", "id string, label string", ("score",))
    raw = spark.createDataFrame([("a", 0.0, None, "[deleted]"), ("b", 86400.0, "u", None)], "id string, created_utc double, author string, body string")
    got = readers.extracted_comments(raw).collect()
    assert [(r.id, r.content, r.author, r.timestamp) for r in got] == [("b", "", "u", dt.datetime(1970, 1, 2))]
    assert readers.extracted_posts(raw).first().author == "[deleted]"
    assert readers.sql(spark, "select id from v where id = :x", {"v": raw}, x="a").count() == 1
    s = readers.Settings.from_env({"FORUMLENS_GROUPS": "a, b,,", "FORUMLENS_REQUESTS": "5"})
    assert s.groups == ["a", "b"] and s.requests == 5 and s.keywords == []
    source = readers.pull_source("pulls", "id string, score int", lambda group, listing, limit: ({"id": f"{group}{k}", "score": k} for k in range(99)))
    spark.dataSource.register(source)
    assert spark.read.format("pulls").options(groups="x,y", limit="3").load().count() == 6


def test_copy_export_cleanup_move(spark, store, tmp_path):
    filled(spark, store)
    target = readers.Store(spark, f"file://{tmp_path}/copy")
    counts = sinks.copy_all(store, target)
    assert counts["posts"] == (5, 5) and all(a == b for a, b in counts.values())
    assert sinks.export_store(store, f"{tmp_path}/out")["posts"] == 5 and spark.read.json(f"{tmp_path}/out/posts").count() == 5
    assert sinks.cleanup(target, T - dt.timedelta(days=1)) == 0 and sinks.cleanup(target, T + dt.timedelta(days=1)) == 5
    assert sinks.move_groups(store, "posts", ["other"], f"{tmp_path}/moved") == 5 and store.read("posts").count() == 0
    sinks.log_metrics(store, "r1", "prep", {"n": 1}, T)
    sinks.log_metrics(store, "r2", "prep", {"n": 2}, T + dt.timedelta(1))
    assert [r.value for r in sinks.latest_run(store, "prep").collect()] == [2.0]


def test_pipeline_end_to_end_and_again(spark, store):
    filled(spark, store)
    run = Pipeline(store, T, topics=2)
    assert run.preprocess() == {"record_count": 5, "kept_count": 2, "filtered_count": 3}
    done = {r.id: r for r in store.read("preprocessed").collect()}
    assert {i: r.filter_reason for i, r in done.items()} == {"p1": None, "p2": "too_short", "p3": "bot", "p4": None, "p5": "bot"}
    assert {i for i, r in done.items() if r.embedding_key} == {"p1", "p4"}
    assert Pipeline(store, T + dt.timedelta(1)).preprocess()["record_count"] == 0 and store.read("preprocessed").count() == 5
    assert run.score() == {"scored": 2} and run.score() == {"scored": 0}
    assert {r.id: r.label for r in store.read("sentiment_predictions").collect()} == {"p1": "positive", "p4": "negative"}
    sinks.upsert(store, "embeddings", spark.createDataFrame([("p1", [1.0, 0.0]), ("p4", [0.0, 1.0])], schema("embeddings")), keep=())
    lines = list(run.run([6, 7, 8, 9]))
    assert not any("failed" in x for x in lines), lines
    assert store.read("topic_assignments").count() == 2 and store.read("sentiment_daily").count() == 1
    assert run.status()[0] == {"step": "preprocess", "state": "done"}
    assert [x["state"] for x in Pipeline(readers.Store(spark, store.root + "x"), T).status()] == ["idle"] + ["locked"] * 5


def test_artifact_life_cycle(spark, tmp_path):
    now = [T]
    log = ArtifactLog(spark, f"file://{tmp_path}/log", lambda: now[0])
    a = log.enqueue("brief", "h", {"x": 1}, max_attempts=2)
    assert log.enqueue("brief", "h", {"x": 1})["artifact_id"] == a["artifact_id"] and a["status"] == "queued"
    assert log.claim("w1")["status"] == "running" and log.claim("w2") is None
    now[0] += dt.timedelta(seconds=1)
    assert log.fail(a["artifact_id"], "timeout", "x" * 2000)["status"] == "queued"
    assert log.claim("w2")["attempts"] == 2
    assert log.fail(a["artifact_id"], "timeout")["status"] == "failed"
    b = log.enqueue("brief", "h2", {})
    log.claim("w1")
    now[0] += dt.timedelta(seconds=601)
    assert log.claim("w2")["artifact_id"] == b["artifact_id"], "an expired lease can be claimed"
    assert log.complete(b["artifact_id"], {"y": 1})["checksum"]
    f = freshness(log.state(), now[0]).first()
    assert (f.failed, f.succeeded, f.state) == (1, 1, "ready")
    assert freshness(log.state(), now[0] + dt.timedelta(days=8)).first().state == "stale"
    assert claimable(log.state(), now[0]).count() == 0 and activity(log.state()).count() == 2
    assert [r.to_status for r in log.history().where(F.col("artifact_id") == a["artifact_id"]).orderBy("seq").collect()] == ["queued", "running", "queued", "running", "failed"]


def test_events_brief_enrichment(spark, tmp_path):
    log = ArtifactLog(spark, f"file://{tmp_path}/log", lambda: T)
    ddl = "subreddit string, date date, magnitude double"
    changes = spark.createDataFrame([("g", T.date(), 0.75), ("h", T.date(), -0.8), ("i", T.date(), None)], ddl)
    p = posts(spark, [("a", "t", "c", "g", "u"), ("b", "t", "c", "g", "u")])
    assigned = spark.createDataFrame([(1, "g", T)], "topic_id int, subreddit string, timestamp timestamp")
    found = spark.createDataFrame([(1, ["x", "y"])], "topic_id int, keywords array<string>")
    events = jobs.narrative_events(changes, p, assigned, found).orderBy("auto_label").collect()
    assert [(e.auto_label, e.top_terms, e.top_post_ids) for e in events] == [("Negative sentiment shift in r/h", ["h", "sentiment", "change"], []), ("Positive sentiment shift in r/g", ["x", "y"], ["a", "b"])]
    df = jobs.narrative_events(changes.where("subreddit = 'g'"), p, assigned, found)
    assert jobs.backfill_events(log, df) == 1 and jobs.backfill_events(log, df) == 0
    assert jobs.backfill_events(log, jobs.narrative_events(changes, p, assigned, found)) == 1
    sets = log.state().where("kind = 'narrative_events'").orderBy("seq").collect()
    assert len(sets) == 2 and json.loads(sets[-1].payload)["event_count"] == 2
    assert jobs.brief(log, 2, 1, 0)["status"] == "succeeded" and jobs.brief(log, 2, 1, 0)["attempts"] == 0
    assert len(jobs.enriched(log, "topic_label", [(1, jobs.Prompts().topic(["a"])), (2, "p")])) == 2 and jobs.enriched(log, "topic_label", [(1, "p")]) == {}

    def broken(_):
        raise TimeoutError("slow")

    jobs.enriched(log, "thread", [(9, "p")], broken)
    assert log.state().where("kind = 'thread'").first().error_category == "timeout"
    base = spark.createDataFrame([(1, None, "old"), (2, "keep", "keep")], "event_id long, llm_label string, llm_summary string")
    arts = spark.createDataFrame([("succeeded", '{"event_id": 1, "headline": "H", "body": "B"}', T)], "status string, payload string, updated_at timestamp")
    assert sorted(map(tuple, jobs.overlaid(base, arts).collect())) == [(1, "H", "B"), (2, "keep", "keep")]
    assert jobs.preferred(["x", "y"], ["y", "z"]) == "y" and jobs.preferred(["x"], []) is None
    labels = jobs.cluster_labels(found.withColumn("doc_count", F.lit(3))).first()
    assert labels.label == "Unlabeled cluster" and labels.doc_count == 3


def test_streams(spark, store, tmp_path):
    ddl = "id string, title string, subreddit string"
    spark.createDataFrame([("a", "t", "g"), ("b", "t", "g")], ddl).write.json(f"{tmp_path}/in/1")
    stream = lambda: incremental.landed(store, f"{tmp_path}/in/*", ddl)
    incremental.drained(stream(), store, "posts", f"{tmp_path}/cp")
    spark.createDataFrame([("b", "new", "g")], ddl).write.json(f"{tmp_path}/in/2")
    incremental.drained(stream(), store, "posts", f"{tmp_path}/cp")
    assert {r.id: r.title for r in store.read("posts").collect()} == {"a": "t", "b": "new"}
    events = [(T, 1, "x", 1.0), (T + dt.timedelta(minutes=1), 1, "x", 2.0), (T + dt.timedelta(hours=3), 1, "x", 5.0)]
    df = spark.createDataFrame(events, "ts timestamp, user_id long, event_type string, value double")
    df.write.parquet(f"{tmp_path}/ev")
    live = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/ev")
    for name, out, want in (("win", incremental.windowed(live), 2), ("ses", incremental.sessions(live), 2)):
        q = out.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.table(name).count() in (want, want - 1)
    assert incremental.windowed(df).orderBy("start").first().total == 3.0


def test_comment_trees(spark):
    tree = json.dumps([{"id": "a", "replies": [{"id": "a1", "replies": [{"id": "a11"}]}, {"id": "a2"}]}, {"id": "b"}])
    df = spark.createDataFrame([("p", tree), ("q", "[]"), ("r", None)], "post_id string, tree string")
    got = readers.flattened_comments(df).orderBy("place").collect()
    assert [json.loads(r.comment)["id"] for r in got] == ["a", "b", "a1", "a2", "a11"]
    assert readers.flattened_comments(df, limit=2).count() == 2


def test_remembered():
    from forumlens.session import remembered

    now, made = [0.0], []

    @remembered(30, most=2, clock=lambda: now[0])
    def f(x):
        made.append(x)
        return [x]

    f(1).append(9)
    assert f(1) == [1] and made == [1]
    now[0] = 31
    assert f(1) == [1] and made == [1, 1]
    f(2), f(3), f(1)
    assert made == [1, 1, 2, 3, 1]


def test_keyword_pairs(spark):
    from forumlens.functions import text

    df = spark.createDataFrame([('[["ai", 0.5], ["gpu", 0.1]]',), ('["ai", "gpu"]',), ("ai, gpu",)], "k string")
    assert [r[0] for r in df.select(text.keyword_words(F.col("k"))).collect()] == [["ai", "gpu"]] * 3


def test_a_reader_never_finds_a_table_gone(spark, store):
    sinks.upsert(store, "posts", posts(spark, [("a", "one", "c", "g", "u")]))
    before = store.read("posts")
    sinks.upsert(store, "posts", posts(spark, [("a", "two", "c", "g", "u")]))
    assert [r.title for r in before.collect()] == ["one"], "a reader that began keeps its version"
    for k in range(3):
        sinks.upsert(store, "posts", posts(spark, [(f"x{k}", "t", "c", "g", "u")]))
    assert len(store.versions("posts")) == 2 and store.read("posts").count() == 4
    spark.createDataFrame([], schema("posts")).write.parquet(f"{store.path('posts')}/_batch-broken")
    assert store.read("posts").count() == 4, "what is not a version is not the table"


def test_log_in_batches(spark, tmp_path):
    log = ArtifactLog(spark, f"file://{tmp_path}/log", lambda: T)
    rows = [log.queued("k", f"h{i}", {"i": i}) for i in range(5)]
    log.record([(r, None, "enqueued") for r in rows] + [(log.succeeded(rows[0], {"done": 1}), "queued", "completed")])
    assert sum(1 for p in (tmp_path / "log").iterdir() if p.name.startswith("part-")) == 1
    assert log.known("k", ["h0", "h4", "h9"]) == {"h0", "h4"} and log.known("k", ["h0", "h4"], "succeeded") == {"h0"}
    before = sorted(map(str, log.history().collect()))
    log.compact()
    assert sorted(map(str, log.history().collect())) == before and log.state().where("status = 'queued'").count() == 4
    assert log.enqueue("k", "h9", {})["seq"] == 7
    calls = []
    sources = [(f"s{i}", f"prompt {i}") for i in range(7)]
    assert len(jobs.enriched(log, "text", sources, lambda p: calls.append(p) or p, batch=3)) == 7 and len(calls) == 7
    assert jobs.enriched(log, "text", sources, lambda p: calls.append(p) or p) == {} and len(calls) == 7


def test_gather_falls_back_to_row_numbers(spark):
    vectors = spark.createDataFrame([("a", 0, [1.0]), ("7", 1, [2.0]), ("c", 2, [3.0])], "id string, row int, vector array<double>")
    wanted = spark.createDataFrame([("a",), ("7",), ("2",), ("9",), ("zz",), (None,)], "id string")
    assert sorted((r.id, r.vector[0]) for r in readers.gathered(vectors, wanted).collect()) == [("7", 2.0), ("a", 1.0)]
    assert sorted((r.id, r.vector[0]) for r in readers.gathered(vectors, wanted, position="row").collect()) == [("2", 3.0), ("7", 2.0), ("a", 1.0)]


def test_replies_of_any_depth(spark):
    tree = []
    for k in range(90, -1, -1):
        tree = [{"id": f"c{k}", "replies": tree}]
    df = spark.createDataFrame([("p", json.dumps(tree))], "post_id string, tree string")
    assert readers.flattened_comments(df, depth=5).count() == 6
    assert readers.flattened_comments(df, depth=None, limit=70).count() == 70


def test_scope_and_schedule(capsys):
    frame = ingest.TimeFrame.parse("2026-01-01", "2026-01-31")
    scope = ingest.Scope.of(frame, 3, 100, 7)
    assert (scope.chunks, scope.requests, scope.minutes) == (5, 165.0, 5.5)
    for bad in ((0, 1, 1), (1, -1, 1), (1, 1, 0)):
        with pytest.raises(ValueError):
            ingest.Scope.of(frame, *bad)
    at = lambda day, hour: dt.datetime(2026, 3, day, hour)
    plan = ingest.Schedule(at(1, 0))
    assert plan.planned(at(1, 0)) is None and plan.planned(at(1, 2)) == (at(1, 1), False) and plan.planned(at(2, 9)) == (at(1, 13), True) and plan.planned(at(3, 0)) == (at(1, 13), True)
    assert not plan.due(at(1, 0)) and plan.due(at(1, 1)) and not plan.due(at(1, 2), last_start=at(1, 1)) and not plan.due(at(1, 2), running=True)
    assert plan.due(at(1, 13), last_start=at(1, 1)) and not plan.due(at(1, 13), last_success=at(1, 2), last_start=at(1, 1))
    assert not plan.due(at(3, 1), last_success=at(2, 9), last_start=at(1, 13)) and plan.due(at(3, 1), last_success=at(1, 2), last_start=at(1, 13))
    from forumlens.__main__ import main

    assert main(["scope", "--root", "x", "--start", "2026-01-01", "--end", "2026-01-31", "--groups", "a,b,c"]) == 0
    assert "5 chunks, about 165 requests, about 5.5 minutes" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["scope", "--root", "x", "--start", "2026-02-01", "--end", "2026-01-31", "--groups", "a"])


def test_checks(spark, store):
    def refuse(group):
        raise ingest.Refused("no")

    found = ingest.checks(spark, store, refuse, "g")
    assert found == {"session": "ok", "store": "ok", "source": "Refused: no"}
