import collections
from datetime import datetime

from forumlens.operators import filters, views
from forumlens.sources import readers, sinks
from forumlens.sources.scratch import Scratch

T = [datetime(2024, 1, d) for d in (1, 2, 2, 3, 3, 3, 9)]


def test_pages_by_token_are_the_whole_result(spark):
    rows = [(i, T[i % 7]) for i in range(50)] + [(99, None), (None, T[0])]
    df = spark.createDataFrame(rows, "id long, timestamp timestamp").repartition(3)
    for size in (1 + 6, 25, 50, 80):
        got, after, first = [], None, True
        while first or after is not None:
            page, first = filters.page_after(df, size, after), False
            got += [r.id for r in page.collect()]
            after = filters.token_of(page, size)
        assert got == [i for i, t in sorted(((i, t) for i, t in rows if t and i is not None), key=lambda r: (-r[1].timestamp(), r[0]))]


def test_the_token_reaches_the_scan(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    spark.createDataFrame([(i, T[i % 7]) for i in range(50)], "id long, timestamp timestamp").write.parquet(at)
    plan = filters.page_after(spark.read.parquet(at), 5, (T[3], 10))._jdf.queryExecution().toString()
    assert "LessThanOrEqual(timestamp" in plan


def test_last_prediction(spark):
    predictions = spark.createDataFrame([(1, T[0]), (2, T[3]), (3, T[6])], "id long, predicted_at timestamp")
    prepared = spark.createDataFrame([(1, "post"), (2, "comment"), (3, "post")], "id long, content_type string")
    sources = spark.createDataFrame([(1, "post", "g", T[0]), (2, "comment", "g", T[3]), (3, "comment", "g", T[6])], "id long, content_type string, subreddit string, timestamp timestamp")
    last = lambda *a: views.last_prediction(predictions, prepared, sources, *a).first()[0]
    assert last() == T[6] and last(("g",)) == T[3] and last((), "2024-01-01", "2024-01-01") == T[6]
    assert last(("g",), "2024-01-01", "2024-01-02") == T[0] and last(("other",)) is None


def test_upsert_rewrites_only_the_buckets_of_its_keys(spark, tmp_path):
    store = readers.Store(spark, f"file://{tmp_path}/store", buckets=32)
    columns = "id string, title string, content string, upvotes int, timestamp timestamp, subreddit string, author string"
    make = lambda ids, title: spark.createDataFrame([(f"k{i}", title, "c", 1, T[0], "g", "u") for i in ids], columns)
    assert sinks.upsert(store, "posts", make(range(600), "old")) == 600
    before = store.tables()["posts"]["parts"]
    assert sinks.upsert(store, "posts", make(range(0, 600, 100), "new")) == 6
    after = store.tables()["posts"]["parts"]
    changed = {b for b in after if after[b] != before[b]}
    assert len(before) == 32 and 1 <= len(changed) <= 6 and all(len(f) == 1 for f in after.values())
    assert store.read("posts").where("title = 'new'").count() == 6 and store.read("posts").count() == 600


def test_a_writer_that_comes_too_late_changes_nothing(spark, tmp_path):
    store = readers.Store(spark, f"file://{tmp_path}/store", buckets=2)
    base = store.tables()
    sinks.overwrite(store, "topics", spark.range(3).selectExpr("int(id) as topic_id", "1 as doc_count"))
    state = store.tables()["topics"]
    try:
        store.commit(base, {"topics": {"parts": {}, "loose": []}})
    except readers.Conflict:
        pass
    else:
        raise AssertionError("a commit over a newer one")
    assert store.tables()["topics"] == state and store.read("topics").count() == 3
    store.commit(base, {"posts": {"parts": {}, "loose": []}})
    assert store.exists("posts") and store.read("topics").count() == 3


def test_columns_for_the_groups_that_are_there(spark):
    rows = spark.createDataFrame([("a", "x", 1.0, 2.0), ("a", "y_z", 3.0, 4.0), ("b", "x", 5.0, None)], "date string, subreddit string, m double, r double")
    out = views.by_group(rows, "m", "r")
    assert sorted(out.columns) == ["date", "m x", "m y_z", "r x", "r y_z"]
    assert {r["date"]: (r["m x"], r["r y_z"]) for r in out.collect()} == {"a": (1.0, 4.0), "b": (5.0, None)}


def test_words_end_at_all_but_ascii_letters_digits_and_underscores(spark):
    texts = ["caf\u00e9tion abc", "si\u0301tion", "\u0130abc", "a_bcd abc_ 12abc abc\u0660", "abc\u00adtion", "x\u030ation", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.word: r.n for r in views.word_counts(df, ["the"]).collect()}
    assert got == {"tion": 4, "abc": 3, "caf": 1, "iabc": 1}


def test_all_pages_at_once_are_those_by_token(spark):
    rows = [(i, T[i % 7]) for i in range(50)] + [(99, None), (None, T[0])]
    df = spark.createDataFrame(rows, "id long, timestamp timestamp").repartition(3)
    scratch = Scratch(spark)
    got = collections.defaultdict(set)
    for r in filters.pages(df, 7, scratch).collect():
        got[r.page].add(r.id)
    after, k, first = None, 0, True
    while first or after is not None:
        page, first = filters.page_after(df, 7, after), False
        assert got.pop(k) == {r.id for r in page.collect()}
        after, k = filters.token_of(page, 7), k + 1
    assert not got


def test_rows_of_a_page_boundary_that_are_equal_are_all_kept(spark):
    df = spark.createDataFrame([(1, T[0])] * 5 + [(2, T[0])], "id long, timestamp timestamp")
    assert sorted(r.id for r in filters.pages(df, 2, Scratch(spark)).collect()) == [1] * 5 + [2]
