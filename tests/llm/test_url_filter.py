import datetime as dt

from forumlens.llm.url_filter import intervals, url_filter

D = lambda n: dt.datetime(2024, 1, n)


def entries(spark, rows):
    return spark.createDataFrame(rows, "entry string, category string, action string, at timestamp")


def captures(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, fetched timestamp, host string, keys string").repartition(2)


def test_intervals(spark):
    rows = [("A.com ", "x", "add", D(2)), ("a.com", "x", "add", D(2)), ("a.com", "x", "remove", D(5)), ("a.com", "x", "add", D(9)), ("b.com", None, "remove", D(1)), ("c.com", "x", "add", D(3)), ("c.com", "x", "remove", D(3)), (None, "x", "add", D(1)), ("d.com", "x", "ban", D(1)), ("d.com", "x", "add", None)]
    got = sorted((r.entry, r.category, r.since, r.until) for r in intervals(entries(spark, rows)).collect())
    assert [g[:3] for g in got] == [("a.com", "x", D(2)), ("a.com", "x", D(9))]
    assert [g[3] for g in got] == [D(5), None]


def test_as_of_join(spark):
    lists = entries(spark, [("bad.org", "spam", "add", D(5)), ("bad.org", "spam", "remove", D(10)), ("x.bad.org", "ads", "add", D(1)), ("ok.org/private", "adult", "add", D(1))])
    rows = [
        (1, "http://bad.org/a", D(4)), (2, "http://bad.org/a", D(5)), (3, "https://u:p@X.bad.org:8080/z?q", D(6)), (4, "http://bad.org", D(10)), (5, "http://notbad.org/", D(6)),
        (6, "https://ok.org/private/1.html", D(6)), (7, "https://ok.org/privateer", D(6)), (8, None, D(6)), (9, "", D(6)), (10, "mailto:x@bad.org", D(6)), (11, "http://bad.org", None), (None, "http://bad.org.", D(6)), (2, "http://bad.org/a", D(5)),
    ]
    out = url_filter(captures(spark, rows), lists).collect()
    assert len(out) == len(rows)
    got = {(r.page_id, r.categories, r.n_entries) for r in out if r.blocked}
    assert got == {(2, "spam", 1), (3, "ads,spam", 2), (6, "adult", 1), (None, "spam", 1)}
    assert sum(r.page_id == 2 and r.blocked for r in out) == 2
    assert {r.host for r in out if r.page_id in (8, 9, 10)} == {None}


def test_empty_sides(spark):
    some = captures(spark, [(1, "http://bad.org", D(1))])
    assert [r.blocked for r in url_filter(some, entries(spark, [])).collect()] == [False]
    assert url_filter(captures(spark, []), entries(spark, [("a.b", "x", "add", D(1))])).collect() == []


def test_very_long_urls_and_a_hot_host(spark):
    """A URL of 20,000 steps, a host of 3,000 labels, and one entry that very many captures meet."""
    steps, labels = "/".join(f"s{i % 7}" for i in range(20_000)), ".".join(["a"] * 3_000)
    lists = entries(spark, [("bad.org", "spam", "add", D(1)), ("ok.org/s0/s1/s2", "ads", "add", D(1)), ("ok.org/s0/s1/s3", "ads", "add", D(1))])
    rows = [(1, f"http://ok.org/{steps}", D(2)), (2, f"http://{labels}.bad.org/", D(2)), (3, f"http://ok.org/{steps[3:]}", D(2))] + [(10 + i, "http://x.bad.org/p", D(2)) for i in range(500)]
    out = {r.page_id: (r.blocked, r.categories) for r in url_filter(captures(spark, rows), lists).collect()}
    assert out[1] == (True, "ads") and out[2] == (True, "spam") and out[3] == (False, "")
    assert all(out[10 + i] == (True, "spam") for i in range(500))


def test_equals_brute_force_on_random_lists(spark):
    import random

    r = random.Random(5)
    hosts = [f"{a}.{b}.org" for a in "xyz" for b in ("bad", "ok", "far")] + ["bad.org", "ok.org"]
    rows = sorted({(r.choice(hosts) + r.choice(["", "", "/a", "/a/b"]), r.choice("pq"), r.choice(["add", "add", "remove"]), D(r.randrange(1, 28))) for _ in range(80)})
    caps = [(i, f"http://{r.choice(hosts)}/{r.choice(['', 'a', 'a/b', 'a/b/c', 'ab'])}", D(r.randrange(1, 28))) for i in range(300)]
    out = {x.page_id: (x.n_entries, x.categories) for x in url_filter(captures(spark, caps), entries(spark, rows)).collect()}
    for i, url, at in caps:
        host, _, path = url[7:].partition("/")
        active = set()
        for entry, category in {(e, c) for e, c, _, _ in rows}:
            past = [(t, a == "remove") for e, c, a, t in rows if (e, c) == (entry, category) and t <= at]
            e_host, _, e_path = entry.partition("/")
            meets = f"{path}/".startswith(f"{e_path}/") and host == e_host if e_path else host == e_host or host.endswith(f".{e_host}")
            if meets and past and not max(past)[1]:
                active.add((entry, category))
        assert out[i] == (len(active), ",".join(sorted({c for _, c in active}))), url
