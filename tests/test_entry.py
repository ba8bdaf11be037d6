import math

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def ordered(rows):
    return sorted((tuple(map(cell, r)) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def database(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def test_entry_has_rows(spark):
    assert not entry.entry(spark).isEmpty()


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_its_sql(spark, sf, database, name):
    df = entry.queries()[name](spark, sf)
    found = database.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    got, want = ordered(df.select(*sorted(names)).collect()), ordered([[r[names.index(c)] for c in sorted(names)] for r in found.fetchall()])
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or isinstance(x, float) and isinstance(y, (float, int)) and math.isclose(x, y, abs_tol=2e-6) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n not in entry.oracle_sql() and n != "pipeline" and not n.startswith("op")))
def test_others_run(spark, sf, name):
    """Their values are held against NumPy in test_bruteforce.py."""
    assert entry.queries()[name](spark, sf).count()


def test_heatmap_of_30_topics_has_all_of_the_table(spark, sf):
    topics = {r.topic_id for r in entry.queries()["topics_ranked"](spark, sf).collect()}
    assert len(topics) > 5 and {r.topic_id for r in entry.queries()["topic_heatmap_top30"](spark, sf).collect()} == topics
