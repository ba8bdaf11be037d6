import numpy as np
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from forumlens.operators import vector_index as V


def plain(rows, queries, k, digits=4):
    """Full scan: rounded cosine, floored at 0, ties by the lesser id."""
    out = set()
    single = lambda x: np.array(x, np.float32).astype(float)  # noqa: E731 (as the table holds them)
    v = V.unit(single([x for _, x in rows]))
    for q, x in queries:
        score = np.round(np.maximum(v @ V.unit(single([x]))[0], 0), digits)
        order = sorted(range(len(rows)), key=lambda i: (-score[i], rows[i][0]))[:k]
        out |= {(q, rows[i][0], round(float(score[i]), 4)) for i in order}
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], "id long, vector array<float>").repartition(4)


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(5)
    heart = r.normal(size=(12, 16))
    out = [(i, np.round(heart[i % 12] + 0.4 * r.normal(size=16), 2)) for i in range(900)]
    out += [(900 + i, out[3][1]) for i in range(300)]  # a quarter of all rows is one vector
    return out


def same(df, rows, queries, k):
    got = {(r.query_id, r.id, round(r.score, 4)) for r in df.collect()}
    want = plain(rows, queries, k)
    assert {x[:2] for x in got} == {x[:2] for x in want} and got == want


@pytest.mark.parametrize("block", [4096, 100])
def test_exact_search_equals_a_full_scan(spark, rows, monkeypatch, block):
    monkeypatch.setattr(V, "BLOCK", block)
    queries = [(i, v) for i, v in rows if i % 37 == 0] + [(5000, -rows[0][1]), (5001, np.zeros(16))]
    odd = [(7000, None), (7001, [float("nan")] * 16), (7002, []), (None, rows[0][1]), (7003, np.zeros(16))]
    index = V.VectorIndex.build(table(spark, rows + odd), cells=8)
    same(index.search(table(spark, queries), 10, probes=2, exact=True), [*rows, (7003, np.zeros(16))], queries, 10)
    same(V.VectorIndex.load(spark, index.path).search(table(spark, queries), 500, probes=2, exact=True), [*rows, (7003, np.zeros(16))], queries, 500)


def test_few_cells_hold_most_of_the_nearest(spark, rows):
    index = V.VectorIndex.build(table(spark, rows), cells=8)
    queries = [(i, v) for i, v in rows if i % 50 == 0]
    got = {(r.query_id, r.id) for r in index.search(table(spark, queries), 10, probes=2).collect()}
    want = {x[:2] for x in plain(rows, queries, 10)}
    assert len(got & want) >= 0.9 * len(want)
    probed = index.probed(table(spark, queries).selectExpr("id as query_id", "cast(vector as array<double>) as vector"), 2)
    assert 0 < index.share_read(probed) < 0.8


def test_probes_are_calibrated_to_a_recall(spark, rows):
    index = V.VectorIndex.build(table(spark, rows), cells=8)
    sample, asked = table(spark, [x for x in rows if x[0] % 9 == 1]), [x for x in rows if x[0] % 9 == 2]
    few, all_ = (index.calibrated(sample, 10, target=t) for t in (0.9, 1.0))
    assert 1 <= few <= all_ <= 8 and few < 8
    got = {(r.query_id, r.id) for r in index.search(table(spark, asked), 10, probes=few).collect()}
    want = {x[:2] for x in plain(rows, asked, 10)}
    assert len(got & want) >= 0.85 * len(want)


def test_only_probed_lists_are_read(spark, rows):
    index = V.VectorIndex.build(table(spark, rows), cells=8)
    files = index.lists([1]).inputFiles()
    assert index.lists([1, 2]).count() == index.rows[1] + index.rows[2]
    assert files and "PartitionFilters: [isnotnull(cell" in index.lists([1])._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_no_vectors_and_no_queries(spark, rows):
    index = V.VectorIndex.build(table(spark, []), cells=8)
    assert index.search(table(spark, rows[:3]), 5, exact=True).collect() == []
    index = V.VectorIndex.build(table(spark, rows[:3]), cells=8)
    assert index.search(table(spark, []), 5).collect() == []
    same(index.search(table(spark, rows[:2]), 5, exact=True), rows[:3], rows[:2], 5)


def test_recall_of_the_registered_query(spark, sf):
    [row] = entry.queries()["vector_index_recall"](spark, sf).collect()
    t = pq.read_table(f"{sf}/embeddings.parquet")
    n = sum(1 for i in t.column("vec_id").to_pylist() if i % 100 == 0)
    assert row.n_queries == n and row.n_rows == 10 * n and row.recall >= 0.9 and 0 < row.share_read < 0.95 and 1 <= row.probes <= 16


def test_index_is_built_in_a_session_without_arrow(spark, rows):
    """A session's default before Spark's Arrow conversion is switched on; cells were refused as numpy.float64."""
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "false")
    try:
        index = V.VectorIndex.build(table(spark, rows), cells=8)
        again = V.VectorIndex.load(spark, index.path)
        assert np.array_equal(again.centres, index.centres) and np.array_equal(again.rows, index.rows) and np.array_equal(again.radius, index.radius)
        index.remove()
    finally:
        spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")


@pytest.mark.parametrize("block, most", [(4096, 1 << 15), (60, 100)])
def test_neighbours_of_all_rows_equal_a_full_scan(spark, rows, monkeypatch, block, most):
    for name, value in (("BLOCK", block), ("FEWEST", most), ("MOST", most), ("SCORES", 20_000)):
        monkeypatch.setattr(V, name, value)
    odd = [(7003, np.zeros(16)), (7004, -rows[0][1]), (7005, 2 * rows[1][1]), (7006, rows[1][1] + 1e-7)]
    all_ = [*rows, *odd]
    index = V.VectorIndex.build(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in all_], "id long, vector array<double>"), cells=8)
    got = {}
    for r in index.neighbours(12).collect():
        got.setdefault(r.query_id, set()).add((r.id, round(r.score, 9)))
    u = V.unit(np.array([v for _, v in all_]))
    score, ids = np.round(u @ u.T, 10), np.array([i for i, _ in all_])
    assert len(got) == len(all_)
    for x, i in enumerate(ids.tolist()):
        order = [y for y in np.lexsort((ids, -score[x])) if y != x][:12]
        assert got[i] == {(int(ids[y]), round(float(score[x, y]), 9)) for y in order}
    index.remove()
