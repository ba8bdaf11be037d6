import collections
import random
import re

import numpy as np

from forumlens.operators import word_vectors as W


def corpus(seed=1, n=120):
    """Texts of two subjects whose words never meet, and some words of both."""
    r = random.Random(seed)
    subject = [[f"{s}{i}" for i in range(25)] for s in "xy"]
    both = [f"b{i}" for i in range(8)]
    return [(i, " ".join(r.choice(subject[i % 2] if r.random() < 0.8 else both) for _ in range(40))) for i in range(n)]


def plain(docs, least, window, shift):
    """The matrix of shifted positive mutual information, from lists."""
    split = [re.findall(r"[\w']+", (t or "").lower()) for _, t in docs]
    n_docs = collections.Counter(w for s in split for w in set(s))
    words = sorted(w for w, n in n_docs.items() if n >= least)
    at = {w: i for i, w in enumerate(words)}
    m = np.zeros((len(words), len(words)))
    for s in split:
        for i in range(len(s)):
            for j in range(i + 1, min(i + window, len(s) - 1) + 1):
                if s[i] in at and s[j] in at:
                    m[at[s[i]], at[s[j]]] += 1
                    if s[i] != s[j]:
                        m[at[s[j]], at[s[i]]] += 1
    each = m.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        v = np.log(m * each.sum() / np.outer(each, each)) - np.log(shift)
    return words, np.where((m > 0) & (v > 0), v, 0.0)


def test_entries_equal_a_plain_count(spark):
    docs = [*corpus(n=20), (90, None), (91, ""), (92, "one one one"), (93, "b1 b1 b2")]
    df = spark.createDataFrame(docs, "id long, text string").repartition(3)
    vocab = W.vocabulary(df, 2)
    name = {r.w: r.word for r in vocab.collect()}
    words, m = plain(docs, 2, 4, 1.5)
    assert sorted(name.values()) == words
    got = {(name[r.a], name[r.b]): r.v for r in W.information(W.cooccurrences(df, vocab), 1.5).collect()}
    want = {(words[i], words[j]): m[i, j] for i, j in zip(*np.nonzero(m))}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_vectors_are_those_of_the_leading_singular_values(spark):
    docs = corpus()
    words, m = plain(docs, 3, 4, 1.0)
    value, vector = np.linalg.eigh(m)
    top = np.argsort(-np.abs(value))[:4]
    want = vector[:, top] * np.abs(value[top]) @ vector[:, top].T
    found = W.learned(spark.createDataFrame(docs, "id long, text string"), width=4, extra=16, rounds=6)
    got = {r.word: r.vector for r in found.table.collect()}
    y = np.array([got[w] for w in words])
    assert np.abs(y @ y.T - want).max() < 0.02 * np.abs(want).max()


def test_texts_of_one_subject_are_near_and_odd_texts_are_zero(spark):
    docs = corpus()
    df = spark.createDataFrame([*docs, (500, None), (501, "unseen words only")], "id long, text string")
    found = W.learned(df, width=6, rounds=2)
    got = {r.id: np.array(r.vector) for r in found.of_texts(df).collect()}
    assert not got[500].any() and not got[501].any() and len(got) == len(docs) + 2
    u = np.array([got[i] for i, _ in docs])
    assert np.allclose(np.linalg.norm(u, axis=1), 1)
    s = u @ u.T
    own = np.array([i % 2 for i, _ in docs])
    same = own[:, None] == own[None]
    assert s[same].mean() > s[~same].mean() + 0.3


def test_small_chunks_and_blocks_give_the_same_vectors(spark, monkeypatch):
    """Frequent words by rank and rare ones by hash, pairs summed over many pieces, rows in several blocks of rows and of columns."""
    docs = [*corpus(n=60), (90, None), (91, ""), (92, "one one one"), (None, "x1 x2"), (-7, "x1 y2 x1")]
    df = spark.createDataFrame(docs, "id long, text string").repartition(3)
    found = W.learned(df, width=4, extra=16, rounds=6)
    want = {r.word: r.vector for r in found.table.collect()}, {r.id: r.vector for r in found.of_texts(df).collect()}
    for name, value in {"COMMON": 20, "CHUNK": 100, "MERGED": 500, "BLOCKS": 3, "TALL": 15, "WIDE": 11, "HELD": 16}.items():
        monkeypatch.setattr(W, name, value)
    found = W.learned(df, width=4, extra=16, rounds=6)
    assert len(found.codes.hashes) <= 20 and 0 < len(found.codes.hashes) < found.table.count()
    got = {r.word: r.vector for r in found.table.collect()}, {r.id: r.vector for r in found.of_texts(df).collect()}
    for one, other in zip(want, got):
        assert one.keys() == other.keys() and len(one) > 50
        a, b = (np.array([x[k] for k in one]) for x in (want[got.index(other)], other))
        assert np.abs(a @ a.T - b @ b.T).max() < 1e-3 * np.abs(a @ a.T).max()


def test_no_word_is_frequent_enough(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "id long, text string")
    found = W.learned(df, width=2)
    assert found.table.collect() == [] and {(r.id, *r.vector) for r in found.of_texts(df).collect()} == {(1, 0.0, 0.0), (2, 0.0, 0.0)}


def shuffled(spark) -> int:
    """Bytes that all stages so far have shuffled."""
    gateway = spark.sparkContext._gateway
    none = gateway.jvm.java.util.ArrayList()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_products_shuffle_rows_by_block_and_not_by_entry(spark):
    r = random.Random(3)
    docs = [(i, " ".join(f"w{r.randrange(1500)}" for _ in range(300))) for i in range(400)]
    before = shuffled(spark)
    found = W.learned(spark.createDataFrame(docs, "id long, text string"))
    assert found.table.count() == 1500
    assert shuffled(spark) - before < 40e6


def test_tasks_share_a_block_of_rows(spark, monkeypatch):
    """A block of rows was one task, whatever the number of its entries."""
    r = np.random.default_rng(2)
    v, at = r.normal(size=(40, 3)).astype(np.float32), [(a, b) for a in range(5000) for b in range(a % 3, 40, 3)]
    rows = spark.createDataFrame([(b, 1.0, [float(x) for x in v[b]]) for b in range(40)], "w long, weight double, y array<float>")
    own = spark.range(5000).selectExpr("id as w", "2d as weight")
    a, b = map(np.array, zip(*at))
    pieces = spark.createDataFrame([(0, j, int((b % 4 == j).sum()), W.packed(a[b % 4 == j], b[b % 4 == j], np.ones((b % 4 == j).sum(), np.int64))) for j in range(4)], W.PIECES)
    got = W._times(W.Grid(pieces, 1, 4), own, rows, 3, lambda n, x, y: n * x * y)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression [i#") == 2
    want = np.zeros((5000, 3))
    np.add.at(want, a, 2 * v[b])
    found = {x.w: (x.weight, x.y) for x in got.collect()}
    assert len(found) == 5000 and all(found[i][0] == 2.0 and np.allclose(found[i][1], want[i], atol=1e-4) for i in range(5000))
