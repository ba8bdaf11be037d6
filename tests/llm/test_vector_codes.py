import math
import random
from hashlib import sha256

import numpy as np
import pytest

from forumlens.llm import vector_codes as V


def brute(rows, parts, entries, rounds, scale=256):
    """Plain loops over whole numbers: (vec_id, code, error, label) and all entries."""
    kept = [(i, [math.floor(scale * x) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = -(-len(kept[0][1]) // parts)
    kept = [(i, [(v + [0] * (parts * width - len(v)))[p * width : (p + 1) * width] for p in range(parts)], lab) for i, v, lab in kept]
    books = [[r[1][p] for r in kept[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(nearest(p, v[p])[1], []).append(v[p])
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])]
    out = []
    for i, v, lab in kept:
        best = [nearest(p, v[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), lab))
    return out, books


def check(spark, rows, parts=4, entries=16, rounds=2):
    out, books = brute(rows, parts, entries, rounds)
    total = {}
    for _, _, e, lab in out:
        total[lab] = total.get(lab, 0) + e
    digest = sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    table = spark.createDataFrame([(a, b, c, "s", 1) for a, b, c in rows], "vec_id long, embedding array<float>, label int, salt string, part int").repartition(3)
    got = V.compress_vectors(table, parts=parts, entries=entries, rounds=rounds)
    assert got.columns == ["vec_id", "code", "error", "label", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((*r, total[r[3]], digest) for r in out), key=str)


def vectors(seed, n, dims, step=1.0):
    r = random.Random(seed)
    return [(k, [round(r.gauss(0, 1) / step) * step * 0.5 for _ in range(dims)], r.choice([0, 1, 1, 1, None])) for k in range(n)]


def test_equals_brute_force(spark):
    check(spark, vectors(1, 400, 12, 0.01))


def test_ties_repeats_and_awkward_rows(spark):
    rows = vectors(2, 150, 8)  # few different values: most distances tie
    rows += [rows[3], (5, rows[7][1], 2), (None, rows[9][1], None), (900, None, 1), (901, [1.0] * 7 + [None], 1), (902, [float("nan")] * 8, 1), (903, [1.0] * 7 + [float("-inf")], 0), (904, [], 1), (905, [1.0] * 5, 1), (906, [-0.001] * 8, 3), (-7, [2.5] * 8, 4)]
    check(spark, rows, entries=32)


def test_fewer_rows_than_entries_and_uneven_parts(spark):
    check(spark, vectors(3, 9, 10, 0.1), parts=4, entries=16)
    check(spark, vectors(4, 1, 3, 0.1), parts=4, entries=16, rounds=0)


def test_one_hot_vector_and_no_rows(spark):
    rows = [(k, [0.25] * 8, 1) for k in range(300)] + [(300 + k, v, lab) for k, v, lab in vectors(5, 100, 8, 0.1)]
    check(spark, rows)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert V.compress_vectors(empty).collect() == []
    assert V.compress_vectors(spark.createDataFrame([(1, None, 1)], empty.schema)).collect() == []
    with pytest.raises(ValueError):
        V.train_codebooks(V.usable(empty), entries=257)


@pytest.mark.parametrize("spread", [1, 3, 1000, 1 << 26])
def test_the_tree_loses_nothing(spread):
    r = np.random.default_rng(spread)
    for width, n in ((1, 64), (4, 64), (4, 200), (3, 5), (2, 1)):
        entries, rows = r.integers(-spread, spread + 1, (n, width)), r.integers(-spread, spread + 1, (500, width))
        who, best = V.Tree(entries).nearest([np.ascontiguousarray(rows[:, i]) for i in range(width)])
        d = ((rows[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        assert (who == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def test_the_tree_leaves_entries_out(monkeypatch):
    r = np.random.default_rng(0)
    entries, rows = r.integers(-1000, 1000, (64, 2)), r.integers(-1000, 1000, (2000, 2))
    seen = []
    real = np.square
    monkeypatch.setattr(V.np, "square", lambda x: seen.append(len(x)) or real(x))
    V.Tree(entries).nearest([rows[:, 0].copy(), rows[:, 1].copy()])
    assert sum(seen) / 2 < 0.6 * 64 * 2000


def test_codes_decode_to_near_vectors(spark):
    rows = vectors(6, 200, 8, 0.01)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    books = V.train_codebooks(V.usable(table), parts=4, entries=64)
    coded = {r.vec_id: r for r in V.compress_vectors(table, parts=4, entries=64).collect()}
    assert len({r.codebooks_sha256 for r in coded.values()} | {books.digest()}) == 1
    for i, v, _ in rows[:40]:
        off = ((np.array(v) - books.decoded(coded[i].code)) ** 2).sum()
        assert abs(off - coded[i].error / 256**2) < 0.2
