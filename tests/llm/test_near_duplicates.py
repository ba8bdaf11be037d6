import collections
import random

import numpy as np
import pyarrow as pa
from llm_helpers import prose

from forumlens.llm import near_duplicates as N
from forumlens.llm.common import binary_column, shingles_of
from forumlens.llm.components import components


def shingles(text):
    w = (text or "").encode().split()
    if not w:
        return collections.Counter()
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)])


def similarity(a, b):
    x, y = shingles(a), shingles(b)
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def brute(rows, least=0.8):
    rows = [(i, t) for i, t in rows if i is not None]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, t) in enumerate(rows):
        for j, u in rows[:k]:
            if shingles(t) and shingles(u) and similarity(t, u) >= least:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in rows}


def edited(text, n, seed):
    r, w = random.Random(seed), text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
    return " ".join(w)


def test_classes_equal_brute_force(documents, awkward):
    base = [prose(s, 150) for s in range(30, 36)]
    rows = [(100 + 10 * b + k, edited(t, k % 4, 7 * b + k)) for b, t in enumerate(base) for k in range(8)] + awkward
    got = {r.doc_id: r.class_id for r in N.near_duplicates(documents(rows)).collect() if r.doc_id is not None}
    assert got == brute(rows)


def test_large_group_of_spread_copies(documents):
    """Many copies at similarities on both sides of the threshold: buckets that stay unsettled are compared in blocks."""
    base = prose(50, 160)
    rows = [(k, edited(base, random.Random(k).choice([1, 2, 4, 6, 9]), k)) for k in range(160)]
    small, N.BLOCK_TEXTS = N.BLOCK_TEXTS, 16
    try:
        got = {r.doc_id: r.class_id for r in N.near_duplicates(documents(rows)).collect()}
    finally:
        N.BLOCK_TEXTS = small
    assert got == brute(rows)


def test_a_template_that_very_many_texts_share(documents):
    """Texts alike at about 0.7: their buckets are large and unsettled, and all but a few pairs are below the threshold."""
    base = prose(51, 160)
    rows = [(k, edited(base, 11, k)) for k in range(120)] + [(200 + k, edited(edited(base, 11, k), 1, 900 + k)) for k in range(0, 120, 6)]
    was = N.BLOCK_TEXTS, N.RARE
    try:
        for N.BLOCK_TEXTS, N.RARE in ((16, 64), (16, 3)):
            got = {r.doc_id: r.class_id for r in N.near_duplicates(documents(rows)).collect()}
            assert got == brute(rows)
    finally:
        N.BLOCK_TEXTS, N.RARE = was


def test_rare_items_lose_no_pair(spark):
    base = prose(52, 140)
    rows = [(k, edited(base, random.Random(k).choice([1, 3, 5, 8, 11]), k)) for k in range(60)] + [(60 + k, prose(k, 40)) for k in range(20)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    was = N.RARE
    try:
        for N.RARE in (1000, 8):
            pairs, crowd = N._by_rare_items(texts.select(N.F.col("doc_id").alias("rep"), N.F.col("doc_id").alias("component")), texts, 5, 0.8, lambda df, name: df)
            pairs, crowd = {(r.a, r.b) for r in pairs.collect()}, {r.rep for r in crowd.collect()}
            for i, t in rows:
                for j, u in rows[:i]:
                    if similarity(t, u) >= 0.8:
                        assert (i, j) in pairs or {i, j} <= crowd
            assert len(pairs) < 60 * 59 / 2 and (N.RARE == 8 or not crowd)
    finally:
        N.RARE = was


def test_different_texts_of_one_id_in_a_large_bucket(documents):
    """An id that two texts share links the neighbours of both."""
    base, other = prose(53, 160), prose(54, 160)
    rows = [(k, edited(base, 9, k)) for k in range(60)] + [(100 + k, edited(other, 9, 500 + k)) for k in range(60)]
    rows += [(7, edited(other, 9, 500)), (300, edited(edited(other, 9, 500), 1, 3))]
    was = N.BLOCK_TEXTS
    try:
        N.BLOCK_TEXTS = 16
        got = {r.doc_id: r.class_id for r in N.near_duplicates(documents(rows)).collect()}
    finally:
        N.BLOCK_TEXTS = was
    assert got[7] == got[100] == got[300] and got[300] <= 7


def test_every_row_has_a_class_and_null_ids_none(documents, awkward):
    out = N.near_duplicates(documents(awkward)).collect()
    assert len(out) == len(awkward)
    assert all((r.class_id is None) == (r.doc_id is None) for r in out)
    got = {r.doc_id: r.class_id for r in out}
    assert got[1] == 1 and got[2] == 2 and got[3] == 3, "texts without words are classes of their own"
    assert got[6] == 5 and got[10] == 4


def test_empty_table(documents):
    assert N.near_duplicates(documents([])).collect() == []


def test_deduplicated_keeps_rows_whole(documents, awkward):
    docs = documents(awkward)
    out = N.deduplicated(docs)
    assert out.columns == docs.columns
    ids = sorted(r.doc_id for r in out.collect() if r.doc_id is not None)
    assert ids == [1, 2, 3, 4, 5, 7, 8, 9]
    assert out.where("doc_id is null").count() == 2


def test_deduplicated_keeps_different_texts_of_one_id_and_columns_of_any_name(spark):
    a, b, c = prose(1, 60), prose(2, 60), prose(3, 60)
    rows = [(5, a, "x", 1, 2), (5, a, "y", 1, 2), (5, b, "x", 1, 2), (8, a + " end", "z", 1, 2), (9, c, "z", 1, 2), (None, c, "n", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_id string, c0 int, k int")
    runs = [sorted(map(tuple, N.deduplicated(docs.repartition(n)).collect()), key=str) for n in (1, 3, 5)]
    assert runs[0] == runs[1] == runs[2] and N.deduplicated(docs).columns == docs.columns
    assert [r[:2] for r in runs[0]] == sorted([(5, a), (5, b), (9, c), (None, c)], key=str)


def test_registers_agree_as_often_as_the_multisets_overlap():
    a = "u v w x y " * 40 + prose(3, 100)
    b = "u v w x y " * 25 + prose(3, 80) + " " + prose(4, 30)
    sig = N.signatures(*N.counted(*shingles_of(*binary_column(pa.array([a, b])))), 2, 4000)
    assert abs((sig[0] == sig[1]).mean() - similarity(a, b)) < 0.03


def test_weights_count_beyond_powers_of_two():
    one = (np.zeros(1, np.int64), np.array([77], np.uint64))
    sig = [N.signatures(*one, np.array([c]), 1, 4000)[0] for c in (5, 6, 13)]
    assert abs((sig[0] == sig[1]).mean() - 5 / 6) < 0.03
    assert abs((sig[0] == sig[2]).mean() - 5 / 13) < 0.03


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, k) for k in range(1001, 1100)] + [(5, 5), (None, 3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {k: 1000 for k in range(1000, 1100)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
