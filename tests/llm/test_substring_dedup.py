import random
import re
from collections import Counter

from llm_helpers import prose
from pyspark.sql import functions as F

from forumlens.llm import common as C
from forumlens.llm import substring_dedup as S


def brute(texts, length):
    """Per text: bytes kept, and runs removed."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1])), kept))
    return out


def brute_passages(texts, words, length):
    """Per text: flags of the bytes in a repeated run of words, or a repeated string of bytes."""
    raw = [(t or "").encode() for t in texts]
    split = [[m.span() for m in re.finditer(rb"[^ \t-\r]+", b)] for b in raw]
    runs = [[tuple(b[x:y] for x, y in s[i : i + words]) for i in range(len(s) - words + 1)] for b, s in zip(raw, split)]
    seen = Counter(x for r in runs for x in r)
    bytes_seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b, s, r in zip(raw, split, runs):
        gone = bytearray(len(b))
        for i, x in enumerate(r):
            if seen[x] > 1:
                gone[s[i][0] : s[i + words - 1][1]] = b"\1" * (s[i + words - 1][1] - s[i][0])
        for i in range(len(b) - length + 1):
            if bytes_seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append(gone)
    return out


def stretches(gone):
    return sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))


def check(documents, rows, **options):
    want = Counter((i, *x) for (i, _), x in zip(rows, brute([t for _, t in rows], options.get("length", 400))))
    for passages in (False, True):
        out = S.substring_dedup(documents(rows), passages=passages, **options).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out) == want
    flags = brute_passages([t for _, t in rows], S.PASSAGE["length"], options.get("length", 400))
    assert Counter((r.doc_id, r.n_passages, r.n_passage_bytes) for r in out) == Counter((i, stretches(g), sum(g)) for (i, _), g in zip(rows, flags))
    short = {"words": S.PASSAGE["length"], "word_gram": S.PASSAGE["gram"]}
    kept = Counter((r.doc_id, r.text) for r in S.without_repeats(documents(rows), **short, **options).collect())
    assert kept == Counter((i, bytes(c for c, g in zip((t or "").encode(), f) if not g).decode("utf-8", "ignore")) for (i, t), f in zip(rows, flags))


def test_equals_brute_force(documents, awkward):
    check(documents, [(i, (t or "")[:9000] if t else t) for i, t in awkward] + [(20, prose(9, 40) + " " + prose(1, 100)), (21, prose(2, 300))])


def test_shared_passages_of_many_lengths(documents):
    r = random.Random(4)
    passage = prose(77, 60)
    rows = []
    for k in range(60):
        cut = r.randrange(0, 60)
        rows.append((k, prose(100 + k, 12) + " " + passage[cut : cut + r.randrange(20, 260)] + prose(300 + k % 3, 10)))
    S_passage = dict(S.PASSAGE)
    try:
        S.PASSAGE.update(length=12, gram=4)
        for group_rows in (1024, 2):
            check(documents, rows, length=60, gram=20, group_rows=group_rows)
    finally:
        S.PASSAGE.update(S_passage)


def test_repeats_within_one_text(documents):
    check(documents, [(1, "ab" * 300 + prose(5, 30)), (2, "a" * 399), (3, "b" * 400), (4, "c" * 401)])


def test_windows_across_hash_blocks(documents, monkeypatch):
    monkeypatch.setattr(S, "STARTS", 64)
    import numpy as np

    data = np.frombuffer((prose(1, 200) + prose(1, 200)).encode(), np.uint8)
    doc, lo, hi, pos, _ = S.anchors(data, np.array([0, len(data)]), 60, 20)
    starts = sorted(s for a, b in zip(lo, hi) for s in range(a, b + 1))
    assert starts == list(range(len(data) - 59)), "every window has one anchor"
    assert all(a <= p <= b + 40 for a, b, p in zip(lo, hi, pos))


def test_suffix_sort_orders_and_measures():
    r = random.Random(1)
    strings = [bytes(r.choice(b"ab") for _ in range(r.randrange(0, 30))) for _ in range(80)]
    order, common = S.suffix_sort(strings)
    got = [strings[i] for i in order]
    assert got == sorted(strings)
    for a, b, c in zip(got, got[1:], common):
        assert a[:c] == b[:c] and (c == min(len(a), len(b)) or a[c] != b[c])


def test_a_hash_collision_is_caught():
    same = [0] * 5
    assert S.extension(b"abcd", same, b"abxd", same) == 2


def test_text_form_keeps_columns(documents, awkward):
    docs = documents(awkward)
    out = S.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(awkward)
    assert all(r.n_chars == len(r.text) for r in out.collect())
    assert S.substring_dedup(documents([])).collect() == []


def of_words(seed, n):
    """Exactly n words in lower case."""
    return " ".join(w for w in (x.strip(".").lower() for x in prose(seed, 3 * n).split()) if len(w) > 2).split(" ", n)[:n]


def test_passages_of_over_fifty_words(documents):
    long, short = " ".join(of_words(1, 51)), " ".join(of_words(2, 50))
    own = [prose(50 + i, 30) + "\n" for i in range(6)]
    rows = [(0, own[0] + long + "\n" + own[1]), (1, own[2] + long.replace(" ", "\n\t", 7)), (2, own[3] + short), (3, own[4] + short + "\n"), (4, own[5] + prose(60, 90)), (5, None)]
    found = {r.doc_id: r for r in S.substring_dedup(documents(rows), passages=True).collect()}
    assert [found[i].n_passages for i in range(6)] == [1, 1, 0, 0, 0, 0] and all(r.n_removed == 0 for r in found.values())
    assert found[0].n_passage_bytes == len(long)
    kept = {r.doc_id: r.text for r in S.without_repeats(documents(rows)).collect()}
    assert kept[1] == own[2] and kept[0] == own[0] + "\n" + own[1]
    assert all(kept[i] == (t or "") for i, t in rows[2:])
    check(documents, rows)


def test_neighbouring_short_repeats_are_no_passage(documents):
    one, two = " ".join(of_words(11, 30)), " ".join(of_words(12, 30))
    own = [prose(80 + i, 40) for i in range(4)]
    rows = [(1, f"{own[0]} {one} {two} {own[3]}"), (2, f"{own[1]} {one}"), (3, f"{two} {own[2]}")]
    assert {r.doc_id: r.text for r in S.without_repeats(documents(rows)).collect()} == dict(rows)
    assert all(r.n_passages == 0 for r in S.substring_dedup(documents(rows), passages=True).collect())


def test_a_passage_of_short_words(documents):
    r = random.Random(3)
    passage = " ".join(r.choice(["a", "of", "to", "in", "é", "I"]) for _ in range(55))
    assert len(passage) < 170
    rows = [(4, f"{prose(1, 20)}\n{passage}\n{prose(2, 20)}"), (5, f"{passage} {prose(3, 20)}")]
    kept = {r.doc_id: r.text for r in S.without_repeats(documents(rows)).collect()}
    assert kept == {4: f"{prose(1, 20)}\n\n{prose(2, 20)}", 5: f" {prose(3, 20)}"}


def test_word_units_of_many_texts_equal_those_of_each(documents):
    import numpy as np

    texts = ["", " a  b\n", "één\x00x  y", "z", "\t \n"]
    raw = [t.encode() for t in texts]
    both = S.units(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), True)
    assert both.offsets.tolist() == [0, 0, 2, 4, 5, 5]
    assert both.cut(np.array([0, 2, 4]), np.array([2, 4, 5])) == [b"a b", "één\x00x y".encode(), b"z"]


def test_a_passage_that_very_many_texts_share(documents):
    """One segment with more copies than salts, and one k-gram with many segments."""
    passage = prose(7, 90)
    check(documents, [(i, prose(1000 + i, 4) + " " + passage + " " + prose(3000 + i, 3)) for i in range(150)], length=200, gram=50)


def test_joins_of_anchors_are_salted(spark):
    rows = C.salted(spark.range(500).selectExpr("id", "1L as gram"), "id")
    known = C.each_salt(rows.groupBy("gram").agg(F.expr(C.PRESENT)))
    assert known.count() == C.SALTS
    joined = rows.join(known, ["gram", "salt"])
    assert joined.count() == 500 and max(r["count"] for r in joined.groupBy("salt").count().collect()) < 60
