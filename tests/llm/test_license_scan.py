import random
import re

import pytest
from llm_helpers import prose

from forumlens.llm import license_scan as L


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, phrases=L.PHRASES, texts=L.TEMPLATES):
    """Every place of every template: all diagonals with three equal words in a row, merged, and their cover counted."""
    words = plain_words(text)
    starts, base, labels, score = [], set(), set(), 0.0
    for is_base, given in ((True, phrases), (False, texts)):
        for label, body in given:
            t = plain_words(body)
            size = len(t)
            hits = {}
            at = {}
            for j in range(size - 2):
                at.setdefault(tuple(t[j : j + 3]), []).append(j)
            for i in range(len(words) - 2):
                for j in at.get(tuple(words[i : i + 3]), []):
                    hits.setdefault(i - j, set()).update((j, j + 1, j + 2))
            places = []
            for d in sorted(hits):
                if not places or d - places[-1][-1] > (0 if is_base else max(2, size // 10)):
                    places.append([])
                places[-1].append(d)
            for place in places:
                share = len(set().union(*(hits[d] for d in place))) / size
                if share >= (1 if is_base else L.SHARE):
                    labels.add(label)
                    score = max(score, share)
                    if is_base:
                        base.add(label)
                        starts.append(place[0])
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def found(docs, **options):
    return sorted(((r.doc_id, tuple(r)[1:8]) for r in L.scan_licenses(docs, **options).collect()), key=str)


def altered(text, seed):
    r = random.Random(seed)
    out = text.split()
    for _ in range(r.randrange(0, 12)):
        at = r.randrange(len(out))
        out[at : at + r.randrange(0, 2)] = r.choice([["zzz"], [], ["of", "the"], [out[at]]])
    return " ".join(out)


def test_equals_brute_force(documents, awkward):
    rows = list(awkward)
    for k in range(70):
        label, body = L.TEMPLATES[k % len(L.TEMPLATES)]
        rows.append((100 + k, prose(k, 10 + k % 7) + "\n" + altered(body, k) + ".\n" + prose(k + 500, 9)))
    rows += [(1, "Under  the-MIT License. under the mit\nlicense"), (2, "under the mit licenses"), (3, "cc by nc cc by nc by nc cc-BY-NC 4.0"), (4, "APACHE license, version 2 apache\x00license_version\t2"), (5, "under the mit"), (6, "ÉCC by nc CC BY NC é"), (7, "under the mit license" * 2)]
    assert found(documents(rows)) == sorted(((i, brute(t)) for i, t in rows), key=str)


def test_an_altered_quotation_is_one_place(documents):
    body = L.TEMPLATES[6][1].split()
    text = prose(1, 50) + " " + " ".join([*body[:20], "indeed", *body[20:45], *body[47:]]) + " " + prose(2, 30)
    [row] = L.scan_licenses(documents([(1, text)])).collect()
    assert row.labels == "mit" and row.base_labels == "" and row.n_base == 0 and row.first_word is None and 0.9 < row.score < 1
    [span] = row.spans
    words = plain_words(text)
    assert words[span["first"]] == "permission" and words[span["last"]] == "software" and span["share"] == row.score


def test_more_positions_than_are_broadcast(documents, monkeypatch):
    monkeypatch.setattr(L, "BROADCAST_POSITIONS", 10)
    rows = [(k, prose(k, 10) + " " + altered(L.TEMPLATES[k % 14][1], k)) for k in range(20)]
    assert found(documents(rows)) == sorted(((i, brute(t)) for i, t in rows), key=str)


def test_very_long_and_repetitive_texts(documents, monkeypatch):
    monkeypatch.setattr(L, "ROW_GRAMS", 1000)
    monkeypatch.setattr(L, "BLOCK", 64)
    rows = [(1, "cc by nc " * 20_000), (2, "of the software " * 3000 + L.TEMPLATES[6][1]), (3, prose(4, 40_000) + " under the MIT license")]
    assert found(documents(rows)) == sorted(((i, brute(t)) for i, t in rows), key=str)


def test_hashes_of_equal_runs_are_equal_wherever_they_stand():
    import numpy as np

    def of(*texts):
        raw = [t.encode() for t in texts]
        return L.grams(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))

    value, first, n = of("a b c d", "", "b c", "x b c d")
    assert first.tolist() == [0, 2, 2, 2, 4] and n.tolist() == [4, 0, 2, 4]
    assert value[1] == value[3] and len(set(value.tolist())) == 3


def test_own_templates_and_empty_tables(documents, spark):
    assert L.scan_licenses(documents([])).collect() == []
    own = {"phrases": [("x", "one two three")], "texts": [("y", "four five six seven")]}
    rows = [(1, "one two three four five six"), (2, "six five four")]
    assert found(documents(rows), **own) == sorted(((i, brute(t, **own)) for i, t in rows), key=str)
    with pytest.raises(ValueError):
        L.templates([("x", "only two")], [])


def test_repeated_rows_and_null_ids_of_a_hot_text(documents):
    text = prose(3, 20) + " licensed under CC BY-NC 4.0"
    rows = [(None, text)] * 60 + [(7, text)] * 20 + [(7, prose(9, 20))]
    assert found(documents(rows)) == sorted(((i, brute(t)) for i, t in rows), key=str)
