import hashlib
import random

import pytest
from llm_helpers import prose

from forumlens.llm import pieces

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def encoder():
    return pieces.Encoder(pieces.vocabulary(MODEL))


def test_equals_the_library_on_random_texts(encoder, library):
    r = random.Random(11)
    parts = ["▁", " ", "  ", "a", "th", "in", "é", "日", "\n", "\t", "😀", "\x00", "<s>", "The", "ing", "   ", "\xa0", "ß", "0", "..", "==", "//", "http", "\r\n", "ﬁ", "﻿", "　", "of"]
    for _ in range(4000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(0, 15)))
        ids = library.encode(text, add_eos=True)
        assert encoder.encode(text) == ids, text
        assert encoder.decode(ids) == library.decode(ids), text


def test_long_words_and_runs(encoder, library):
    r = random.Random(2)
    for text in ("".join(r.choice("abcdeilnost") for _ in range(30_000)), " " * 3000 + "a" * 3000, prose(3, 3000)):
        assert encoder.encode(text) == library.encode(text, add_eos=True)


def test_small_caches_change_nothing(library):
    small = pieces.Encoder(pieces.vocabulary(MODEL))
    small.WORDS, small.PAIRS = 5, 5
    text = prose(8, 500)
    assert small.encode(text) == library.encode(text, add_eos=True)


def test_failed_places_are_remembered(encoder, library):
    """Texts on which the longest match is often wrong."""
    r = random.Random(5)
    for _ in range(3000):
        text = "".join(r.choice(["un", "der", "s", "t", "an", "ding", "ly", "er", "re", "e", "d"]) for _ in range(r.randrange(1, 12)))
        assert encoder.encode(text) == library.encode(text, add_eos=True)


def test_digests(documents, awkward, library):
    rows = pieces.piece_digests(documents(awkward), MODEL).collect()
    assert len(rows) == len(awkward)

    def digest(t):
        ids = library.encode(t or "", add_eos=True)
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()

    want = sorted(((i, *digest(t)) for i, t in awkward), key=lambda r: (str(r[0]), r[1:]))
    assert sorted((tuple(r) for r in rows), key=lambda r: (str(r[0]), r[1:])) == want
    assert pieces.piece_digests(documents([]), MODEL).collect() == []


def test_ids_and_round_trip(documents, awkward):
    out = pieces.encode_pieces(documents(awkward), MODEL).collect()
    texts = sorted((t or "") for _, t in awkward)
    assert sorted(r.decoded for r in out) == texts
    assert all(r.ids[-1] == 2 for r in out)
