"""Merge-type piece encoding by backtracking, and decoding, exactly as the library that made the model.

A piece sequence is the merge result of a text just when every piece re-merges to itself and every two
neighbours re-merge to themselves. So the encoder walks the text with the longest vocabulary match at
each place (one Aho-Corasick pass), takes a match if its neighbour on the left is compatible, falls
back to the next shorter match, and, where none fits, marks the place in a bitfield of failed
positions and steps back. No piece has a word separator after another character, so the text is
encoded word by word; characters outside the vocabulary become byte pieces and end a merge.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only, prepare, slices, spread

SPACE = "▁"
BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def vocabulary(model_file: str) -> dict:
    """Pieces, scores and special ids of a model file: what the executors get (its size is that of the vocabulary)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = model.vocab_size()
    plain = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in range(n)]
    return {"pieces": [model.id_to_piece(i) for i in range(n)], "scores": [model.get_score(i) for i in range(n)], "plain": plain, "control": [model.is_control(i) for i in range(n)], "unknown": model.unk_id(), "end": model.eos_id()}


class Encoder:
    """Encodes and decodes with one vocabulary. Caches are bounded and only save time."""

    WORDS, PAIRS, LONGEST = 200_000, 1_000_000, 48

    def __init__(self, vocab: dict):
        self.pieces, self.end, self.unknown = vocab["pieces"], vocab["end"], vocab["unknown"]
        self.scores = vocab["scores"]
        self.control = vocab["control"]
        self.ids = {p: i for i, (p, ok) in enumerate(zip(self.pieces, vocab["plain"])) if ok}
        self.bytes = {int(m[1], 16): i for i, p in enumerate(self.pieces) if not vocab["plain"][i] and (m := BYTE.fullmatch(p))}
        self.special = frozenset(i for i in range(len(self.pieces)) if not vocab["plain"][i])
        self.byte_of = {i: b for b, i in self.bytes.items()}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece has a separator after another character; word-wise encoding would not be exact")
        self.known = frozenset("".join(self.ids))
        self.lines = "\n" not in self.known
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.size = [len(p) for p in self.pieces]
        #: Of each piece, the longest piece that is a proper prefix of it.
        self.shorter = [next((i for k in range(len(p) - 1, 0, -1) if (i := self.ids.get(p[:k])) is not None), -1) for p in self.pieces]
        self.fits: dict[int, bool] = {}
        self.texts = [p.replace(SPACE, " ") for p in self.pieces]
        self.spaced: dict[str, tuple[str, int, str]] = {}
        self.bare: dict[str, tuple[str, int, str]] = {}
        #: The generations before: a word used again moves up, so a full cache never starts cold.
        self.old: dict[int, dict[str, tuple[str, int, str]]] = {id(self.spaced): {}, id(self.bare): {}}

    def merged(self, text: str) -> list[int]:
        """The result of merging neighbours, best score first and leftmost among equals, by a heap over a linked list."""
        part: list[str | None] = list(text)
        n = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (k := self.ids.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (-self.scores[k], i, j, part[i] + part[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if part[i] is None or part[j] is None or after[i] != j or part[i] + part[j] != both:
                continue
            part[i], part[j] = both, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [self.ids[p] for p in part if p is not None]

    def fit(self, left: int, right: int) -> bool:
        """Whether the right piece re-merges to itself, and so does its pair with the left piece (none: -1)."""
        if len(self.fits) >= self.PAIRS:
            self.fits.clear()
        ok = self.merged(self.pieces[right]) == [right] if left < 0 else self.fit(-1, right) and self.merged(self.pieces[left] + self.pieces[right]) == [left, right]
        self.fits[left << 32 | right] = ok
        return ok

    def backtracked(self, text: str) -> list[int]:
        """Pieces of a text whose characters are all in the vocabulary."""
        fits, size, shorter = self.fits, self.size, self.shorter
        n = len(text)
        longest = [-1] * (n + 1)
        for end, piece in self.automaton.iter(text):  # by rising end: the last match of a start is its longest
            longest[end + 1 - size[piece]] = piece
        failed = 0
        out: list[int] = []
        at, piece, last = 0, longest[0], -1
        while at < n:
            while piece >= 0:
                end = at + size[piece]
                if not failed >> end & 1:
                    ok = fits.get(last << 32 | piece)
                    if self.fit(last, piece) if ok is None else ok:
                        break
                piece = shorter[piece]
            if piece >= 0:
                out.append(piece)
                at, last, piece = end, piece, longest[end]
            else:
                if not out:
                    return self.merged(text)
                failed |= 1 << at
                at -= size[last]
                piece = shorter[out.pop()]
                last = out[-1] if out else -1
        return out

    def segment(self, text: str) -> list[int]:
        """Ids of one word with its separators."""
        whole = self.ids.get(text)
        if whole is not None and (self.fits.get(-1 << 32 | whole) or self.fit(-1, whole)):
            return [whole]
        out: list[int] = []
        start = 0
        for i, ch in enumerate(text) if not self.known.issuperset(text) else ():
            if ch not in self.known:
                if start < i:
                    out += self.backtracked(text[start:i])
                out += [self.bytes.get(b, self.unknown) for b in ch.encode()] if self.bytes else [self.unknown]
                start = i + 1
        if start < len(text):
            out += self.backtracked(text[start:])
        if text.startswith(SPACE * 2) and out != (exact := self._merged_segment(text)):
            return exact  # runs of separators have equal scores, where neighbours alone don't settle the order
        return out

    def _merged_segment(self, text: str) -> list[int]:
        out: list[int] = []
        for part in re.split(f"([^{re.escape(''.join(set(text) & self.known))}])", text):
            if part and all(c in self.known for c in part):
                out += self.merged(part)
            elif part:
                out += [self.bytes.get(b, self.unknown) for b in part.encode()]
        return out

    def decoded(self, ids: list[int]) -> str:
        """Text of the ids: separators become spaces, byte runs UTF-8 (U+FFFD where invalid), control ids vanish."""
        if not any(map(self.special.__contains__, ids)):
            return "".join(map(self.texts.__getitem__, ids))
        parts: list[str] = []
        run = bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                parts.append(run.decode("utf-8", "replace"))
                run = bytearray()
            if i == self.unknown:
                parts.append(" ⁇ ")
            elif not self.control[i]:
                parts.append(self.texts[i])
        if run:
            parts.append(run.decode("utf-8", "replace"))
        return "".join(parts)

    def entry(self, word: str, cache: dict[str, tuple[str, int, str]], lead: str) -> tuple[str, int, str]:
        old = self.old[id(cache)]
        found = old.get(word)
        if found is None:
            ids = self.segment(lead + word)
            found = (" ".join(map(str, ids)), len(ids), self.decoded(ids))
        if len(word) <= self.LONGEST:
            if len(cache) >= self.WORDS:
                old.clear()
                old.update(cache)
                cache.clear()
            cache[word] = found
        return found

    def chunks(self, text: str):
        """(ids as text, count, decoded text) of each word, in order."""
        if not text:
            return
        text = text.replace(SPACE, " ")
        spaced, bare = self.spaced, self.bare
        if not self.lines:
            for word in re.findall(r" +[^ ]*", " " + text):
                yield self.entry(word[1:].replace(" ", SPACE), spaced, SPACE)
            return
        newline = self.bytes.get(10, self.unknown)
        feed = (str(newline), 1, self.decoded([newline]))
        for k, line in enumerate(text.split("\n")):
            if k:
                yield feed
                words = re.findall(r"^[^ ]+| +[^ ]*", line) if "  " in line or line[:1] == " " or line[-1:] == " " else None
                if words is None:
                    head, *rest = line.split(" ")
                    if head:
                        yield bare.get(head) or self.entry(head, bare, "")
                    for w in rest:
                        yield spaced.get(w) or self.entry(w, spaced, SPACE)
                    continue
            else:
                words = re.findall(r" +[^ ]*", " " + line) if "  " in line or line[:1] == " " or line[-1:] == " " or not line else None
                if words is None:
                    for w in line.split(" "):
                        yield spaced.get(w) or self.entry(w, spaced, SPACE)
                    continue
            for w in words:
                if w[0] == " ":
                    w = w[1:].replace(" ", SPACE)
                    yield spaced.get(w) or self.entry(w, spaced, SPACE)
                else:
                    yield bare.get(w) or self.entry(w, bare, "")

    def encode(self, text: str) -> list[int]:
        """All ids of a text and the end id."""
        ids = " ".join([ids for ids, n, _ in self.chunks(text) if n])
        return [*(np.fromstring(ids, np.int32, sep=" ").tolist() if ids else ()), self.end]

    def decode(self, ids: list[int]) -> str:
        text = self.decoded(ids)
        return text[1:] if text.startswith(" ") else text

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids as text, and SHA-256 of the decoded text; memory grows with one text only."""
        found = list(self.chunks(text))
        ids = " ".join([c[0] for c in found if c[1]] + [str(self.end)])
        plain = "".join([c[2] for c in found])
        return sum([c[1] for c in found]) + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256((plain[1:] if plain[:1] == " " else plain).encode()).hexdigest()


#: One encoder a worker process, by the broadcast's id.
_ENCODERS: dict[int, Encoder] = {}


def _encoder(vocab) -> Encoder:
    key = vocab.value["key"]
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocab.value)
    return _ENCODERS[key]


def _shared(docs: DataFrame, model_file: str):
    vocab = vocabulary(model_file)
    vocab["key"] = hashlib.sha256(repr((vocab["pieces"], vocab["scores"])).encode()).hexdigest()
    return docs.sparkSession.sparkContext.broadcast(vocab)


def encode_pieces(docs: DataFrame, model_file: str) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, ids (array<int>, the end id last), decoded (string).

    Null and empty texts have the end id alone and decode to nothing. Repeated rows are encoded each.
    Texts of any length are encoded whole. A null doc_id is kept as null; other columns are ignored.
    An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    vocab = _shared(docs, model_file)

    def run(batches):
        encoder = _encoder(vocab)
        for whole in batches:
            for batch in slices(whole, "text"):
                ids = [encoder.encode(t or "") for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([encoder.decode(i) for i in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return spread(only(docs, doc_id="long", text="string")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def piece_digests(docs: DataFrame, model_file: str) -> DataFrame:
    """Like encode_pieces, but its digest: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    prepare(docs.sparkSession)
    vocab = _shared(docs, model_file)

    def run(batches):
        encoder = _encoder(vocab)
        for whole in batches:
            for batch in slices(whole, "text"):
                n, ids, plain = zip(*(encoder.digests(t or "") for t in batch.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(plain)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return spread(only(docs, doc_id="long", text="string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
