"""Benchmark decontamination: pigeonhole piece search, verified by bit-parallel edit distance.

An item of m characters may differ in e = floor(error_rate * m) edits. Cut into e + 1 pieces, at least
one piece survives every such set of edits untouched. One Aho-Corasick pass finds all pieces of all
items in a text; each hit fixes where the item would lie, give or take e places, and Myers' bit
vectors give the least edit distance of the item to any stretch there.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, only, prepare, slices, spread

#: White space that compares as a plain space; one character for one, so that places stay those of the text.
SPACES = {ord(c): " " for c in "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0                　"}


def folded(text: str) -> str:
    """Lower case and plain spaces, character for character."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    return low.translate(SPACES)


def peq(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(bits: dict[str, int], m: int, text: str, most: int, anchored: bool = False) -> tuple[int, int]:
    """Least edit distance of a pattern (its character masks) to a stretch of text, and where the first such stretch ends.

    anchored: the stretch starts where the text starts. (most + 1, -1) if none is within `most`.
    """
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = mask, 0, m
    best, end = (m, 0) if m <= most else (most + 1, -1)
    carry = 1 if anchored else 0
    for j, c in enumerate(text):
        eq = bits.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & mask | carry
        mh = mh << 1 & mask
        pv = mh | ~(xv | ph) & mask
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
            if not best:
                break
    return best, end


#: Matchers in this worker process, by a digest of their items and settings: the last in use, built once a worker and not once a task.
_MATCHERS: dict[str, Matcher] = {}


class Matcher:
    """All items, prepared for search."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float, least_chars: int = 1):
        self.items = [(i, f) for i, t in items if len(f := folded(t or "").strip()) >= max(1, least_chars)]
        self.error_rate = error_rate
        self.budget = [int(error_rate * len(t)) for _, t in self.items]
        self.bits = [peq(t) for _, t in self.items]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, ((_, text), e) in enumerate(zip(self.items, self.budget)):
            cuts = [len(text) * p // (e + 1) for p in range(e + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(text[a:b], []).append((k, a))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, (len(piece) - 1, where))
        if pieces:
            self.automaton.make_automaton()

    def matches(self, text: str):
        """(item id, distance, start, end) of each item's nearest stretch within its budget."""
        if not self.items or not text:
            return
        text = folded(text)
        places: dict[int, set[int]] = {}
        for end, (back, where) in self.automaton.iter(text):
            for k, at in where:
                places.setdefault(k, set()).add(end - back - at)
        for k, starts in places.items():
            item, pattern = self.items[k]
            e, m = self.budget[k], len(pattern)
            exact = [s for s in starts if s >= 0 and text.startswith(pattern, s)]
            if exact:
                yield item, 0, min(exact), min(exact) + m
                continue
            best = (e + 1, -1)
            ordered = sorted(starts)
            i = 0
            while i < len(ordered) and e:
                j = i
                while j + 1 < len(ordered) and ordered[j + 1] - ordered[j] <= m:
                    j += 1
                lo = max(0, ordered[i] - e)
                d, end = myers(self.bits[k], m, text[lo : ordered[j] + m + e], min(e, best[0] - 1))
                if end >= 0 and d < best[0]:
                    best = (d, lo + end)
                i = j + 1
            if best[0] <= e:
                d, end = best
                back = text[max(0, end - m - e) : end][::-1]
                start = end - myers(peq(pattern[::-1]), m, back, d, anchored=True)[1]
                yield item, d, start, end



def matcher(block: Block, error_rate: float, least_chars: int) -> Matcher:
    """The matcher of a block, from this worker's store. Two blocks never share a key, whatever became of the broadcasts that brought them."""
    key = f"{block.digest}:{error_rate}:{least_chars}"
    if key not in _MATCHERS:
        _MATCHERS.clear()  # one at a time: a block's automaton is the largest thing that a worker holds
        _MATCHERS[key] = Matcher(block.items, error_rate, least_chars)
    return _MATCHERS[key]


@dataclass
class Block:
    """Items that are searched at once, and a digest of them."""

    items: list[tuple[int, str]]
    digest: str


def _blocks(items: DataFrame, most: int):
    """Items in blocks of at most `most` characters (or one item), so that what is broadcast has a bound."""

    def made(rows: list[tuple[int, str]]) -> Block:
        return Block(rows, hashlib.sha256(repr(rows).encode()).hexdigest())

    block, size = [], 0
    for row in only(items, item_id="long", text="string").where(F.col("item_id").isNotNull()).toLocalIterator():
        n = len(row["text"] or "")
        if block and size + n > most:
            yield made(block)
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += n
    yield made(block)


def contaminated(docs: DataFrame, items: DataFrame, *, error_rate: float = 0.08, least_chars: int = 1, block_chars: int = 4_000_000) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) -> doc_id, item_id, distance, start, end: one row per match.

    start and end are character offsets in the document of the nearest stretch (the first of several),
    case and kind of white space aside. The items are the query set: they are broadcast in blocks of
    block_chars characters, each block against all documents, so that the cost is one pass over the documents a block.
    Items below least_chars characters match nothing; at 1, an item of one short word matches every text that holds it.
    Null, empty and blank texts or items match nothing. Repeated documents are matched each; repeated items give
    a row each. A null doc_id is carried; an item with a null id is ignored. Empty tables give no rows; other
    columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    texts = spread(only(docs, doc_id="long", text="string"))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])

    def search(shared):
        def run(batches):
            found_in = matcher(shared.value, error_rate, least_chars).matches
            for whole in batches:
                for batch in slices(whole, "text"):
                    found = [(d, *m) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) if t for m in found_in(t)]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*found), schema)], schema=schema)

        return texts.mapInArrow(run, "doc_id long, item_id long, distance int, start long, end long")

    out = None
    for block in _blocks(items, block_chars):
        part = search(spark.sparkContext.broadcast(block))
        out = part if out is None else out.union(part)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, *, error_rate: float = 0.08, least_chars: int = 1, block_chars: int = 4_000_000) -> DataFrame:
    """The documents, with all their columns, that match no item (see contaminated); decided row by row, without a shuffle."""
    prepare(docs.sparkSession)
    for block in _blocks(items, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        flag = f"hit_{uuid.uuid4().hex}"

        def compute(column, shared=shared):
            found_in = matcher(shared.value, error_rate, least_chars).matches
            return [pa.array([next(found_in(t or ""), None) is not None for t in column.to_pylist()], pa.bool_())]

        docs = carried(docs, [(flag, "boolean")], compute).where(~F.col(flag)).drop(flag)
    return docs
