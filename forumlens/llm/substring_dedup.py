"""Removal of every byte covered by a long string that occurs more than once, by a hash-compared suffix sort.

Only content-defined suffixes are sorted. In each window of `length` bytes the k-gram of least hash is
the window's anchor, so equal windows share an anchor at the same place. An anchor answers for the run
of windows that chose it; the bytes of that run are its segment.

1. Anchors whose k-gram occurs once are done: nothing of theirs repeats.
2. Equal segments of one k-gram (64-bit polynomial hash of the k-gram and a 128-bit cryptographic digest
   of the segment's bytes) repeat as a whole; one of them goes on as their representative.
3. The different segments of one k-gram are suffix-sorted to the right and, reversed, to the left of
   the anchor: a merge sort whose comparisons find the common extension by binary search over prefix
   polynomial hashes and verify it on the bytes. A window repeats where two segments agree in both
   directions far enough, which the adjacent common extensions of the two orders decide exactly.
4. The segments of a k-gram with very many different ones are cut into ranges of 64, 8 and at last 1
   window, keyed by the bytes that all windows of a range share. Equal windows keep equal keys, so each
   cut sends the group on in smaller ones; steps 2 and 3 follow each cut.

Texts are searched as bytes (`length` of them) or as words (PASSAGE words in a row, whatever white space is between):
the units that windows, anchors and extensions count. Words are compared as the bytes between white space.

Joins of anchors to what is known of their k-gram or segment are salted, so that the anchors of a passage
that a third of all texts share go to SALTS tasks; the known side has a row for each salt that occurs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cmp_to_key
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PRESENT, U64, Powers, binary_column, each_salt, mix, prefix_hashes, prepare, salted, slices, spread, stage, unstage, word_hashes, words_of

NO_ID = -(1 << 63)
#: Starts of windows that are hashed at once.
STARTS = 1 << 19
#: What names a text: its id and a hash of it.
KEY = ["doc_id", "th"]
SEGMENT = ["gram", "seg", "seg2"]
#: Columns of an anchor's run of windows, as Arrow has them.
IDS = [("doc_id", pa.int64()), ("th", pa.int64())]
PLACE = [(c, pa.int32()) for c in ("lo", "hi", "pos")]
DIGEST = [("gram", pa.int64()), ("seg", pa.int64()), ("seg2", pa.int64())]


def digests(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each part, as two columns of longs."""
    both = np.frombuffer(b"".join([blake2b(x, digest_size=16).digest() for x in parts]), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _batch(rows, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), schema)], schema=schema)


@dataclass
class Text:
    """Texts as units: their symbols (to hash), where each text's units begin (n + 1 offsets), and each unit's bytes in raw."""

    symbols: np.ndarray
    offsets: np.ndarray
    start: np.ndarray | None
    stop: np.ndarray | None
    raw: bytes

    def cut(self, first: np.ndarray, last: np.ndarray) -> list[bytes]:
        """The bytes of the units first to last (without last)."""
        if self.start is None:
            return [self.raw[a:b] for a, b in zip(first.tolist(), last.tolist())]
        return [self.raw[a:b] for a, b in zip(self.start[first].tolist(), self.stop[last - 1].tolist())]


def units(data: np.ndarray, offsets: np.ndarray, by_words: bool) -> Text:
    """Bytes as they are, or words with one space between any two."""
    if not by_words:
        return Text(data, offsets, None, None, data.tobytes())
    s, e, doc = words_of(data, offsets)
    size = e - s
    start = np.cumsum(size + 1) - size - 1
    inside = np.repeat(np.arange(len(s)), size)  # the word of each byte of a word
    nth = np.arange(len(inside)) - np.repeat(np.cumsum(size) - size, size)
    plain = np.full(int((size + 1).sum()), 0x20, np.uint8)
    plain[start[inside] + nth] = data[s[inside] + nth]
    count = np.bincount(doc, minlength=len(offsets) - 1) if len(doc) else np.zeros(len(offsets) - 1, np.int64)
    return Text(word_hashes(data, s, e), np.concatenate([[0], np.cumsum(count)]).astype(np.int64), start, start + size, plain.tobytes())


def parts_of(raw: bytes, by_words: bool) -> Sequence:
    """The units of a segment's bytes."""
    return raw.split(b" ") if by_words else raw


def joined(parts: Sequence, by_words: bool) -> bytes:
    return b" ".join(parts) if by_words else bytes(parts)


def hashes_of(parts: Sequence) -> list[int]:
    """Prefix hashes of a segment's units."""
    symbols = np.frombuffer(parts, np.uint8) if isinstance(parts, bytes) else np.array([xxhash.xxh3_64_intdigest(w) for w in parts], U64)
    return prefix_hashes(symbols).tolist()


def _least(key: np.ndarray, window: int) -> np.ndarray:
    """Minimum of each run of `window` keys, by block-wise prefix and suffix minima."""
    n = len(key)
    padded = np.full(-(-n // window) * window, np.iinfo(U64).max, U64)
    padded[:n] = key
    blocks = padded.reshape(-1, window)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - window + 1], ahead[window - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, k: int):
    """Document number, first start, last start, anchor (units from the document's start) and k-gram hash of each run of windows.

    data are the units' symbols: bytes, or hashes of words.
    """
    out = []
    for at in range(0, max(0, len(data) - length + 1), STARTS):
        part = data[at : at + STARTS + length - 1]
        n = len(part)
        g = prefix_hashes(part)
        gram = mix((g[k:] - g[:-k]) * Powers.upto(n + 1)[1][: n - k + 1])
        who = (_least(gram & U64(0xFFFFFFFF00000000) | np.arange(len(gram), dtype=U64), length - k + 1) & U64(0xFFFFFFFF)).astype(np.int64)
        start = np.arange(at, at + len(who))
        doc = np.searchsorted(offsets, start, side="right") - 1
        ok = start + length <= offsets[doc + 1]
        start, who, doc = start[ok], who[ok], doc[ok]
        if not len(start):
            continue
        new = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (doc[1:] != doc[:-1])]))
        last = np.concatenate([new[1:], [len(start)]]) - 1
        base = offsets[doc[new]]
        out.append((doc[new], start[new] - base, start[last] - base, who[new] + at - base, gram[who[new]].view(np.int64)))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 5


def _anchored(length: int, k: int, by_words: bool):
    schema = pa.schema([*IDS, *PLACE, *DIGEST])

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "data", 1 << 20):
                text = units(*binary_column(batch.column("data")), by_words)
                doc, lo, hi, pos, gram = anchors(text.symbols, text.offsets, length, k)
                at = text.offsets[doc]
                seg = digests(text.cut(at + lo, at + hi + length))
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in KEY), *(pa.array(x.astype(np.int32)) for x in (lo, hi, pos)), pa.array(gram), *map(pa.array, seg)], schema=schema)

    return run


def _cut(length: int, by_words: bool):
    """Texts with lists of runs -> the runs with their bytes."""
    schema = pa.schema([*IDS, ("pos", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("gram", pa.int64()), ("n", pa.int64()), ("bytes", pa.binary())])

    def run(batches):
        for batch in batches:
            for one in slices(batch, "data", 1 << 22):
                text, rows = units(*binary_column(one.column("data")), by_words), []
                for at, *key, runs in zip(text.offsets.tolist(), *(one.column(c).to_pylist() for c in (*KEY, "runs"))):
                    lo, hi = (at + np.array([r[c] for r in runs], np.int64) for c in ("lo", "hi"))
                    rows += [(*key, r["pos"], r["lo"], r["hi"], r["gram"], r["n"], raw) for r, raw in zip(runs, text.cut(lo, hi + length))]
                if rows:
                    yield _batch(rows, schema)

    return run


def extension(x: Sequence, hx: list[int], y: Sequence, hy: list[int]) -> int:
    """Length of the longest common prefix: binary search over prefix hashes, verified on the bytes or words."""
    lo, hi = 0, min(len(x), len(y))
    top = hi
    while lo < hi:
        mid = (lo + hi + 1) >> 1
        if hx[mid] == hy[mid]:
            lo = mid
        else:
            hi = mid - 1
    if x[:lo] == y[:lo] and (lo == top or x[lo] != y[lo]):
        return lo
    lo = 0  # two different prefixes had one hash
    while lo < top and x[lo] == y[lo]:
        lo += 1
    return lo


def suffix_sort(strings: list[Sequence]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings (bytes, or lists of words), and the common extension of each with the one before it in that order."""
    hashed = [hashes_of(s) for s in strings]

    def compare(i: int, j: int) -> int:
        x, y = strings[i], strings[j]
        e = extension(x, hashed[i], y, hashed[j])
        if e == len(x) or e == len(y):
            return len(x) - len(y)
        return -1 if x[e] < y[e] else 1

    order = sorted(range(len(strings)), key=cmp_to_key(compare))  # Python's sort is a merge sort
    common = [extension(strings[i], hashed[i], strings[j], hashed[j]) for i, j in zip(order, order[1:])]
    return np.array(order), np.array(common, np.int64)


def repeats(segments: list[Sequence], left: list[int], length: int) -> np.ndarray:
    """Which windows of segments around one anchor occur in two of them: flags [d, segment].

    left[i] is the number of units before the anchor in segment i; the window d starts d units before the anchor.
    """
    n = len(segments)
    first = min(length - (len(s) - b) for s, b in zip(segments, left))
    d = np.arange(max(0, first), max(left) + 1)
    group = []
    for strings, need in (([s[b:] for s, b in zip(segments, left)], length - d), ([s[:b][::-1] for s, b in zip(segments, left)], d)):
        order, common = suffix_sort(strings)
        part = np.zeros((len(d), n), np.int64)
        part[:, order[1:]] = np.cumsum(common[None, :] < need[:, None], axis=1)
        group.append(part)
    code = group[0] * n + group[1]
    own = np.array([[length - (len(s) - b), b] for s, b in zip(segments, left)])
    code[(d[:, None] < own[None, :, 0]) | (d[:, None] > own[None, :, 1])] = -1
    order = np.argsort(code, axis=1, kind="stable")
    ranked = np.take_along_axis(code, order, axis=1)
    same = (ranked[:, 1:] == ranked[:, :-1]) & (ranked[:, 1:] >= 0)
    flag = np.zeros((len(d), n), bool)
    flag[:, 1:] |= same
    flag[:, :-1] |= same
    out = np.zeros((max(left) + 1, n), bool)
    spread = np.zeros_like(flag)
    np.put_along_axis(spread, order, flag, axis=1)
    out[d] = spread
    return out


def _compared(length: int, by_words: bool):
    """Runs sorted by k-gram -> repeated stretches."""
    schema = pa.schema([*IDS, ("start", pa.int32()), ("stop", pa.int32())])

    def group(rows: list[tuple]):
        flags = repeats([parts_of(r[-1], by_words) for r in rows], [r[2] - r[3] for r in rows], length)
        for i, (*key, pos, _, _) in enumerate(rows):
            on = np.flatnonzero(flags[:, i])
            if len(on):
                for run in np.split(on, np.flatnonzero(np.diff(on) > 1) + 1):
                    yield *key, pos - int(run[-1]), pos - int(run[0]) + length

    def run(batches):
        def groups():
            key, rows = None, []
            for batch in batches:
                for gram, *row in zip(*(batch.column(c).to_pylist() for c in ("gram", *KEY, "pos", "lo", "bytes"))):
                    if gram != key:
                        if len(rows) > 1:
                            yield rows
                        key, rows = gram, []
                    rows.append(row)
            if len(rows) > 1:
                yield rows

        out = []
        for rows in groups():
            out += group(rows)
            while len(out) >= 8192:
                yield _batch(out[:8192], schema)
                out = out[8192:]
        if out:
            yield _batch(out, schema)

    return run


def _ranged(length: int, width: int, by_words: bool):
    """Runs -> parts of at most `width` windows, keyed by the bytes that all windows of the range share."""
    schema = pa.schema([*IDS, ("pos", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), *DIGEST, ("bytes", pa.binary())])

    def signed(x: int) -> int:
        return x - (1 << 64) if x >> 63 else x

    def run(batches):
        for batch in batches:
            rows, parts = [], []
            for *key, pos, lo, hi, gram, raw in zip(*(batch.column(c).to_pylist() for c in (*KEY, "pos", "lo", "hi", "gram", "bytes"))):
                whole = parts_of(raw, by_words)
                for x in range((pos - hi) // width * width, pos - lo + 1, width):
                    first, last = max(lo, pos - x - width + 1), min(hi, pos - x)
                    shared = joined(whole[pos - x - lo : max(0, pos - x - width + 1 - lo + length)], by_words)  # none, if ranges are longer than windows
                    rows.append((*key, pos, first, last, signed(xxhash.xxh3_64_intdigest(shared, seed=(gram ^ x * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))))
                    parts.append(joined(whole[first - lo : last - lo + length], by_words))
            if rows:
                cells = [pa.array(x, t.type) for x, t in zip(zip(*rows), schema)]
                yield pa.RecordBatch.from_arrays([*cells, *map(pa.array, digests(parts)), pa.array(parts, pa.binary())], schema=schema)

    return run


def _span(start, stop):
    """A stretch as one number: lists of them are plain arrays of longs, in order of start."""
    return (F.shiftleft(start.cast("long"), 32) + stop).alias("span")


IDS_DDL = "doc_id long, th long"
RUN = f"{IDS_DDL}, pos int, lo int, hi int, gram long"


def _settled(runs: DataFrame, length: int, most: int, widths: tuple[int, ...], by_words: bool, keep) -> DataFrame:
    """runs(RUN, n, bytes) of k-grams with n different segments -> their repeated stretches. keep stages a table."""
    calm = runs.where(F.col("n") <= most) if widths else runs
    calm = calm.repartition("gram").sortWithinPartitions("gram").mapInArrow(_compared(length, by_words), f"{IDS_DDL}, start int, stop int").select(*KEY, _span(F.col("start"), F.col("stop")))
    if not widths or runs.where(F.col("n") > most).isEmpty():
        return calm
    parts = runs.where(F.col("n") > most).mapInArrow(_ranged(length, widths[0], by_words), f"{RUN}, seg long, seg2 long, bytes binary")
    whole, several = _grouped(keep(parts, "ranges"), length, ["bytes"], keep)
    return calm.union(whole).union(_settled(keep(several, "ranges"), length, most, widths[1:], by_words, keep))


def _grouped(rows: DataFrame, length: int, more: list[str], keep) -> tuple[DataFrame, DataFrame]:
    """Stretches of segments that repeat whole, and one row of each segment of a k-gram that has several.

    Counts are combined before the shuffle and joined back by salted keys.
    """
    rows = salted(rows, *KEY, "lo", "hi")  # another salt than that by which rows were laid out, so that skew handling can split further
    own = [*KEY, "pos", "lo", "hi", *more]  # of any one row: all first values of a group come from the same one
    g = keep(rows.groupBy(*SEGMENT).agg(F.count("*").alias("m"), F.expr(PRESENT), *(F.first(c).alias(c) for c in own)), "segments")
    again = each_salt(g.where("m > 1").select(*SEGMENT, "salts"))
    whole = rows.join(again, [*SEGMENT, "salt"]).select(*KEY, _span(F.col("lo"), F.col("hi") + length))
    one = salted(g.select("gram", *own), *KEY, "pos")
    several = keep(one.groupBy("gram").agg(F.count("*").alias("n"), F.expr(PRESENT)).where("n > 1"), "several")
    return whole, one.join(each_salt(several), ["gram", "salt"]).select("gram", "n", *KEY, "pos", "lo", "hi", *more)


def repeated_spans(texts: DataFrame, *, length: int = 400, gram: int = 100, by_words: bool = False, group_rows: int = 1024) -> DataFrame:
    """texts(doc_id, th, data) -> (doc_id, th, spans): per text that has any, a list of stretches covered by repeated strings of `length` units (see _span).

    Units are bytes or words. Stretches may overlap. Rows that repeat an id and its text share one list.
    """
    made: list[DataFrame] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        made.append(stage(df, name))
        return made[-1]

    a = salted(keep(spread(texts).mapInArrow(_anchored(length, gram, by_words), f"{IDS_DDL}, lo int, hi int, pos int, gram long, seg long, seg2 long"), "anchors"), *KEY, "pos")
    shared = keep(a.groupBy("gram").agg(F.count("*").alias("k"), F.expr(PRESENT)).where("k > 1").select("gram", "salts"), "grams")
    b = keep(a.join(each_salt(shared), ["gram", "salt"]).drop("salt"), "shared")
    unstage(*made[:2])
    whole, runs = _grouped(b, length, [], keep)
    by_text = runs.groupBy(*KEY).agg(F.collect_list(F.struct("lo", "hi", "pos", "gram", "n")).alias("runs"))
    cut = texts.join(by_text, KEY).select(*KEY, "data", "runs").mapInArrow(_cut(length, by_words), f"{RUN}, n long, bytes binary")
    widths = (64, 8, 1) if not by_words else (8, 1)
    spans = whole.union(_settled(keep(cut, "runs"), length, group_rows, widths, by_words, keep))
    out = stage(spans.groupBy(*KEY).agg(F.collect_set("span").alias("spans")), "spans")
    unstage(*made)
    return out


def merged(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the maximal stretches that the spans cover."""
    if not len(spans):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    spans = np.sort(spans)
    start, stop = spans >> 32, np.maximum.accumulate(spans & 0xFFFFFFFF)
    new = np.flatnonzero(np.concatenate([[True], start[1:] > stop[:-1]]))
    return start[new], stop[np.concatenate([new[1:], [len(spans)]]) - 1]


def _byte_spans(raw: bytes, spans: np.ndarray) -> np.ndarray:
    """Stretches of words as stretches of bytes, from the first byte of the first word to the last of the last."""
    if not len(spans):
        return spans
    s, e, _ = words_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    return (s[spans >> 32] << 32) + e[(spans & 0xFFFFFFFF) - 1]


def _without(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    return b"".join([raw[a:b] for a, b in zip([0, *(b for _, b in runs)], [*(a for a, _ in runs), len(raw)])])


def _lists(column: pa.Array):
    """The long arrays of a list column, empty where null."""
    values, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(at, at[1:])]


def _texts(docs: DataFrame, **more) -> DataFrame:
    texts = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary").alias("data"), *(c.alias(x) for x, c in more.items()))
    return texts.select("doc_id", F.xxhash64("data").alias("th"), "data", *more)


#: A passage of words: the least number of words that make one, and the run of words that anchors it.
PASSAGE = {"length": 51, "gram": 12}


def _known(texts: DataFrame, length: int, gram: int, words: int, word_gram: int, group_rows: int) -> DataFrame:
    """Per text that has any: stretches of repeated strings of `length` bytes (spans) and of `words` words (passages; none if words is 0)."""
    spans = repeated_spans(texts, length=length, gram=gram, group_rows=group_rows)
    if not words:
        return spans.withColumn("passages", F.lit(None).cast("array<bigint>"))
    return spans.join(repeated_spans(texts, length=words, gram=word_gram, by_words=True, group_rows=group_rows).withColumnRenamed("spans", "passages"), KEY, "full")


def _with_spans(texts: DataFrame, known: DataFrame, *more: str) -> DataFrame:
    empty = F.array().cast("array<bigint>")
    return texts.join(known, KEY, "left").select("doc_id", "data", *(F.coalesce(c, empty).alias(c) for c in ("spans", "passages")), *more)


def substring_dedup(docs: DataFrame, *, length: int = 400, gram: int = 100, group_rows: int = 1024, passages: bool = False) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes).

    Removes each byte covered by a string of `length` bytes that also starts anywhere else in the table,
    in the same text too; strings are judged on the input. A null text counts as empty and keeps zero
    bytes, as does an empty one; texts below `length` bytes are kept whole. Repeated rows repeat each
    other's strings. A null doc_id is carried as null. An empty table gives no rows. Other columns are ignored.

    passages=True adds n_passages and n_passage_bytes: the maximal stretches of which each byte lies in a repeated string of
    over 50 words (whatever white space is between them) or of `length` bytes. Those of words alone are not removed from `kept`.
    """
    prepare(docs.sparkSession)
    texts = _texts(docs)
    known = _known(texts, length, gram, PASSAGE["length"] if passages else 0, PASSAGE["gram"], group_rows)
    out = _with_spans(texts, known).mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, n_passages long, n_passage_bytes long")
    return out.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept", *["n_passages", "n_passage_bytes"] * passages)


def _found(batch: pa.RecordBatch):
    """Per text: its bytes, the stretches of repeated strings of bytes, and those of passages."""
    for raw, spans, words in zip(batch.column("data").to_pylist(), _lists(batch.column("spans")), _lists(batch.column("passages"))):
        gone = list(zip(*(x.tolist() for x in merged(spans))))
        yield raw, gone, list(zip(*(x.tolist() for x in merged(np.concatenate([spans, _byte_spans(raw, words)]))))) if len(words) else gone


def _removed(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("n_passages", pa.int64()), ("n_passage_bytes", pa.int64())])
    for whole in batches:
        for batch in slices(whole, "data", 1 << 22):
            rows = []
            for doc, (raw, gone, found) in zip(batch.column("doc_id").to_pylist(), _found(batch)):
                kept = _without(raw, gone)
                rows.append((doc, len(raw), len(raw) - len(kept), len(gone), kept, len(found), sum(b - a for a, b in found)))
            yield _batch(rows, schema)


def _carrying(names: list[str]):
    def run(batches):
        for whole in batches:
            for batch in slices(whole, "data", 1 << 22):
                kept = [_without(raw, found).decode("utf-8", "ignore") if found else raw.decode("utf-8", "replace") for raw, _, found in _found(batch)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.string()), *(batch.column(c) for c in names)], names=["doc_id", "kept", *names])

    return run


def without_repeats(docs: DataFrame, *, words: int = PASSAGE["length"], word_gram: int = PASSAGE["gram"], length: int = 400, gram: int = 100, group_rows: int = 1024) -> DataFrame:
    """The documents, with all their columns, their texts without repeated passages, and n_chars (if they have it) anew.

    Each byte goes that lies in a string of `words` words, or of `length` bytes, that also starts anywhere else in the table.
    Strings are judged on the input, each by itself: short repeats that stand side by side are not one long one. Every copy goes; strings of words are equal
    whatever white space is between the words. A character of which one byte is removed goes whole. Texts may become empty;
    rows stay. Null texts become empty ones; null ids are carried; repeated rows repeat each other's strings; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    names = [f"x{i}" for i in range(len(rest))]
    texts = _texts(docs, **{x: docs[c] for x, c in zip(names, rest)})
    known = _known(texts.select(*KEY, "data"), length, gram, words, word_gram, group_rows)
    schema = T.StructType([*T.StructType.fromDDL("doc_id long, kept string").fields, *(T.StructField(x, docs.schema[c].dataType) for c, x in zip(rest, names))])
    out = _with_spans(texts, known, *names).mapInArrow(_carrying(names), schema)
    new = {c: F.col(x) for c, x in zip(rest, names)} | {"doc_id": F.nullif("doc_id", F.lit(NO_ID)).cast(docs.schema["doc_id"].dataType), "text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return out.select(*(new[c].alias(c) for c in docs.columns))
