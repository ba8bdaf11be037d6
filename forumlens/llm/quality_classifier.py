"""Quality classifier: a weak-label model over heuristic labellers trains hashed linear scorers.

Two aspects are judged alike: junk (tables, symbol noise, shouting, repetition) and toxic (abuse).
1. Overlapping labellers vote good, bad or nothing on every document. The votes of all documents are
   counted by pattern (a few hundred rows at most), and expectation-maximisation estimates each
   labeller's rates and every pattern's posterior from these counts.
   The junk labellers read style alone. The toxic ones look for insults of a fixed list and for words that a bounded
   sample of labelled rows (`toxic`) marks; the labels' `quality` is not used, and is left for judging results.
2. The posteriors of a bounded sample label it; a sparse logistic scorer (follow the regularised leader,
   L1) is trained on hashed words, style measures in bins, and votes.
3. One pass scores every document; it is rejected where either score reaches one half.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_column, carried, only, prepare, slices, spread, stage, word_hashes

# Insults that the lexicon labellers look for, in four languages. The labelled sample adds words to them.
INSULTS = [
    # English
    "clown", "crap", "disgusting", "dumb", "fool", "garbage", "idiot", "imbecile", "loser", "moron",
    "pathetic", "pig", "scum", "stupid", "trash", "ugly", "vermin", "worthless",
    # French
    "abruti", "connard", "crétin", "débile", "imbécile", "minable", "ordure", "salaud", "stupides", "vermine",
    # German
    "abschaum", "arschloch", "blödmann", "dummkopf", "drecksau", "miststück", "trottel", "ungeziefer", "versager", "widerlich",
    # Spanish
    "asqueroso", "cretino", "escoria", "estúpido", "gilipollas", "idiota", "imbécil", "inútil", "patético", "tonto",
]
GOOD, BAD, NONE = 0, 1, 2
BUCKETS = 1 << 18
ASPECTS = ("junk", "toxic")

#: Bytes of words (letters, digits, all of non-ASCII), and lower case of ASCII.
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
CLASS = {"symbol": b"#*$%&|<>", "upper": bytes(range(0x41, 0x5B)), "lower": bytes(range(0x61, 0x7B)), "mark": b"!", "bar": b"|", "space": b" \t\n\x0b\x0c\r"}


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[offsets[1:]] - total[offsets[:-1]]


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and document number of each lower-case word, its start and end, and the lower-case bytes."""
    low = LOWER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    solid = WORD[low]
    starts, ends = solid.copy(), solid.copy()
    starts[1:] &= ~solid[:-1] | edge[1:-1]
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return word_hashes(low, s, e), np.searchsorted(offsets, s, side="right") - 1, s, e, low


def distinct_words(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Places of one occurrence of each word of a document."""
    order = np.lexsort((h, doc))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    return np.sort(order[new])


#: Lengths in bytes of the word beginnings that may mark a document, besides whole words.
BEGINNINGS = (4, 5, 6, 7, 8)


def marks_of(h: np.ndarray, s: np.ndarray, e: np.ndarray, low: np.ndarray):
    """(places, hashes) of the whole words and then of each length of their proper beginnings."""
    yield np.arange(len(h)), h
    for k in BEGINNINGS:
        at = np.flatnonzero(e - s > k)
        yield at, word_hashes(low, s[at], s[at] + k)


def lexicon(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    return np.sort(hashed_words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))[0])


#: Learned evidence (summed log-odds of different words) of a stretch of text that makes a document toxic,
#: and below which it counts as none. A stretch has STRETCH words at most and starts every half of that.
MUCH, LITTLE, STRETCH = 9.0, 4.5, 1500


@dataclass
class Marks:
    """Words and word beginnings that the labelled sample found typical of toxic documents, by hash, with log-odds."""

    hashes: np.ndarray
    odds: np.ndarray

    def evidence(self, h: np.ndarray, s: np.ndarray, e: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Of each word, the largest log-odds among the word and its beginnings."""
        out = np.zeros(len(h))
        if not len(self.hashes) or not len(h):
            return out
        for at, mark in marks_of(h, s, e, low):
            i = np.minimum(np.searchsorted(self.hashes, mark), len(self.hashes) - 1)
            out[at] = np.maximum(out[at], np.where(self.hashes[i] == mark, self.odds[i], 0))
        return out


def worst_stretch(evidence: np.ndarray, one: np.ndarray, h: np.ndarray, doc: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Of each document, the most evidence that one stretch of it holds, each word counting once a stretch.

    The most of k stretches exceeds what one has by chance, at summed log-odds by log k: that is taken off.
    evidence is that of the words at places `one`, one occurrence of each word of a document; h and doc are of all words.
    """
    n = len(words)
    out = np.bincount(doc[one], evidence, n) if len(one) else np.zeros(n)
    marked = evidence > 0
    long = (words > STRETCH) & (out > 0)
    if not long.any():
        return out
    keys, first = np.unique(h[one][marked], return_index=True)
    odds = evidence[marked][first]
    at = np.flatnonzero(long[doc])
    key = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
    hit = keys[key] == h[at]
    at, key = at[hit], key[hit]
    half = STRETCH // 2
    block = (at - (np.cumsum(words) - words)[doc[at]]) // half
    last = np.maximum(-(-words // half) - 2, 0)  # the document's last stretch
    stretch = np.concatenate([np.minimum(block, last[doc[at]]), np.maximum(block - 1, 0)])
    found = np.unique(np.stack([np.tile(doc[at], 2), stretch, np.tile(key, 2)]), axis=1)
    new = np.ones(found.shape[1], bool)
    new[1:] = (found[:2, 1:] != found[:2, :-1]).any(axis=0)
    start = np.flatnonzero(new)
    worst = np.zeros(n)
    np.maximum.at(worst, found[0, start], np.add.reduceat(odds[found[2]], start))
    return np.where(long, np.maximum(worst - np.log(last + 1), 0), out)


NO_MARKS = Marks(np.zeros(0, np.uint64), np.zeros(0))


@dataclass
class Votes:
    """Per document: votes [n, labellers] of each aspect, style bins [n, k], and its words."""

    votes: dict[str, np.ndarray]
    bins: np.ndarray
    words: np.ndarray
    doc: np.ndarray


def labelled(column: pa.Array, learned: Marks) -> Votes:
    data, offsets = binary_column(column)
    n = len(offsets) - 1
    h, doc, s, e, low = hashed_words(data, offsets)
    share = {}
    for name, chars in CLASS.items():
        is_in = np.zeros(256, bool)
        is_in[np.frombuffer(chars, np.uint8)] = True
        share[name] = _per_doc(is_in[data], offsets)
    words = np.bincount(doc, minlength=n)
    some = np.maximum(words, 1)
    again = np.bincount(doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], minlength=n) / some if len(h) else np.zeros(n)
    one = distinct_words(h, doc)
    taught = worst_stretch(learned.evidence(h[one], s[one], e[one], low), one, h, doc, words)
    h, doc = h[one], doc[one]
    distinct = np.bincount(doc, minlength=n) / some
    measures = {
        "symbols": share["symbol"] / some,
        "bars": share["bar"] / some,
        "marks": share["mark"] / some,
        "upper": share["upper"] / np.maximum(share["upper"] + share["lower"], 1),
        "again": again,
        "same": np.where(words >= 50, 1 - distinct, 0),
    }
    bad = [measures["symbols"] > 0.3, measures["bars"] > 0.3, measures["marks"] > 0.3, measures["upper"] > 0.5, measures["again"] > 0.2, measures["same"] > 0.9, words == 0]
    calm = (measures["symbols"] < 0.1) & (measures["marks"] < 0.1) & (measures["upper"] < 0.3) & (measures["again"] <= 0.2) & (words > 0)
    junk = [np.where(x, BAD, NONE) for x in bad] + [np.where(calm, GOOD, NONE)]
    insults = lexicon(INSULTS)

    def hits(of: np.ndarray) -> np.ndarray:
        found = of[np.minimum(np.searchsorted(of, h), len(of) - 1)] == h if len(of) and len(h) else np.zeros(len(h), bool)
        return np.bincount(doc[found], minlength=n)

    first, second = hits(insults[::2]), hits(insults[1::2])
    toxic = [np.where(first > 0, BAD, NONE), np.where(second > 0, BAD, NONE), np.where(first + second > 1, BAD, NONE), np.where(taught >= MUCH, BAD, NONE), np.where((first + second == 0) & (taught < LITTLE), GOOD, NONE)]
    measures["taught"] = np.minimum(taught / np.maximum(10, 0.01 * np.minimum(words, STRETCH)), 0.99)
    bins = np.stack([np.minimum((x * 10).astype(np.int64), 9) for x in measures.values()], axis=1) if n else np.zeros((0, len(measures)), np.int64)
    return Votes({"junk": np.stack(junk, axis=1), "toxic": np.stack(toxic, axis=1)}, bins, h, doc)


def expectation_maximisation(votes: np.ndarray, count: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Posterior of bad for each vote pattern; count says how many documents have it."""
    good, bad = (votes == GOOD).sum(axis=1), (votes == BAD).sum(axis=1)
    q = np.where(bad > 0, np.where(good > 0, 0.5, 0.95), np.where(good > 0, 0.02, 0.2))
    for _ in range(rounds):
        w = np.stack([count * (1 - q), count * q])
        prior = (w.sum(axis=1) + 1) / (count.sum() + 2)
        log = np.log(prior)[:, None] + np.zeros((2, len(q)))
        for v in votes.T:
            rate = np.stack([[(w[y] * (v == k)).sum() for k in (GOOD, BAD, NONE)] for y in (0, 1)]) + 0.1
            rate /= rate.sum(axis=1, keepdims=True)
            log += np.log(rate[:, v])
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        if np.abs(new - q).max() < 1e-9:
            break
        q = new
    return np.where(good + bad > 0, q, (count * q).sum() / max(count.sum(), 1))  # without a vote there is the prior only


def features(found: Votes, aspect: str) -> tuple[np.ndarray, np.ndarray]:
    """(document, slot) of each active feature: hashed words, then style bins, then votes; slots of a document are distinct."""
    n, k = found.bins.shape
    slot = (found.words % np.uint64(BUCKETS)).astype(np.int64)
    pair = np.unique(found.doc.astype(np.int64) * BUCKETS + slot)
    doc, slot = [pair // BUCKETS], [pair % BUCKETS]
    votes = found.votes[aspect]
    doc += [np.repeat(np.arange(n), k), np.repeat(np.arange(n), votes.shape[1])]
    slot += [(BUCKETS + np.arange(k) * 10 + found.bins).ravel(), (BUCKETS + 10 * k + np.arange(votes.shape[1]) * 3 + votes).ravel()]
    doc, slot = np.concatenate(doc), np.concatenate(slot)
    order = np.argsort(doc, kind="stable")
    return doc[order], slot[order]


SLOTS = BUCKETS + 1024


def train(rows: list[np.ndarray], target: np.ndarray, epochs: int = 3, alpha: float = 0.2, l1: float = 1.0, l2: float = 1.0) -> np.ndarray:
    """Sparse logistic weights (the last one is the bias) by the follow-the-regularised-leader rule."""
    z, n = np.zeros(SLOTS), np.zeros(SLOTS)

    def weight(i):
        w = -(z[i] - np.sign(z[i]) * l1) / ((1 + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(z[i]) <= l1, 0.0, w)

    for _ in range(epochs):
        for slots, y in zip(rows, target):
            i = np.append(slots, SLOTS - 1)
            w = weight(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - s * w
            n[i] += g * g
    return weight(np.arange(SLOTS))


def _sampled(docs: DataFrame, share: float, salt: int) -> DataFrame:
    """About that share of the documents, the same ones at every run: by hash of id and text."""
    if share >= 1:
        return docs
    return docs.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(salt)), F.lit(1 << 30)) < int(share * (1 << 30)))


def learned_marks(docs: DataFrame, labels: DataFrame, bound: int) -> Marks:
    """Marks of toxic documents from about `bound` labelled rows at most, equal texts counting once.

    A word or word beginning is a mark if at least 5 toxic texts and 1.5 % of them have it, and it is 16 times
    as frequent there as elsewhere; its weight is its smoothed log-odds, 5 at most.
    """
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = known.count()
    if not total:
        return NO_MARKS
    # about `bound` ids: small enough to broadcast by that parameter
    picked = known.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < int(min(1.0, bound / total) * (1 << 30)))
    texts = only(docs, doc_id="long", text="string").join(F.broadcast(picked), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))
    texts = stage(texts, "labelled")

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", 1 << 19):
                h, doc, s, e, low = hashed_words(*binary_column(batch.column("text")))
                one = distinct_words(h, doc)
                h, doc, s, e = h[one], doc[one], s[one], e[one]
                found = [(doc[at], mark) for at, mark in marks_of(h, s, e, low)]
                doc, mark = np.concatenate([d for d, _ in found]), np.concatenate([m for _, m in found])
                one = distinct_words(mark, doc)
                toxic = batch.column("toxic").to_numpy(zero_copy_only=False)[doc[one]]
                yield pa.RecordBatch.from_arrays([pa.array(mark[one].view(np.int64)), pa.array(toxic.astype(np.int32))], names=["mark", "toxic"])

    sizes = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = max(sizes.get(1, 0), 1), max(sizes.get(0, 0), 1)
    count = texts.mapInArrow(run, "mark long, toxic int").groupBy("mark").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    count = count.where((F.col("a") >= max(5, 0.015 * n1)) & (F.col("a") * n0 >= 16 * n1 * F.col("b")))
    top = count.collect()  # without a limit: at 1.5 % they are at most the words and beginnings of 67 mean toxic texts
    hashes = np.array([r["mark"] for r in top], np.int64).view(np.uint64)
    a, b = (np.array([r[c] for r in top], float) for c in "ab")
    odds = np.clip(np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1)), 0, 5)
    order = np.argsort(hashes)
    return Marks(hashes[order], odds[order])


@dataclass
class Model:
    learned: Marks
    patterns: dict[str, dict[int, float]]
    weights: dict[str, np.ndarray]

    def scored(self, column: pa.Array) -> list[pa.Array]:
        found = labelled(column, self.learned)
        n = len(column)
        out, reject = [], np.zeros(n, bool)
        for aspect in ASPECTS:
            doc, slot = features(found, aspect)
            w = self.weights[aspect]
            p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, w[slot], n) + w[-1], -30, 30))) if n else np.zeros(0)
            code = _codes(found.votes[aspect])
            out += [pa.array(p), pa.array([self.patterns[aspect].get(int(c), 0.5) for c in code], pa.float64())]
            reject |= p >= 0.5
        return [*out, pa.array(reject)]


def _codes(votes: np.ndarray) -> np.ndarray:
    return (votes * 3 ** np.arange(votes.shape[1])).sum(axis=1)


def _decoded(code: np.ndarray, n: int) -> np.ndarray:
    return np.stack([code // 3**i % 3 for i in range(n)], axis=1)


def fit(docs: DataFrame, labels: DataFrame | None = None, *, sample: int = 6000, labelled_sample: int = 20_000) -> Model:
    """Fit on docs(doc_id, text). Votes are counted over all documents; `sample` bounds the scorer's training documents (about
    so many, drawn by hash over all documents, never more than twice as many) and `labelled_sample` the labelled rows that
    teach the vocabulary (about so many)."""
    prepare(docs.sparkSession)
    texts = only(docs, doc_id="long", text="string")
    learned = learned_marks(texts, labels, labelled_sample) if labels is not None else NO_MARKS

    def vote(batches):
        for whole in batches:
            for batch in slices(whole, "text", 1 << 19):
                found = labelled(batch.column("text"), learned)
                yield pa.RecordBatch.from_arrays([pa.array(_codes(found.votes[a])) for a in ASPECTS], names=list(ASPECTS))

    counts = spread(texts.select("text")).mapInArrow(vote, "junk long, toxic long").groupBy(*ASPECTS).agg(F.count("*").alias("n")).orderBy(*ASPECTS).toPandas()
    patterns = {}
    for aspect, width in zip(ASPECTS, (8, 5)):
        by = counts.groupby(aspect)["n"].sum()
        code, n = by.index.to_numpy(np.int64), by.to_numpy(float)
        q = expectation_maximisation(_decoded(code, width), n) if len(code) else np.zeros(0)
        patterns[aspect] = dict(zip(code.tolist(), q.tolist()))
    total = int(counts["n"].sum())

    def drawn(batches):
        for whole in batches:
            for batch in slices(whole, "text", 1 << 19):
                found = labelled(batch.column("text"), learned)
                cells = [batch.column("key")]
                for aspect in ASPECTS:
                    doc, slot = features(found, aspect)
                    at = np.searchsorted(doc, np.arange(batch.num_rows + 1))
                    cells += [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(slot.astype(np.int32))), pa.array(_codes(found.votes[aspect]))]
                yield pa.RecordBatch.from_arrays(cells, names=["key", "junk", "junk_code", "toxic", "toxic_code"])

    some = _sampled(texts, sample / max(total, 1), 3).select("text", F.xxhash64("doc_id", "text").alias("key"))
    rows = some.mapInArrow(drawn, "key long, junk array<int>, junk_code long, toxic array<int>, toxic_code long").orderBy("key").limit(2 * sample).toArrow()
    weights = {}
    for aspect in ASPECTS:
        target = np.array([patterns[aspect].get(c, 0.5) for c in rows.column(f"{aspect}_code").to_pylist()])
        slots = rows.column(aspect).combine_chunks()
        flat, at = slots.values.to_numpy(), slots.offsets.to_numpy()
        weights[aspect] = train([flat[a:b] for a, b in zip(at, at[1:])], target)
    return Model(learned, patterns, weights)


def classify(docs: DataFrame, labels: DataFrame | None = None, **bounds: int) -> DataFrame:
    """docs(doc_id, text, ...) -> docs with junk_score, junk_posterior, toxic_score, toxic_posterior, rejected.

    Null and empty texts have no words: a labeller of its own calls them junk. Ties at one half reject.
    Equal texts get equal scores. Texts of any length are read whole. A null doc_id is kept, extra
    columns are carried along, and an empty table gives no rows. labels(doc_id, quality, toxic) may be
    missing or empty; of repeated label rows the toxic one counts.
    """
    model = fit(docs, labels, **bounds)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return carried(docs, [("junk_score", "double"), ("junk_posterior", "double"), ("toxic_score", "double"), ("toxic_posterior", "double"), ("rejected", "boolean")], lambda column: shared.value.scored(column))


def accepted(docs: DataFrame, labels: DataFrame | None = None, **bounds: int) -> DataFrame:
    """The documents, with their own columns only, that classify() does not reject."""
    model = fit(docs, labels, **bounds)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    flag = f"rejected_{uuid.uuid4().hex}"
    judged = carried(docs, [(flag, "boolean")], lambda column: shared.value.scored(column)[-1:])
    return judged.where(~F.col(flag)).drop(flag)
