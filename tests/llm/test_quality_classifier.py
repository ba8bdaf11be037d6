import random
import re
from collections import Counter

import numpy as np
from llm_helpers import prose

from forumlens.llm import quality_classifier as Q


def corpus(n=240):
    """Clean, junk and toxic texts, the last in part of words that only the labels can teach."""
    rows, labels = [], []
    for i in range(n):
        r, text = random.Random(i), prose(i, 60 + i % 50)
        kind = ("clean", "clean", "clean", "symbols", "shout", "repeat", "insult", "taught")[i % 8]
        if kind == "symbols":
            text = " ".join(w + r.choice(["###", "%%%", "***"]) for w in text.split())
        elif kind == "shout":
            text = text.upper().replace(" ", "!! ")
        elif kind == "repeat":
            text = " ".join(w for w in text.split()[:8] for _ in range(12))
        elif kind in ("insult", "taught"):
            words = ["idiot", "moron", "stupid", "loser", "trash", "scum"] if kind == "insult" else [f"grzyk{r.choice('abcdefgh')}{r.choice('xyz')}" for _ in range(6)]
            w = text.split()
            for x in r.sample(words, 4):
                w.insert(r.randrange(len(w)), x)
            text = " ".join(w)
        rows.append((i, text))
        labels.append((i, int(kind not in ("symbols", "shout", "repeat")), int(kind in ("insult", "taught"))))
    return rows, labels


def test_held_out_accuracy(documents, spark):
    rows, labels = corpus()
    known = spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in Q.classify(documents(rows), known).collect()}
    wrong = [i for i, q, t in labels if i % 3 == 0 and out[i].rejected != (q == 0 or t == 1)]
    assert len(wrong) <= 1
    assert all(not out[i].rejected for i, q, t in labels if q and not t), "clean texts stay"


def test_awkward_rows(documents, spark, awkward):
    rows, labels = corpus(160)
    table = spark.createDataFrame([*labels, (1000, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    docs = documents([(i and i + 1000, t) for i, t in awkward] + rows)
    out = Q.classify(docs, table)
    assert out.columns == [*[c for c in docs.columns if c != "rejected"], "junk_score", "junk_posterior", "toxic_score", "toxic_posterior", "rejected"]
    got = out.collect()
    assert len(got) == docs.count()
    assert all(r.rejected for r in got if not (r.text or "").strip()), "texts without words are junk"
    kept = Q.accepted(docs, table)
    assert kept.columns == docs.columns and kept.count() == sum(not r.rejected for r in got)
    by_text = {}
    for r in got:
        by_text.setdefault(r.text, set()).add((r.junk_score, r.toxic_score))
    assert all(len(v) == 1 for v in by_text.values())


def test_empty_tables(documents, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert Q.classify(documents([]), none).collect() == []
    assert Q.classify(documents([]), None).collect() == []
    assert Q.classify(documents([(1, prose(1, 50)), (2, "a")]), none).count() == 2


def test_expectation_maximisation_finds_the_accuracies():
    r = np.random.default_rng(0)
    truth = r.random(20_000) < 0.2
    votes = np.stack([np.where(r.random(20_000) < p, truth, ~truth) for p in (0.9, 0.8, 0.7, 0.85)], axis=1).astype(int)
    patterns, index, count = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    q = Q.expectation_maximisation(patterns, count.astype(float))[index.ravel()]
    best = np.mean((votes.mean(axis=1) > 0.5) == truth)
    assert np.mean((q > 0.5) == truth) >= best
    assert abs(q.mean() - 0.2) < 0.03


def test_training_learns_and_stays_sparse():
    r = np.random.default_rng(1)
    rows = [np.unique(r.integers(0, 2000, 30)) for _ in range(1500)]
    y = np.array([float(i % 3 == 0) for i in range(1500)])
    rows = [np.unique(np.append(x, 5000)) if t else x for x, t in zip(rows, y)]
    w = Q.train(rows, y)
    assert w[5000] > 2 and np.mean([(w[x].sum() + w[-1] > 0) == t for x, t in zip(rows, y)]) > 0.99
    assert (w != 0).sum() < 1500


LANGUAGES = {"en": ("sh", "th", "w", "ee"), "de": ("sch", "ü", "tz", "ei"), "fr": ("é", "eau", "qu", "oi"), "es": ("ñ", "ll", "ía", "rr")}


def in_language(lang, seed, n, toxic=0):
    """n words of 4,000 of a language's own, with so many of its 12 marked ones among every 100."""
    r, parts = random.Random(seed), LANGUAGES[lang]
    words = [f"{parts[k % 4]}{'aeiou'[k // 4 % 5]}{'bdfgkmnprt'[k // 20 % 10]}{'aeiou'[k // 200 % 5]}{parts[k // 1000]}" for k in range(4000)]
    out = r.choices(words, k=n)
    for at in range(0, n, 100):
        for k in r.sample(range(12), toxic):
            out[r.randrange(at, min(at + 100, n))] = f"{'bcdfghjklmnp'[k]}yx{parts[0]}"
    return " ".join(out)


def test_long_texts_are_judged_like_short_ones(documents, spark):
    short = [(lang, i, (0, 0, 0, 6)[i % 4]) for lang in LANGUAGES for i in range(100)]
    rows = [(k, in_language(lang, f"{lang}{i}", 100, toxic)) for k, (lang, i, toxic) in enumerate(short)]
    known = spark.createDataFrame([(k, 1, int(toxic > 0)) for k, (_, _, toxic) in enumerate(short)], "doc_id long, quality int, toxic int")
    long, want = [], {}
    for lang in LANGUAGES:
        clean = [in_language(lang, f"{lang}-long{k}", 10_000) for k in range(2)]
        for text, toxic in ((" ".join(clean), False), (in_language(lang, f"{lang}-toxic", 20_000, 6), True), (" ".join([clean[0], in_language(lang, f"{lang}-part", 100, 8), clean[1]]), True)):
            want[1000 + len(long)] = toxic
            long.append((1000 + len(long), text))
    out = {r.doc_id: r for r in Q.classify(documents(rows + long), known).collect()}
    assert {i: out[i].rejected for i in want} == want


def test_worst_stretch_is_that_of_a_plain_count():
    r = np.random.default_rng(3)
    sizes = [0, 40, Q.STRETCH, Q.STRETCH + 1, 2 * Q.STRETCH, 5000, 20_011]
    texts = [r.integers(0, 400, n) for n in sizes]
    odds = np.where(np.arange(400) % 40 == 0, np.arange(400) / 100, 0)
    h, doc = np.concatenate(texts).astype(np.uint64), np.repeat(np.arange(len(sizes)), sizes)
    one = Q.distinct_words(h, doc)
    got = Q.worst_stretch(odds[h[one].astype(int)], one, h, doc, np.array(sizes))
    for text, found in zip(texts, got):
        starts = [0] if len(text) <= Q.STRETCH else range(0, len(text) - Q.STRETCH // 2, Q.STRETCH // 2)
        want = max(odds[np.unique(text[k : k + Q.STRETCH])].sum() for k in starts) - np.log(len(starts))
        assert abs(found - max(want, 0)) < 1e-9


def test_all_marks_are_learned(documents, spark):
    marks = [f"{k:03d}insulting".translate(str.maketrans("0123456789", "abcdefghij")) for k in range(900)]
    rows = [(i, " ".join([prose(i, 20), *(marks if i < 6 else [])])) for i in range(200)]
    known = spark.createDataFrame([(i, 1, int(i < 6)) for i, _ in rows], "doc_id long, quality int, toxic int")
    learned = Q.learned_marks(documents(rows), known, 6000)
    assert len(learned.hashes) == 6 * 900 and set(Q.lexicon(marks)) <= set(learned.hashes)


def plain_votes(text):
    """The labellers, one text at a time: votes of both aspects, style measures and distinct words."""
    raw = (text or "").encode()
    words = re.findall(rb"[0-9a-z\x80-\xff]+", raw.lower())
    n, some = len(words), max(len(words), 1)
    count = lambda chars: sum(raw.count(bytes([c])) for c in chars)
    upper, lower = count(range(0x41, 0x5B)), count(range(0x61, 0x7B))
    m = {"symbols": count(b"#*$%&|<>") / some, "bars": raw.count(b"|") / some, "marks": raw.count(b"!") / some, "upper": upper / max(upper + lower, 1)}
    m["again"] = sum(a == b for a, b in zip(words, words[1:])) / some
    m["same"] = 1 - len(set(words)) / some if n >= 50 else 0.0
    bad = [m["symbols"] > 0.3, m["bars"] > 0.3, m["marks"] > 0.3, m["upper"] > 0.5, m["again"] > 0.2, m["same"] > 0.9, n == 0]
    calm = m["symbols"] < 0.1 and m["marks"] < 0.1 and m["upper"] < 0.3 and m["again"] <= 0.2 and n > 0
    insults = sorted((int(Q.lexicon([w])[0]), w.encode()) for w in Q.INSULTS)
    first, second = (sum(w in words for _, w in insults[k::2]) for k in (0, 1))
    toxic = [first > 0, second > 0, first + second > 1, False]
    vote = lambda flags, good: [*(Q.BAD if f else Q.NONE for f in flags), Q.GOOD if good else Q.NONE]
    return {"junk": vote(bad, calm), "toxic": vote(toxic, first + second == 0)}, [*m.values(), 0.0], set(words)


def plain_em(patterns):
    """Counter of vote patterns -> posterior of bad, by loops over patterns, labellers and votes."""
    total = sum(patterns.values())
    q = {p: (0.5 if Q.GOOD in p else 0.95) if Q.BAD in p else 0.02 if Q.GOOD in p else 0.2 for p in patterns}
    for _ in range(200):
        weight = {p: (n * (1 - q[p]), n * q[p]) for p, n in patterns.items()}
        prior = [(sum(w[y] for w in weight.values()) + 1) / (total + 2) for y in (0, 1)]
        new = {}
        for p in patterns:
            log = [np.log(x) for x in prior]
            for k, v in enumerate(p):
                for y in (0, 1):
                    rate = [sum(w[y] for o, w in weight.items() if o[k] == vote) + 0.1 for vote in (Q.GOOD, Q.BAD, Q.NONE)]
                    log[y] += np.log(rate[v] / sum(rate))
            new[p] = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        change, q = max(abs(new[p] - q[p]) for p in q), new
        if change < 1e-9:
            break
    mean = sum(n * q[p] for p, n in patterns.items()) / total
    return {p: q[p] if set(p) != {Q.NONE} else mean for p in q}


def test_equals_a_plain_version(documents, awkward):
    """Votes, posteriors and scores of every document, computed one text at a time."""
    rows = corpus(160)[0] + [(i and i + 1000, t) for i, t in awkward]
    docs = documents(rows)
    model = Q.fit(docs)
    got = Counter((r.doc_id, round(r.junk_posterior, 6), round(r.toxic_posterior, 6), round(r.junk_score, 6), round(r.toxic_score, 6), r.rejected) for r in Q.classify(docs).collect())
    plain = [(i, *plain_votes(t)) for i, t in rows]
    posterior = {a: plain_em(Counter(tuple(votes[a]) for _, votes, _, _ in plain)) for a in Q.ASPECTS}
    want = Counter()
    for i, votes, measures, words in plain:
        score = {}
        for aspect in Q.ASPECTS:
            slots = {int(Q.lexicon([w.decode()])[0]) % Q.BUCKETS for w in words}
            slots |= {Q.BUCKETS + 10 * k + min(int(x * 10), 9) for k, x in enumerate(measures)}
            slots |= {Q.BUCKETS + 10 * len(measures) + 3 * k + v for k, v in enumerate(votes[aspect])}
            w = model.weights[aspect]
            score[aspect] = 1 / (1 + np.exp(-np.clip(sum(w[s] for s in slots) + w[-1], -30, 30)))
        want[i, *(round(posterior[a][tuple(votes[a])], 6) for a in Q.ASPECTS), *(round(float(score[a]), 6) for a in Q.ASPECTS), any(s >= 0.5 for s in score.values())] += 1
    assert got == want
