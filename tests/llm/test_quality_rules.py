import re
from collections import Counter

from llm_helpers import prose

from forumlens.llm import quality_rules as Q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(8)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def test_measurements_equal_brute_force(documents, awkward):
    rows = [*awkward, (20, "a b c d e f g h " * 9), (21, prose(1, 30) + "\n" + prose(1, 30) + "\n\n \n" + prose(2, 5)), (22, "x\x85y\xa0z \x1cq # * <b> | &"), (23, "w " * 8), (24, "w " * 9)]
    got = sorted(((r.doc_id, {k: r[k] for k in brute("")}) for r in Q.ledger(documents(rows)).collect()), key=str)
    assert got == sorted(((i, brute(t)) for i, t in rows), key=str)


def test_verdicts(documents, awkward):
    good = prose(3, 80)
    rows = [*awkward, (30, good), (31, " | ".join(good.split())), (32, good.upper().replace(" ", "!! "))]
    out = {r.doc_id: r for r in Q.judged(Q.ledger(documents(rows))).collect() if r.doc_id}
    assert out[30].kept and not out[30].base_failed and out[30].failure_bits == 0
    assert not out[31].kept and not out[31].base_failed and out[31].failure_bits == Q.BIT["symbols"]
    assert not out[32].kept and out[32].failure_bits == Q.BIT["shouting"]
    assert out[1].base_failed and not out[1].kept
    v1 = {r.doc_id: r.kept for r in Q.judged(Q.ledger(documents(rows)), "v1").collect()}
    assert v1[31] and v1[32], "the older policy has no such rules"
    assert Q.ledger(documents([])).collect() == []


def test_ablations_follow_from_the_ledger(documents, awkward):
    book = Q.ledger(documents([*awkward, (30, prose(3, 80)), (31, " | ".join(prose(3, 80).split()))])).cache()
    rows = book.collect()
    for r in Q.ablations(book).collect():
        mask, bit = Q.mask_of(r.policy), Q.BIT[r.rule]
        hit = [x.failure_bits & mask for x in rows]
        assert r.n_failed == sum(h & bit != 0 for h in hit)
        assert r.n_only == sum(h == bit for h in hit)
        assert r.n_kept_without == sum(h & ~bit == 0 for h in hit)
    assert Q.ablations(Q.ledger(documents([]))).collect() == [] and Q.judged(Q.ledger(documents([]))).collect() == []


def test_no_python_in_the_plan(documents):
    plan = Q.judged(Q.ledger(documents([(1, "a")])))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan.replace("Exchange RoundRobin", "")
