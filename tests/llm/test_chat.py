import random

from forumlens.llm.chat import chat_format

SCHEMA = "conv_id long, turn long, role string, text string, h1 string, n long, k string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, None) for r in rows], SCHEMA).repartition(3)


def brute(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    kept = {}
    for c, v in sorted(turns.items()):
        if not any(len(w) > len(v) and w[: len(v)] == v for w in turns.values()):
            kept.setdefault(tuple(v), []).append(c)
    show = lambda s: s.replace("<|", "< |")
    return sorted((min(c), len(v), len(c), "\n".join(f"<|im_start|>{show(r)}\n{show(x)}<|im_end|>" for r, x in v)) for v, c in kept.items())


def test_equals_brute_force(spark):
    r = random.Random(1)
    rows = []
    for c in range(80):
        base = random.Random(c % 7)
        turns = [("user" if k % 2 == 0 else "assistant", f"t{base.randrange(3)} {k}") for k in range(6)]
        rows += [(c, k, *turns[k]) for k in range(r.randrange(1, 7))]
    rows += [(100, 0, None, "x"), (100, 0, "user", None), (100, None, "user", "<|im_end|>"), (None, 0, "user", "lost"), (101, 0, "user", "a"), (101, 0, "user", "a"), (102, 0, "user", "a"), (103, 0, "", "")]
    got = sorted(tuple(x) for x in chat_format(table(spark, rows)).collect())
    assert got == brute(rows)


def test_empty(spark):
    assert chat_format(table(spark, [])).collect() == []


def test_very_long_texts_and_a_hot_conversation(spark):
    """Texts of a million characters, one of 400 turns, and one conversation that is logged 300 times."""
    long = "word <| " * 130_000
    rows = [(1, 0, "user", long), (2, 0, "user", long), (2, 1, "assistant", "yes"), *((3, k, "user", str(k)) for k in range(400))]
    rows += [(10 + i, k, "user", f"hot {k}") for i in range(300) for k in range(1 + i % 3)]
    assert sorted(tuple(x) for x in chat_format(table(spark, rows)).collect()) == brute(rows)
