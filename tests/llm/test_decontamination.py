import random

from llm_helpers import prose

from forumlens.llm import decontamination as D


def edit_distance(pattern, text):
    """Least distance of the pattern to any stretch of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (c != d)))
        row = now
    return min(row)


def test_bit_vectors_equal_the_table():
    r = random.Random(3)
    for _ in range(500):
        p = "".join(r.choice("abc") for _ in range(r.randrange(1, 90)))
        t = "".join(r.choice("abc") for _ in range(r.randrange(0, 60)))
        d, end = D.myers(D.peq(p), len(p), t, len(p))
        assert d == edit_distance(p, t)
        assert edit_distance(p, t[:end]) == d


def test_finds_just_what_brute_force_finds(documents, spark):
    r = random.Random(9)
    items = [(k, prose(500 + k, 30)) for k in range(8)]
    docs = []
    for k in range(60):
        text = list(items[k % 8][1])
        for _ in range(r.randrange(0, 30)):
            at = r.randrange(len(text))
            text[at] = r.choice(["", "q", text[at] + "q"])
        docs.append((k, prose(k, 20) + " " + "".join(text).upper() + "\n" + prose(k + 1000, 20)))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x for x in D.contaminated(documents(docs), table).collect()}
    for i, t in docs:
        for k, item in items:
            d = edit_distance(D.folded(item), D.folded(t))
            within = d <= int(0.08 * len(item))
            assert ((i, k) in got) == within
            if within:
                x = got[i, k]
                assert x.distance == d
                assert edit_distance(D.folded(item), D.folded(t)[x.start : x.end]) == d
    assert 10 < len(got) < 60


def test_blocks_of_items_agree(documents, spark):
    table = spark.createDataFrame([(k, prose(k, 25)) for k in range(6)] + [(None, "x"), (9, None), (10, " ")], "item_id long, text string")
    docs = documents([(k, prose(k, 25) + "!") for k in range(4)] + [(7, None), (8, ""), (None, prose(2, 25))])
    one, many = (sorted(map(str, D.contaminated(docs, table, block_chars=n).collect())) for n in (10**6, 100))
    assert one == many and len(one) == 5


def test_two_blocks_in_one_worker(documents, spark):
    """Blocks follow each other in the same worker process, also in a second run with other items of the same number."""
    docs = documents([(k, prose(k, 25) + "!") for k in range(6)]).coalesce(1)
    for ids in ((0, 1, 2, 3), (2, 3, 4, 5)):
        table = spark.createDataFrame([(k, prose(k, 25)) for k in ids], "item_id long, text string").coalesce(1)
        kept = D.decontaminate(docs, table, block_chars=2 * len(prose(ids[0], 25)))
        assert {r.doc_id for r in kept.collect()} == set(range(6)) - set(ids)
        assert {(r.doc_id, r.item_id) for r in D.contaminated(docs, table, block_chars=200).collect()} == {(k, k) for k in ids}


def test_matchers_are_kept_by_content():
    one, two = (D.Block([(1, t)], D.hashlib.sha256(t.encode()).hexdigest()) for t in ("a first text", "another text"))
    assert D.matcher(one, 0.08, 1) is D.matcher(D.Block(list(one.items), one.digest), 0.08, 1)
    assert next(D.matcher(two, 0.08, 1).matches("it is another text"))[0] == 1 and len(D._MATCHERS) == 1
    assert not list(D.matcher(one, 0.08, 20).matches("a first text"))


def test_decontaminate_keeps_clean_rows_whole(documents, spark, awkward):
    docs = documents([*awkward, (50, "Intro. " + prose(3, 25).upper() + " end")])
    table = spark.createDataFrame([(1, prose(3, 25)), (2, None)], "item_id long, text string")
    out = D.decontaminate(docs, table)
    assert out.columns == docs.columns
    assert out.count() == len(awkward) and out.where("doc_id = 50").count() == 0
    assert D.decontaminate(docs, table.limit(0)).count() == docs.count()
    assert D.contaminated(documents([]), table).collect() == []
