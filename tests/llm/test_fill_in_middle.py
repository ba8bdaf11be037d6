import random
import re
from hashlib import sha256

from llm_helpers import prose
from pyspark.sql import functions as F

from forumlens.llm import fill_in_middle as M


def brute(doc_id, text, plain=10, spm=20):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digest = sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 100 - plain:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def random_text(r):
    return "".join(r.choice("abzAZ@[`{ \n\x00<>PSM019é日😀́") for _ in range(r.randrange(0, 200)))


def test_boundaries_and_ranks_equal_a_plain_scan():
    r = random.Random(1)
    for _ in range(300):
        text = random_text(r)
        starts = [m.start() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text)]
        size, bits = M.boundaries(text.encode())
        assert size == len(text) and bits.bit_count() == len(starts)
        assert [M.ranked(bits, size, k) for k in range(len(starts) + 2)] == [*starts, size, size]


def test_equals_brute_force_and_restores(documents, awkward):
    r = random.Random(2)
    rows = [*awkward, *((100 + k, random_text(r)) for k in range(300)), (-5, prose(3, 40)), (500, "has <M> inside"), (501, "<<S <P"), (502, "a"), (503, "word " * 100_000)]
    out = M.fill_in_middle(documents(rows)).withColumn("back", M.restored(F.col("output"), F.col("form"))).collect()
    got = sorted(((x.doc_id, x.text, (x.n, x.form, x.prefix_chars, x.middle_chars, x.output)) for x in out), key=str)
    assert got == sorted(((i, t, brute(i, t)) for i, t in rows), key=str)
    assert all(x.back == (x.text or "") for x in out)
    assert {x.form for x in out} == {"plain", "psm", "spm"}


def test_shares_are_parameters(documents):
    rows = [(k, prose(k, 12)) for k in range(200)]
    out = M.fill_in_middle(documents(rows), plain=0, spm=100)
    assert {x.form for x in out.collect()} == {"spm"}
    assert {x.form for x in M.fill_in_middle(documents(rows), plain=100).collect()} == {"plain"}
    forms = [brute(*x)[1] for x in rows]
    assert 5 < forms.count("plain") < 40 and 15 < forms.count("spm") < 60


def test_columns_of_any_name_are_carried_or_replaced(spark):
    docs = spark.createDataFrame([(1, "some text", "old", 7, "c")], "doc_id long, text string, Form string, x0 int, c0 string")
    [row] = M.fill_in_middle(docs).collect()
    assert row.x0 == 7 and row.c0 == "c" and row.form in ("plain", "psm", "spm") and "Form" not in row.asDict()
    assert M.fill_in_middle(docs.where("doc_id = 2")).collect() == []


def test_bytes_that_are_not_utf8(spark):
    docs = spark.sql("select 4L as doc_id, cast(x'61ff62' as string) as text")
    [row] = M.fill_in_middle(docs, plain=100).select("n", "output").collect()
    assert (row.n, row.output) == (3, "a�b")
