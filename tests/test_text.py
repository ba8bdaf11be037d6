import math
import random
import re

import pytest
from pyspark.sql import functions as F

from forumlens.functions import lexicon, text, vector


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values()) or (1,)], ", ".join(f"{k} string" for k in values) or "x int")
    return df.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(
    "given, holds, lacks",
    [
        ("Check this out https://example.org/r/test and www.example.com", ["check this out"], ["https://", "www."]),
        ("This is **bold** and *italic* text", ["bold", "italic"], ["*"]),
        ("~~removed text~~ kept text", ["removed text", "kept text"], ["~~"]),
        ("[click here](https://example.com)", ["click here"], ["[", "https://"]),
        ("> quoted line\nnormal line", ["normal line"], [">"]),
        ("Use `pip install` to install", ["pip install"], ["`"]),
        ("```\ncode\n```\nnormal text", ["normal text"], ["```", "code"]),
        ("UPPERCASE Text", ["uppercase text"], []),
        ("too   many    spaces\n\n\nnewlines", ["too many spaces newlines"], ["  ", "\n"]),
        ("# Head\ntext", ["head text"], ["#"]),
    ],
)
def test_clean(spark, given, holds, lacks):
    out = one(spark, text.clean(F.col("t")), t=given)
    assert all(h in out for h in holds) and not any(x in out for x in lacks)


def test_clean_of_nothing(spark):
    df = spark.createDataFrame([(None,), ("",)], "t string").select(text.clean(F.col("t")).alias("c"), text.token_count(text.clean(F.col("t"))).alias("n"))
    assert [tuple(r) for r in df.collect()] == [("", 0), ("", 0)]


def test_bots(spark):
    names = ["AutoModerator", "forum_bot", "news-bot", "SomeBot", "[deleted]", "[removed]", "", None, "jane_doe", "regular_user123"]
    rows = spark.createDataFrame([(n,) for n in names], "a string").select(text.is_bot(F.col("a")).alias("b")).collect()
    assert [r.b for r in rows] == [True] * 8 + [False] * 2


def test_tokens_and_reasons(spark):
    nine, ten = " ".join("a" * 9), " ".join("a" * 10)
    df = spark.createDataFrame([("x", nine), ("x", ten), ("x", ""), ("AutoModerator", ten)], "a string, t string")
    n = text.token_count(F.col("t"))
    assert [tuple(r) for r in df.select(n, text.filter_reason(F.col("a"), n)).collect()] == [(9, "too_short"), (10, None), (0, "empty"), (10, "bot")]


def test_raw_text(spark):
    df = spark.createDataFrame([(" T ", " body "), ("T", "[deleted]"), (None, "body"), ("", None), ("T", "  ")], "t string, c string")
    assert [r[0] for r in df.select(text.raw_text(F.col("t"), F.col("c"))).collect()] == ["T body", "T", "body", "", "T"]


def test_keyword_lists(spark):
    df = spark.createDataFrame([('["AI", "the", "ai", "Policy"]',), ("ai, Policy;of|x/y",), ("[broken",), (None,)], "k string")
    assert [r[0] for r in df.select(text.keywords(F.col("k"))).collect()] == [["ai", "policy"], ["ai", "policy", "x", "y"], ["broken"], None]
    df = spark.createDataFrame([('["a b", " c "]',), ("a b, c,,",)], "k string")
    assert [r[0] for r in df.select(text.parse_list(F.col("k"))).collect()] == [["a b", "c"]] * 2


def test_cluster_label(spark):
    df = spark.createDataFrame([(["the", "gpu", "ai", "ram", "disk", "cpu"],), (["the", "ok"],), ([],)], "k array<string>")
    assert [r[0] for r in df.select(text.cluster_label(F.col("k"))).collect()] == ["gpu / ram / disk", "Unlabeled cluster", "Unlabeled cluster"]


def test_lexical_score(spark):
    df = spark.createDataFrame([("open source local model benchmark",), ("open thread about coffee",), ("nothing here",), ("open model benchmark",)], "t string")
    q = "open model benchmark"
    df = df.select(text.search_terms(F.lit(q)).alias("a"), F.contains("t", F.lit(q)).alias("p"), text.search_terms(F.col("t")).alias("b"))
    scores = [r[0] for r in df.select(text.lexical_score(F.col("a"), F.col("p"), F.col("b"))).collect()]
    assert scores[0] == pytest.approx(0.6) and scores[1] == pytest.approx(1 / 6) and scores[2] is None and scores[3] == 1.0


def test_lines_titles_redaction(spark):
    assert one(spark, text.first_line(F.col("t")), t=" \n Head \n a\n b ") == "Head"
    assert one(spark, text.other_lines(F.col("t")), t=" \n Head \n a\n b ") == "a\nb"
    assert one(spark, text.titled(F.col("t")), t="cluster_labels") == "Cluster Labels"
    assert one(spark, text.redacted(F.col("t")), t="postgres://u:p@host/db") == "postgres://***@host/db"
    assert one(spark, text.preview(F.col("t"), 3), t=None) == ""


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(vector.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]
    p = df.limit(1).select(vector.softmax(F.array(F.lit(0.1), F.lit(0.1), F.lit(2.0))).alias("p")).select("p", vector.best_label(F.col("p"), ["negative", "neutral", "positive"]).alias("l")).first()
    assert sum(p.p) == pytest.approx(1) and p.l == "positive"


@pytest.mark.parametrize("vectors, want", [([[1.0, 2.0, 3.0]], [(0, 0)]), ([[1.0], [3.0]], [(-1, 0), (1, 0)]), ([], [])])
def test_projection_of_few(spark, vectors, want):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "id int, vector array<double>")
    assert [(round(r.x, 6), round(r.y, 6)) for r in vector.projected(df).orderBy("id").collect()] == want


def test_projection_keeps_the_main_axis(spark):
    df = spark.createDataFrame([(i, [float(i), 0.1 * (-1) ** i, 0.0]) for i in range(11)], "id int, vector array<double>")
    rows = vector.projected(df).orderBy("id").collect()
    assert rows[0].x == pytest.approx(-1, abs=0.01) and rows[10].x == pytest.approx(1, abs=0.01)


def compound(text):
    """The lexicon's rules word by word."""
    words = re.findall("[A-Za-z']+", text or "")
    loud = any(w.isupper() for w in words) and not all(w.isupper() for w in words)
    total = 0.0
    for i, word in enumerate(words):
        score = lexicon.VALENCE.get(word.lower())
        if score is None:
            continue
        if loud and word.isupper() and len(word) > 1:
            score += math.copysign(lexicon.CAPITALS, score)
        for back, fade in lexicon.FADE:
            if i >= back:
                before = words[i - back].lower()
                score += math.copysign(1, score) * lexicon.BOOST.get(before, 0.0) * fade
                if before in lexicon.NEGATION:
                    score *= lexicon.REVERSAL
        total += score
    if total:
        total += math.copysign(min((text or "").count("!"), 4) * lexicon.MARK, total)
    return total / math.sqrt(total * total + lexicon.SCALE) if total else 0.0


def test_lexicon(spark):
    r = random.Random(2)
    words = [*lexicon.VALENCE, *lexicon.BOOST, *lexicon.NEGATION, "table", "I", "x", "don't"]
    texts = [None, "", "ok", "This is great!", "good", "not good", "very good", "VERY GOOD stuff!!!", "GOOD", "hate " * 200]
    texts += [" ".join(r.choice([str, str, str.upper, str.title])(r.choice(words)) + r.choice(["", "", "!", ","]) for _ in range(r.randrange(1, 14))) for _ in range(300)]
    df = lexicon.with_compound(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "t", "c").orderBy("id")
    assert df.columns == ["id", "t", "c"]
    got = [row.c for row in df.collect()]
    for t, c in zip(texts, got):
        assert c == pytest.approx(compound(t), abs=1e-9), t
    assert got[0] == got[1] == got[2] == 0 and got[5] < 0 < got[4] < got[6] < got[7] and -1 <= got[9] < -0.9


def test_lexicon_columns(spark):
    df = lexicon.with_compound(spark.createDataFrame([("great love",), ("terrible hate",), ("table",), (None,)], "t string"), "t", "c")
    rows = df.select(lexicon.sign(F.col("c")), lexicon.sign_label(F.col("c")), lexicon.weak_label(F.col("c"))).collect()
    assert [tuple(r) for r in rows] == [(1, "positive", "positive"), (-1, "negative", "negative"), (0, "neutral", "neutral"), (0, "neutral", "neutral")]


def test_lemmas(spark):
    given = "stories about classes of boxes and cards that crashed while running is this as bus glass tested king red"
    assert one(spark, text.lemmas(F.col("t")), t=given) == "story about class of box and card that crash while runn is this as bus glass test king red"
    assert one(spark, text.lemmas(F.col("t")), t="") == ""
