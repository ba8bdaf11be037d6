import random

import pytest

from forumlens.operators import search
from forumlens.operators.text_index import TextIndex
from forumlens.sources.scratch import Scratch

WORDS = ["alpha", "beta", "Gamma", "delta-ray", "über", "日本語", "a.b", "50%", "x_y", "ALPHAbet", "ta", "and", "the"]


def corpus(n=200, seed=2):
    r = random.Random(seed)
    rows = [(i, " ".join(r.choice(WORDS) for _ in range(r.randrange(0, 12)))) for i in range(n)]
    return [*rows, (900, None), (901, ""), (902, "ab"), (903, "line\nbreak and\nthe end"), (904, "e" * 5000 + "needle" + "f" * 5000)]


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame(corpus(), "id long, text string").repartition(3)
    return docs, TextIndex.build(docs, parts=16, files=2)


@pytest.mark.parametrize("query", ["alpha", "BETA gam", "a r", "y", "", "ÜBER", "日本語", "50%", "x_y", "break and\nthe", "needle", "no such thing", "alphabet"])
def test_substrings_are_those_of_a_scan(spark, index, query):
    docs, i = index
    with Scratch(spark) as scratch:
        got = sorted(r.id for r in i.containing(query, scratch=scratch).collect())
    assert got == sorted(k for k, t in corpus() if query.lower() in (t or "").lower())


def test_any_of_several_keywords(spark, index):
    _, i = index
    with Scratch(spark) as scratch:
        got = sorted(r.id for r in i.containing("needle", "gamma", "zzz", scratch=scratch).collect())
        assert got == sorted(k for k, t in corpus() if any(x in (t or "").lower() for x in ("needle", "gamma")))
        assert i.containing(scratch=scratch).count() == len(corpus())


@pytest.mark.parametrize("query", ["alpha beta", "and the", "x_y", "the", "ta", "nothing of it"])
def test_lexical_search_is_that_of_a_scan(spark, index, query):
    docs, i = index
    with Scratch(spark) as scratch:
        assert i.lexical(query, 40, scratch=scratch).collect() == search.lexical_search(docs, query, 40).collect()


def files(df):
    """How many files the executed scan opened."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if "AdaptiveSparkPlan" in plan.nodeName():
        plan = plan.executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numFiles").value() for k in range(leaves.size()))


def test_a_look_up_opens_the_folders_of_its_terms(index):
    _, i = index
    assert files(i.postings(["walpha"])) <= 2 < files(i._read("lists", "term string, id long, n int"))
    one = i.texts(i.spark.createDataFrame([(904,)], "id long"))
    assert [r.id for r in one.collect()] == [904]
    assert files(i._read("texts", "id long, text string", {3})) <= 2


def test_lists_are_rows_a_term_not_a_text(index, spark):
    """One row a term and group of texts is shuffled and stored; characters beyond the 16-bit ones count as one."""
    docs, i = index
    lists = spark.read.parquet(f"{i.path}/lists")
    texts = [(k, (t or "").lower()) for k, t in corpus()]
    assert lists.where("term = 'gthe'").count() <= docs.rdd.getNumPartitions() * 2 < sum("the" in t for _, t in texts)
    assert sorted(r.id for r in i.postings(["gthe"]).collect()) == [k for k, t in texts if "the" in t]
    odd = spark.createDataFrame([(1, "x\U0001F600\U0001F601y"), (2, "\U0001F600 x")], "id long, text string")
    with Scratch(spark) as scratch:
        other = TextIndex.build(odd, parts=4, files=1)
        assert [r.id for r in other.containing("\U0001F600\U0001F601y", scratch=scratch).collect()] == [1]
