import random
from datetime import datetime, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from forumlens.operators import drift, model, ordered
from forumlens.sources.scratch import Scratch


def rows(spark, n=2000, seed=1):
    r = random.Random(seed)
    data = [(i, r.choice(["a", "a", "a", "b", None]), r.randrange(0, 50), datetime(2024, 1, 1) + timedelta(seconds=r.randrange(0, 40_000)) if r.random() > 0.01 else None) for i in range(n)]
    return spark.createDataFrame(data, "id long, g string, x int, ts timestamp").repartition(5)


def test_running_sums_equal_one_window(spark):
    df = rows(spark)
    with Scratch(spark) as scratch:
        for by in ([], ["g"]):
            got = ordered.running(df, ["x", "id"], {"s": F.col("x"), "place": F.lit(1)}, scratch, by, totals=True)
            assert got.columns == ["id", "g", "x", "ts", "s", "place", "s_total", "place_total"]
            w = Window.partitionBy(*by)
            upto = w.orderBy("x", "id").rowsBetween(Window.unboundedPreceding, 0)
            want = df.select("*", F.sum("x").over(upto).alias("s"), F.row_number().over(upto).alias("place"), F.sum("x").over(w).alias("s_total"), F.count("*").over(w).alias("place_total"))
            assert sorted(got.collect(), key=lambda r: r.id) == sorted(want.collect(), key=lambda r: r.id)
            ranged = spark.read.parquet(next(iter(scratch.made.values()))[1])
            assert max(r["count"] for r in ranged.groupBy("_range").count().collect()) < 1000, "no range holds half of the rows"
            scratch.drop(*[t for t, _ in scratch.made.values()])


def test_counts_within_a_time_equal_one_window(spark):
    df = rows(spark)
    w = Window.partitionBy("g").orderBy(F.col("ts").cast("long")).rangeBetween(-600, 0)
    want = sorted((r.id, r.n) for r in df.withColumn("n", F.count("*").over(w)).collect())
    for stretch in (1, 3, 10):
        got = ordered.counted_within(df, 600, F.col("ts"), "g", "n", stretch)
        assert got.columns == [*df.columns, "n"] and sorted((r.id, r.n) for r in got.collect()) == want


def test_split_and_distance(spark):
    df = rows(spark).where("g is not null")
    parts = model.stratified_split(df, "g")
    counts = {(r.g, r.split): r["count"] for r in parts.groupBy("g", "split").count().collect()}
    for g, n in ((r.g, r["count"]) for r in df.groupBy("g").count().collect()):
        assert counts[g, "train"] == int(n * 0.8) and counts[g, "validation"] == n - int(n * 0.8)
    a, b = df.where("id % 3 = 0").select(F.col("x").alias("confidence")), df.where("x < 30").select(F.col("x").alias("confidence"))
    xs, ys = ([r[0] for r in t.collect()] for t in (a, b))
    want = max(abs(sum(x <= v for x in xs) / len(xs) - sum(y <= v for y in ys) / len(ys)) for v in range(50))
    assert abs(drift.value_shift(a, b).first()[0] - want) < 1e-12
    assert drift.value_shift(a.limit(0), b.limit(0)).first()[0] == 0.0
