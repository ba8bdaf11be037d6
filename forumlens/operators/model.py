"""The sentiment classifier: stratified split, training, scoring, and its report. A declared substitute for a transformer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import LABEL_ID
from ..sources.scratch import Scratch
from .ordered import running


def stratified_split(labelled: DataFrame, label: str = "label", key: str = "id", train: float = 0.8, seed: int = 42) -> DataFrame:
    """labelled with `split`: of each label the first 80 % by hashed key train, the rest validates."""
    hashed = labelled.withColumn("_hash", F.xxhash64(key, F.lit(seed)))
    placed = running(hashed, ["_hash", key], {"_place": F.lit(1)}, Scratch(labelled.sparkSession), [label], totals=True)
    split = F.when(F.col("_place") <= F.floor(F.col("_place_total") * train), "train").otherwise("validation")
    return placed.select(*labelled.columns, split.alias("split"))


def trained(labelled: DataFrame, features: int = 1 << 16, rounds: int = 30):
    """labelled(text, label) -> a fitted pipeline: hashed term frequencies, idf, multinomial logistic regression."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer

    rows = labelled.select(F.coalesce("text", F.lit("")).alias("text"), label_id("label").alias("y")).where("y is not null")
    steps = [RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[^\p{L}\p{N}']+"), HashingTF(inputCol="words", outputCol="tf", numFeatures=features), IDF(inputCol="tf", outputCol="features"), LogisticRegression(labelCol="y", maxIter=rounds, regParam=0.01)]
    return Pipeline(stages=steps).fit(rows)


def embedded(docs: DataFrame, size: int = 384) -> DataFrame:
    """docs(id, text) -> id, vector: hashed term frequencies on the unit sphere, a declared substitute for a sentence model.

    A text without words has a zero vector.
    """
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    words = docs.select("id", F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"([\p{L}\p{N}']+)"), 1).alias("words"))
    rows = Normalizer(inputCol="tf", outputCol="unit").transform(HashingTF(inputCol="words", outputCol="tf", numFeatures=size).transform(words))
    return rows.select("id", vector_to_array("unit", "float32").alias("vector"))


def label_id(column: str):
    c = F.col(column)
    return F.when(c == "negative", float(LABEL_ID["negative"])).when(c == "neutral", float(LABEL_ID["neutral"])).when(c == "positive", float(LABEL_ID["positive"]))


def predicted(model, docs: DataFrame) -> DataFrame:
    """docs(id, text) -> id, label, confidence, logits."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(docs.select("id", F.coalesce("text", F.lit("")).alias("text")))
    names = F.array(*(F.lit(n) for n, _ in sorted(LABEL_ID.items(), key=lambda x: x[1])))
    return out.select("id", F.get(names, F.col("prediction").cast("int")).alias("label"), F.array_max(vector_to_array("probability")).alias("confidence"), vector_to_array("rawPrediction").alias("logits"))


def f1_report(judged: DataFrame) -> DataFrame:
    """judged(label, predicted) -> label, precision, recall, f1, support; a label never predicted has 0."""
    labels = judged.select(F.col("label").alias("name")).union(judged.select("predicted")).where("name is not null").distinct()
    hits = judged.where("label = predicted").groupBy(F.col("label").alias("name")).agg(F.count("*").alias("tp"))
    real = judged.groupBy(F.col("label").alias("name")).agg(F.count("*").alias("support"))
    said = judged.groupBy(F.col("predicted").alias("name")).agg(F.count("*").alias("said"))
    t = labels.join(hits, "name", "left").join(real, "name", "left").join(said, "name", "left").na.fill(0, ["tp", "support", "said"])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(F.col("tp"), F.col("said")), ratio(F.col("tp"), F.col("support"))
    return t.select(F.col("name").alias("label"), p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), "support")
