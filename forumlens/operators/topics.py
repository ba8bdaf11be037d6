"""Topics: clustering of vectors, keywords, coherence, the quality gate and the similarity graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import GATE_COHERENCE, GATE_TOPICS, OUTLIER_TOPIC


def clustered(vectors: DataFrame, k: int, seed: int = 42, outliers: float = 0.05) -> DataFrame:
    """vectors(id, vector) -> id, topic_id, probability. Seeded k-means on unit vectors, a declared substitute for density
    clustering; the share `outliers` of all rows that lies farthest from its centre is topic -1."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select("id", array_to_vector(F.col("vector").cast("array<double>")).alias("raw"))
    rows = Normalizer(inputCol="raw", outputCol="features").transform(rows)
    model = KMeans(k=k, seed=seed, maxIter=20).fit(rows)
    centres = F.array(*(F.array(*(F.lit(float(x)) for x in c)) for c in model.clusterCenters()))
    near = model.transform(rows).withColumn("centre", F.get(centres, F.col("prediction")))
    far = F.sqrt(F.aggregate(F.zip_with(vector_to_array("features"), "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    near = near.select("id", "prediction", far.alias("far"))
    cut = near.select(F.percentile_approx("far", 1 - outliers)).first()[0]
    return near.select("id", F.when(F.col("far") > F.lit(cut), OUTLIER_TOPIC).otherwise(F.col("prediction")).alias("topic_id"), (1 / (1 + F.col("far"))).alias("probability"))


def words_by_topic(docs: DataFrame) -> DataFrame:
    """docs(topic_id, text) -> topic_id, word, n: counts of lower-case words of three letters and more."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z]{3,})"), 1))
    return docs.select("topic_id", words.alias("word")).groupBy("topic_id", "word").agg(F.count("*").alias("n"))


def topic_keywords(docs: DataFrame, n: int = 10) -> DataFrame:
    """The n most telling words of each topic by class-based tf-idf: share in the topic times log(1 + mean topic size / corpus count)."""
    counts = words_by_topic(docs)
    sizes = counts.groupBy("topic_id").agg(F.sum("n").alias("size"))
    mean = sizes.agg(F.avg("size").alias("mean"))
    corpus = counts.groupBy("word").agg(F.sum("n").alias("total"))
    scored = counts.join(corpus, "word").join(sizes, "topic_id").crossJoin(F.broadcast(mean))
    scored = scored.select("topic_id", "word", (F.col("n") / F.col("size") * F.log(1 + F.col("mean") / F.col("total"))).alias("score"))
    ranked = scored.withColumn("place", F.row_number().over(Window.partitionBy("topic_id").orderBy(F.desc("score"), "word")))
    return ranked.where(F.col("place") <= n).select("topic_id", "place", "word", "score")


def coherence(docs: DataFrame, keywords: DataFrame, n: int = 10) -> DataFrame:
    """exp of the mean over word pairs of log((D(a, b) + 1) / (D(b) + 1)), D counting the topic's texts that hold the words.

    docs(topic_id, text), keywords(topic_id, place, word). A topic without texts has coherence 0; a single word 1.
    One pass over the texts marks the words each holds; pairs are made within that short list.
    """
    top = keywords.where(F.col("place") <= n)
    lists = top.groupBy("topic_id").agg(F.sort_array(F.collect_list(F.struct("place", "word"))).alias("words"))
    texts = docs.select("topic_id", F.lower("text").alias("low")).join(lists, "topic_id")
    held = texts.select("topic_id", F.filter("words", lambda w: F.contains(F.col("low"), w["word"])).alias("held"))
    one = held.select("topic_id", F.explode("held").alias("w")).groupBy("topic_id", F.col("w.place").alias("pb")).agg(F.count("*").alias("d1"))
    a = held.select("topic_id", "held", F.explode("held").alias("a")).select("topic_id", F.col("a.place").alias("pa"), F.explode("held").alias("b"))
    two = a.where(F.col("pa") > F.col("b.place")).groupBy("topic_id", "pa", F.col("b.place").alias("pb")).agg(F.count("*").alias("d2"))
    pairs = top.select("topic_id", F.col("place").alias("pa")).join(top.select("topic_id", F.col("place").alias("pb")), "topic_id").where("pa > pb")
    full = pairs.join(two, ["topic_id", "pa", "pb"], "left").join(one, ["topic_id", "pb"], "left")
    log = F.log((F.coalesce("d2", F.lit(0)) + 1) / (F.coalesce("d1", F.lit(0)) + 1))
    some = docs.groupBy("topic_id").agg(F.count("*").alias("n_docs"))
    out = top.select("topic_id").distinct().join(full.groupBy("topic_id").agg(F.exp(F.avg(log)).alias("c")), "topic_id", "left").join(some, "topic_id", "left")
    return out.select("topic_id", F.when(F.coalesce("n_docs", F.lit(0)) == 0, 0.0).otherwise(F.coalesce("c", F.lit(1.0))).alias("coherence_score"))


def gate(topics: DataFrame, least: int = GATE_TOPICS, cut: float = GATE_COHERENCE) -> DataFrame:
    """One row: topics that are coherent enough, the mean coherence, and whether the gate opens. Outliers don't count."""
    good = F.coalesce(F.sum(F.when(F.col("coherence_score") >= cut, 1)), F.lit(0))
    return topics.where(F.col("topic_id") != OUTLIER_TOPIC).agg(good.alias("coherent"), F.avg("coherence_score").alias("mean_coherence"), (good >= least).alias("passed"))


def similarity_edges(nodes: DataFrame, threshold: float = 0.15) -> DataFrame:
    """nodes(topic_id, terms) -> source < target, shared terms, and Jaccard similarity of at least threshold.

    Pairs are made by an equi-join on the terms, never by comparing all nodes.
    """
    threshold = min(max(threshold, 0.0), 1.0)
    terms = nodes.select("topic_id", F.size(F.array_distinct("terms")).alias("size"), F.explode(F.array_distinct("terms")).alias("term"))
    other = terms.select(F.col("topic_id").alias("target"), F.col("size").alias("other_size"), "term")
    both = terms.join(other, "term").where(F.col("topic_id") < F.col("target"))
    pairs = both.groupBy(F.col("topic_id").alias("source"), "target").agg(F.sort_array(F.collect_set("term")).alias("shared"), F.first("size").alias("a"), F.first("other_size").alias("b"))
    similarity = F.size("shared") / (F.col("a") + F.col("b") - F.size("shared"))
    return pairs.withColumn("similarity", similarity).where(F.col("similarity") >= threshold).select("source", "target", F.bround("similarity", 4).alias("similarity"), "shared")
