"""Search over a corpus: by vector, by word overlap, by phrase."""

from __future__ import annotations

import logging
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import overlap_score, preview, search_terms
from ..functions.vector import cosine
from .filters import first_rows


#: Queries whose scores with a batch of vectors are held at once.
SCORED = 64


def vector_search(vectors: DataFrame, query: list[float], limit: int = 10) -> DataFrame:
    """vectors(id, vector) -> the nearest ids by cosine; negative scores are shown as 0. The query is a literal: no join."""
    score = F.bround(F.greatest(cosine(F.col("vector"), F.lit([float(x) for x in query])), F.lit(0.0)), 4)
    return vectors.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def vector_search_many(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 1024) -> DataFrame:
    """vectors(id, vector), queries(id, vector) -> query_id, id, score: the k nearest rows of each query, exactly.

    Queries come in blocks of bounded size; each block meets each partition in one matrix product, and only
    a partition's own k best leave it. Equal scores (to four places) go to the lesser id. Null vectors match nothing.
    """
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).where("id is not null and vector is not null")

    def nearest(shared):
        def run(batches):
            ids, q = shared.value
            q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
            best: list[list[tuple[float, int]]] = [[] for _ in ids]
            for batch in batches:
                v = np.array(batch["vector"].tolist(), float)
                norm = np.linalg.norm(v, axis=1)
                v /= np.where(norm > 0, norm, 1)[:, None]
                key = batch["id"].to_numpy()
                for at in range(0, len(ids), SCORED):
                    for i, s in enumerate(np.round(np.maximum(q[at : at + SCORED] @ v.T, 0), 4), at):
                        top = np.lexsort((key, -s))[:k]
                        best[i] = sorted([*best[i], *zip((-s[top]).tolist(), key[top].tolist())])[:k]
            yield pd.DataFrame([(x, i, -s) for x, found in zip(ids, best) for s, i in found], columns=["query_id", "id", "score"])

        return rows.mapInPandas(run, "query_id long, id long, score double")

    found, part = None, []
    context = vectors.sparkSession.sparkContext

    def flush():
        nonlocal found, part
        if part:
            one = nearest(context.broadcast(([i for i, _ in part], np.array([v for _, v in part], float))))
            found, part = one if found is None else found.union(one), []

    for r in queries.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).where("id is not null and vector is not null").toLocalIterator():
        part.append((r["id"], r["vector"]))
        if len(part) >= block:
            flush()
    flush()
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, id long, score double")
    return first_rows(found, ["query_id"], F.desc("score"), F.asc("id"), n=k)


def lexical_search(docs: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """docs(id, text) -> the ids of most overlap with the query; rows without any are left out."""
    wanted = list(dict.fromkeys(re.findall("[a-z0-9]{3,}", query.lower())))
    terms = F.array(*map(F.lit, wanted)) if wanted else F.array().cast("array<string>")
    low = F.lower(F.coalesce("text", F.lit("")))
    marked = docs.select("id", search_terms(low).alias("terms"), F.contains(low, F.lit(query.lower())).alias("phrase"))
    counted = marked.select("id", F.size(F.array_intersect(terms, "terms")).alias("shared"), F.size("terms").alias("n"), "phrase").where("phrase or shared > 0")
    scored = counted.select("id", overlap_score(F.col("shared"), F.lit(len(wanted)), F.col("n"), F.col("phrase")).alias("score"))
    return scored.select("id", F.bround("score", 4).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def phrase_search(docs: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """docs(id, text) -> ids whose text holds the query, case aside, all at the same score."""
    return docs.where(F.contains(F.lower("text"), F.lit(query.lower()))).select("id", F.lit(0.25).alias("score")).orderBy("id").limit(limit)


def search(strategy: str, query: str | list[float], *, docs: DataFrame | None = None, vectors: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """One rung of the search ladder, named: vector, lexical or like."""
    if strategy == "vector":
        return vector_search(vectors, query, limit).withColumn("algorithm", F.lit("vector_cosine"))
    if strategy == "lexical":
        return lexical_search(docs, query, limit).withColumn("algorithm", F.lit("lexical_overlap_fallback"))
    return phrase_search(docs, query, limit).withColumn("algorithm", F.lit("like_fallback"))


def semantic_search(docs: DataFrame, query: str, *, vectors: DataFrame | None = None, encode: Callable[[str], list[float]] | None = None, limit: int = 50) -> DataFrame:
    """docs(id, text, ...) -> id, score, algorithm, state: search as one call that goes down the ladder by itself.

    By vectors where there is an encoder and any text has a vector; else by words that overlap. Where either breaks off
    (an encoder that fails, unreadable vectors), by the phrase. A blank query finds nothing.
    """
    states = {"vector_cosine": "ready", "lexical_overlap_fallback": "missing_config", "like_fallback": "error"}

    def found(rows: DataFrame) -> DataFrame:
        cases = F.create_map(*(F.lit(x) for pair in states.items() for x in pair))
        return rows.select("id", "score", "algorithm", F.element_at(cases, F.col("algorithm")).alias("state"))

    if not query.strip():
        return found(search("like", query, docs=docs.limit(0), limit=limit))
    try:
        if vectors is not None and encode is not None:
            known = vectors.join(docs.select("id"), "id", "left_semi")
            if not known.isEmpty():
                return found(search("vector", encode(query), vectors=known, limit=limit))
        rows = search("lexical", query, docs=docs, limit=limit)
    except Exception:
        logging.getLogger(__name__).exception("search falls back to the phrase")
        rows = search("like", query, docs=docs, limit=limit)
    return found(rows)


def detailed(found: DataFrame, docs: DataFrame, predictions: DataFrame, n: int = 240) -> DataFrame:
    """Search results with group, day, label, confidence and a preview of each text; the results are few and are broadcast by their limit."""
    few = F.broadcast(found)
    shown = docs.join(few, "id").select("id", "score", "algorithm", "state", "subreddit", F.to_date("timestamp").alias("date"), preview(F.col("text"), n).alias("text_preview"))
    return shown.join(predictions.select("id", "label", "confidence"), "id", "left")
