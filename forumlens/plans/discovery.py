"""Registered queries of indexes, density clusters, layouts and learned vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import filters
from ..operators.text_index import TextIndex
from ..operators.vector_index import VectorIndex
from ..sources.domain import Domain
from ..sources.scratch import Scratch
from .catalogue import ORACLES, QUESTION, query, r6


@query(ORACLES["vector_search_many"], with_domain=False)
def vector_index_search(d: Domain) -> DataFrame:
    """Every vector whose id is divisible by 100, against all vectors, exactly, through the cell index."""
    with Scratch(d.spark) as scratch:
        index = VectorIndex.build(d.vectors)
        out = scratch.keep(scratch.staged(index.search(d.vectors.where("id % 100 = 0"), exact=True, staged=scratch.staged), "found"))
        index.remove()
        return out


@query()
def vector_index_recall(d: Domain) -> DataFrame:
    """One row: for ids divisible by 100, the share of the ten nearest rows that an index of 16 cells finds, and the share of vectors it reads.

    The number of cells read is calibrated on 256 other vectors, taken by hash.
    """
    with Scratch(d.spark) as scratch:
        index = VectorIndex.build(d.vectors, cells=16)
        asked = scratch.staged(d.vectors.where("id % 100 = 0"), "asked")
        probes = index.calibrated(filters.hashed_sample(d.vectors.where("id % 100 != 0"), "id", 256), staged=scratch.staged)
        some, all_ = (scratch.staged(index.search(asked, probes=probes, exact=e, staged=scratch.staged), "found") for e in (False, True))
        hit = all_.join(some.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
        read = index.share_read(index.probed(asked.select(F.col("id").alias("query_id"), F.col("vector").cast("array<double>").alias("vector")), probes))
        out = hit.agg(F.countDistinct("query_id").alias("n_queries"), F.count("*").alias("n_rows"), r6(F.count("hit") / F.count("*")).alias("recall"))
        row = scratch.keep(scratch.staged(out.select("*", F.lit(probes).alias("probes"), F.lit(round(read, 6)).alias("share_read")), "recall"))
        index.remove()
        return row


@query()
def topic_density(d: Domain) -> DataFrame:
    """Density clusters of all vectors, with outliers (-1) and probabilities; every cell that can matter is read."""
    from ..operators.density import density_clusters

    return density_clusters(d.vectors, least=10, samples=3, neighbours=15, exact=True).withColumn("probability", r6("probability"))


@query()
def embedding_layout_2d(d: Domain) -> DataFrame:
    """All vectors in two dimensions, near ones near each other."""
    from ..operators.layout import layout

    return layout(d.vectors, exact=True)


@query()
def learned_text_vectors(d: Domain) -> DataFrame:
    """id and learned vector of each text; see operators.word_vectors."""
    from ..operators.word_vectors import learned

    with Scratch(d.spark) as scratch:
        vectors = learned(d.documents.select("id", "text"))
        return scratch.keep(scratch.staged(vectors.of_texts(d.documents.select("id", "text")), "texts"))


def _indexed_texts(d: Domain, ask) -> DataFrame:
    with Scratch(d.spark) as scratch:
        index = TextIndex.build(d.documents)
        out = scratch.keep(scratch.staged(ask(index, scratch), "found"))
        index.remove()
        return out


@query(f"SELECT id FROM docs WHERE contains(lower(text), '{QUESTION}')")
def text_index_phrase(d: Domain) -> DataFrame:
    """The texts that hold a phrase, by the rarest of its trigrams, verified."""
    return _indexed_texts(d, lambda i, s: i.containing(QUESTION, scratch=s).select("id"))


@query("SELECT id FROM docs WHERE contains(lower(text), 'license') OR contains(lower(text), '@') OR contains(lower(text), 'password')")
def text_index_keywords(d: Domain) -> DataFrame:
    """The texts that hold one of several keywords; one of them is too short for the index, so all texts are read."""
    return _indexed_texts(d, lambda i, s: i.containing("license", "@", "password", scratch=s).select("id"))


@query(ORACLES["lexical_search"], with_domain=False)
def text_index_lexical(d: Domain) -> DataFrame:
    """The 25 texts of most overlap with a question, from posting lists."""
    return _indexed_texts(d, lambda i, s: i.lexical(QUESTION, 25, scratch=s))
