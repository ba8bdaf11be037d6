"""The training-data pipeline over `documents`: five stages, each on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from forumlens.llm.common import scratch, stage, unstage
from forumlens.llm.decontamination import decontaminate
from forumlens.llm.near_duplicates import deduplicated
from forumlens.llm.pieces import encode_pieces
from forumlens.llm.quality_classifier import accepted
from forumlens.llm.substring_dedup import without_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects (junk or toxic); null and empty texts count as junk."""
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id of each class of near duplicates.

    Texts without words are classes of their own; null ids are in no class and stay; of rows that repeat an id one stays.
    """
    return deduplicated(docs)


def repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of over 50 words, or 400 bytes, that occur more than once; documents stay, without them.

    Null and empty texts become empty ones, repeated rows lose all of a text that is long enough, columns of any name are carried.
    """
    return without_repeats(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item within its error budget.

    Null and empty texts hold none and stay, as do all rows where there are no items; repeated rows are judged alike.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, decoded: the pieces of each text with an end id, and what they decode to.

    A null or empty text has the end id only; repeated rows are encoded each; other columns end here.
    """
    import public_tokenizers

    return encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("near_duplicates", near_duplicate),
    ("substring_dedup", repeated_text),
    ("decontamination", benchmark),
    ("pieces", encoded),
]

#: No stage can be put in SQL: scorer training, hashing and piece merging are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir/documents.parquet; each stage's result is written as Parquet and read by the next.

    Once a stage is written, what it kept on the way and the result that it read are deleted.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES:
        with scratch() as kept:
            kept.append(stage(apply(spark, docs, sf_dir), name))
        unstage(docs)
        docs = kept[0]
    return docs
