"""The registered queries of this subpackage: thin (spark, sf_dir) -> DataFrame wrappers, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page is a capture of the day 2024-01-01 + page_id % 366. The list is URL_LIST and about a quarter of all hosts that occur.

    The MD5 hash of a host decides whether it is listed, its category, the day, and whether it is taken off after 60 days and put on again
    after 120: so the list grows with the table and holds hot and rare hosts alike.
    """
    from .url_filter import host_of, url_filter

    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int"))
    pages = table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", day.alias("fetched"))
    hosts = pages.select(host_of("url").alias("entry")).distinct().where("entry != ''").withColumn("h", F.md5("entry"))
    digit = lambda k, n=1: F.substring("h", k, n)
    listed = hosts.where(digit(1) < "4").select("entry", F.when(digit(2) < "8", "spam").otherwise("adult").alias("category"), digit(3).alias("again"), F.date_add(F.lit("2024-01-01").cast("date"), F.conv(digit(4, 2), 16, 10).cast("int")).alias("at"))
    steps = F.array(*(F.struct(F.lit(a).alias("action"), F.lit(b).alias("below"), F.lit(k).alias("later")) for a, b, k in (("add", "g", 0), ("remove", "8", 60), ("add", "4", 120))))
    listed = listed.select("entry", "category", "at", F.explode(F.filter(steps, lambda s: F.col("again") < s["below"])).alias("s"))
    listed = listed.select("entry", "category", F.col("s.action").alias("action"), F.date_add("at", F.col("s.later")).cast("string").alias("at"))
    entries = listed.union(spark.createDataFrame(oracles.URL_LIST, "entry string, category string, action string, at string"))
    out = url_filter(captures, entries)
    return out.withColumn("fetched", F.date_format("fetched", "yyyy-MM-dd"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import chat_format

    return chat_format(table(spark, sf_dir, "conversations"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_duplicates import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    out = substring_dedup(table(spark, sf_dir, "documents"), passages=True)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passages", "n_passage_bytes")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judged, ledger

    out = judged(ledger(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failure_bits")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_html

    return extract_html(table(spark, sf_dir, "pages"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .pieces import piece_digests

    return piece_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import classify

    out = classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.drop("text")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The separator is id 50256, which the vocabulary leaves free."""
    import public_tokenizers

    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 50256).select("doc_id", "n_tokens")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole texts; null texts count as empty, repeated rows are judged alike."""
    from .license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole texts; null texts count as empty, a null id draws as one without digits."""
    from .fill_in_middle import fill_in_middle, restored

    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors whose components are finite; null labels are one label, repeated rows are coded each."""
    from .vector_codes import compress_vectors

    return compress_vectors(table(spark, sf_dir, "embeddings")).drop("label")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filter, op2_decontamination, op3_chat, op4_near_duplicates, op5_substring_dedup, op6_quality_rules, op7_html_text, op8_pieces, op9_quality_classifier, op10_token_counts, op11_license_scan, op12_fill_in_middle, op13_vector_codes)}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": oracles.OP1, "op3_chat": oracles.OP3, "op6_quality_rules": oracles.OP6, "op11_license_scan": oracles.OP11, "op12_fill_in_middle": oracles.OP12, "op13_vector_codes": oracles.OP13}
