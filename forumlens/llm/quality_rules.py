"""Quality rules as a bitmask ledger: every rule is evaluated once, and policies are masks over its bits.

Main path in DataFrame functions only. The ledger is one row per document: measurements and
failure bits, made in one pass over the text without a shuffle. Policies (versions) and ablations are then
bit operations over the ledger and never read a text again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread

#: White space between words, and the symbols that are counted.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Rule name -> whether a document fails it. The bit of a rule is its place in this list, and never changes.
RULES: dict[str, Column | str] = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > 2 * n_words",
    "shouting": "10 * n_marks > 3 * n_words",
    "duplicate_lines": "n_lines >= 5 and 10 * n_dup_lines > 3 * n_lines",
    "short_or_long_words": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words)",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
#: Versioned policies: the rules that each enforces. Base rules are part of all of them.
BASE = ("few_words", "repeated_words")
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": (*BASE, "duplicate_lines"),
    "v2": (*BASE, "symbols", "shouting", "duplicate_lines", "short_or_long_words"),
}


def mask_of(policy: tuple[str, ...] | str) -> int:
    return reduce(lambda m, rule: m | BIT[rule], POLICIES[policy] if isinstance(policy, str) else policy, 0)


def _without(chars: str) -> Column:
    return F.length(F.translate("text", chars, "")).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id and the measurements that the rules need."""
    d = spread(docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select(
        "doc_id",
        # words are hashed once: windows are then hashes of eight numbers, not of eight texts
        F.transform(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w)).alias("words"),
        lines.alias("lines"),
        F.length("text").cast("long").alias("chars"),
        _without(SPACE).alias("word_chars"),
        _without(SYMBOLS).alias("no_symbols"),
        _without("!").alias("no_marks"),
    )
    d = d.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        (F.col("chars") - F.col("no_symbols")).alias("n_symbols"),
        (F.col("chars") - F.col("no_marks")).alias("n_marks"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") > WINDOW, F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.struct(F.xxhash64(F.slice("words", i, F.lit(WINDOW))).alias("h"), i.alias("i")))).alias("windows"),
    )
    rest = [c for c in d.columns if c != "windows"]
    d = d.select(*rest, F.sort_array("windows").alias("w"))
    twice = F.transform("w", lambda x, k: F.when((x["h"] == F.get("w", k - 1)["h"]) | (x["h"] == F.get("w", k + 1)["h"]), x["i"]))
    d = d.select(*rest, F.sort_array(F.filter(twice, lambda i: i.isNotNull())).alias("at"))
    gaps = F.transform("at", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("at", k + 1) - p, F.lit(WINDOW))))
    return d.select(*rest, F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"))


def ledger(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, measurements, failure_bits (long): one row per document.

    Null and empty texts have no words: all counts are 0 and few_words fails. Texts of any length are
    measured whole; a table of fewer partitions than cores is first dealt over them. Repeated rows are measured each, a null doc_id is kept, other columns are
    ignored, and an empty table gives no rows. Windows of WINDOW words count as equal by 64-bit hash.
    """
    bits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long") for name, rule in RULES.items()])
    return measured(docs).withColumn("failure_bits", bits)


def judged(book: DataFrame, policy: tuple[str, ...] | str = "v2") -> DataFrame:
    """The ledger with base_failed and kept: kept is false where a rule of the policy, or a base rule, failed.

    An empty ledger gives no rows; null bits, which ledger() never makes, give null verdicts.
    """
    failed = lambda mask: F.col("failure_bits").bitwiseAND(F.lit(mask).cast("long")) != 0
    return book.withColumn("base_failed", failed(mask_of(BASE))).withColumn("kept", ~failed(mask_of(policy) | mask_of(BASE)))


def ablations(book: DataFrame) -> DataFrame:
    """policy, rule, n_failed, n_only, n_kept_without: what each policy would keep if one of its rules went.

    One aggregation by failure pattern (at most 2 ** rules rows, combined before the shuffle) serves all policies.
    An empty ledger gives no rows.
    """
    patterns = book.groupBy("failure_bits").agg(F.count("*").alias("n"))
    each = [F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit"), F.lit(mask_of(p)).cast("long").alias("mask")) for p in POLICIES for r in POLICIES[p]]
    x = patterns.select("failure_bits", "n", F.explode(F.array(*each)).alias("e")).select("failure_bits", "n", "e.*")
    hit = F.col("failure_bits").bitwiseAND(F.col("mask"))
    return x.groupBy("policy", "rule").agg(
        F.sum(F.when(hit.bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(hit == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(hit.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )
