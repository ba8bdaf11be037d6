"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions only.

Logs often hold a conversation again and again, each time with a turn more. Each turn gets the rolling
hash of all turns up to it: the exclusive-or of position-salted 64-bit hashes, under two seeds, which a
window sums in linear time. A conversation whose whole hash is a proper prefix hash of any other is a
snapshot; an anti-join removes it, and only maximal conversations are rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Turn template, and the mark whose occurrences inside a text are defused.
OPEN, CLOSE, MARK, DEFUSED = "<|im_start|>", "<|im_end|>", "<|", "< |"


def _turns(conversations: DataFrame) -> DataFrame:
    c = conversations
    return c.select(c["conv_id"].cast("long").alias("conv_id"), c["turn"].cast("long").alias("turn"), F.coalesce(c["role"].cast("string"), F.lit("")).alias("role"), F.coalesce(c["text"].cast("string"), F.lit("")).alias("text")).where("conv_id is not null")


def maximal(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> conv_id, n_turns, n_copies of those that no longer one extends.

    Equal conversations collapse to the least conv_id; n_copies counts them. Hot first turns and hot
    conversations are combined before each shuffle, so no group of copies meets in one task.
    """
    t = _turns(conversations)
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    t = t.select("conv_id", F.row_number().over(order).alias("k"), F.count("*").over(Window.partitionBy("conv_id")).alias("n"), "turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    t = t.select("conv_id", "k", "n", *(F.bit_xor(F.xxhash64(F.lit(seed), "k", "role", "text")).over(upto).alias(f"h{seed}") for seed in (1, 2)))
    whole = t.where("k = n").groupBy("h1", "h2", "n").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    prefix = t.where("k < n").select("h1", "h2", F.col("k").cast("long").alias("n")).distinct()
    return whole.join(prefix, ["h1", "h2", "n"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_copies")


def chat_format(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> conv_id, n_turns, n_copies, rendered.

    Turns follow their number; ties follow role, then text, and a null number comes first. Null roles
    and texts count as empty. Rows with a null conv_id belong to no conversation and are left out. The
    template's own marks inside a role or text are defused. Conversations without a longer one that starts
    with all their turns are kept, one of equal ones. An empty table gives no rows; other columns are ignored.
    """
    kept = maximal(conversations)
    turns = _turns(conversations).join(kept, "conv_id")
    defused = lambda c: F.replace(c, F.lit(MARK), F.lit(DEFUSED))
    grouped = turns.groupBy("conv_id", "n_turns", "n_copies").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    body = F.array_join(F.transform("turns", lambda x: F.concat(F.lit(OPEN), defused(x["role"]), F.lit("\n"), defused(x["text"]), F.lit(CLOSE))), "\n")
    return grouped.select("conv_id", "n_turns", "n_copies", body.alias("rendered"))
