"""Chat formatting with cumulative-snapshot collapse.

Logs often hold a conversation once per turn, each record repeating all turns so far. Every prefix of
a conversation gets a rolling fingerprint; a conversation whose whole fingerprint is a proper prefix
of another one is a snapshot and goes (anti-join), and of identical conversations the smallest id
stays. What is left is rendered.

The fingerprint of a prefix is three sums over 32-bit parts of position-salted turn hashes. Sums can be
built from blocks of turns, so neither ranking nor hashing needs all turns of a conversation in one
task, and a conversation that holds a third of all rows is spread over its blocks, which are sampled
ranges of the turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from authloom.llm.store import Store

BLOCK = 256
PARTS = 3  # 32-bit parts of a fingerprint
HASH = [f"h{k}" for k in range(PARTS)]
START, END = "<|im_start|>", "<|im_end|>"


def numbered_turns(turns: DataFrame, store: Store, conv_col: str = "conv_id", turn_col: str = "turn",
                   role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv, pos, role, text`` and ``HASH``: turns ranked from 1, with prefix fingerprints.

    Repeated rows count once. Turns order by number, role and text (ties keep both turns); a turn
    without number comes first. Null role and text count as empty. Rows without conversation id are
    left out, since nothing says what they belong to.
    """
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("conv"), F.coalesce(F.col(turn_col).cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).distinct()
    # blocks are sampled ranges of all turns in order, so one block holds no more of a conversation than a
    # task holds of the table, however its numbers lie; rows are counted on in the order they are written in
    order = ["conv", "turn", "role", "text"]
    rows = store.save(rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "*", F.spark_partition_id().alias("block"), F.monotonically_increasing_id().alias("no")), "ranges")
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("n"), F.min("no").alias("first")).withColumn(
        "skip", F.coalesce(F.sum("n").over(before), F.lit(0))).select("conv", "block", "first", "skip")
    placed = rows.join(blocks, ["conv", "block"]).select(
        "conv", "block", (F.col("skip") + F.col("no") - F.col("first") + 1).cast("long").alias("pos"), "role", "text")
    # sums of 32-bit parts stay exact for two billion turns
    # the role's length says where the text begins
    digest = F.md5(F.concat_ws(":", "pos", F.char_length("role"), F.concat("role", "text")))
    part = lambda k: F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long")
    placed = placed.withColumns({f"d{k}": part(k) for k in range(PARTS)})
    running = Window.partitionBy("conv", "block").orderBy("pos")
    totals = placed.groupBy("conv", "block").agg(*[F.sum(f"d{k}").alias(f"s{k}") for k in range(PARTS)])
    totals = totals.select("conv", "block", *[
        F.coalesce(F.sum(f"s{k}").over(before), F.lit(0)).alias(f"b{k}") for k in range(PARTS)])
    return (placed.withColumns({f"r{k}": F.sum(f"d{k}").over(running) for k in range(PARTS)})
            .join(totals, ["conv", "block"])
            .select("conv", "pos", "role", "text", *[(F.col(f"b{k}") + F.col(f"r{k}")).alias(f"h{k}") for k in range(PARTS)]))


def maximal(turns: DataFrame) -> DataFrame:
    """``conv, n_turns, n_same`` of the conversations that no other one continues.

    Of conversations with the same turns the smallest id stays; ``n_same`` counts them.
    """
    ends = turns.groupBy("conv").agg(F.max("pos").alias("n_turns"))
    whole = (turns.withColumnRenamed("pos", "n_turns").join(ends, ["conv", "n_turns"])
             .groupBy("n_turns", *HASH).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_same")))
    # a fingerprint that occurs at a position before the end of its conversation
    inner = (turns.join(ends, "conv").where("pos < n_turns")
             .select(F.col("pos").alias("n_turns"), *HASH).distinct())
    return whole.join(inner, ["n_turns", *HASH], "left_anti").select("conv", "n_turns", "n_same")


def render(turns: DataFrame, chosen: DataFrame, part_turns: int = BLOCK) -> DataFrame:
    """``conv, part, n_turns, n_same, text``: chat markup, in numbered parts of at most ``part_turns`` turns."""
    rows = turns.join(chosen, "conv").withColumn("part", F.expr(f"(pos - 1) div {part_turns}"))
    line = F.concat(F.lit(START), F.col("role"), F.lit("\n"), F.col("text"), F.lit(END + "\n"))
    return (rows.groupBy("conv", "part", "n_turns", "n_same")
            .agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("lines"))
            .select("conv", "part", "n_turns", "n_same",
                    F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("text")))


def format_chats(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rendered maximal conversations: ``conv_id, part, n_turns, n_same, text``.

    Extra columns are ignored; an empty table gives an empty result.
    """
    store = Store(conversations.sparkSession, "chat")
    turns = store.save(numbered_turns(conversations, store, conv_col, turn_col, role_col, text_col), "turns")
    return render(turns, maximal(turns)).withColumnRenamed("conv", "conv_id")
