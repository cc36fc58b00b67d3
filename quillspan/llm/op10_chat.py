"""Chat formatting after the collapse of cumulative snapshots, in DataFrame functions only.

Logs often hold a conversation again after every turn. Running sums of turn hashes give each turn's prefix a key; a conversation whose
whole key is the key of a proper prefix of another one is dropped by an anti-join, copies of a conversation count once, and what remains is rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Turn numbers in one part. Windows and rendering work on parts, so a conversation of any length is never gathered in one task.
PART = 1024
_SUMS = ["s1", "s2", "s3", "s4"]


def _turns(conversations: DataFrame) -> DataFrame:
    t = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    t = t.withColumn("part", F.greatest(F.floor(F.col("turn") / PART), F.lit(0)))
    h = [F.xxhash64(F.lit(i), F.col("turn"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")) for i in (1, 2)]
    low = F.lit(0xFFFFFFFF).cast("long")
    return t.withColumns({"s1": h[0].bitwiseAND(low), "s2": F.shiftrightunsigned(h[0], 32), "s3": h[1].bitwiseAND(low), "s4": F.shiftrightunsigned(h[1], 32)})


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """-> conv_id, n_turns, copies: conversations that no other one continues; of equal ones the least conv_id, with their number.

    Equal means the same turn numbers, roles and texts, repeated rows counted. A prefix holds all turns up to some turn number.
    """
    turns = _turns(conversations)
    parts = turns.groupBy("conv_id", "part").agg(*[F.sum(s).alias(s) for s in _SUMS], F.count("*").alias("n"), F.max("turn").alias("last"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("conv_id", "part", *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"b{s}") for s in _SUMS], F.max("last").over(Window.partitionBy("conv_id")).alias("last"))
    whole = parts.groupBy("conv_id").agg(*[F.sum(s).alias(s) for s in _SUMS], F.sum("n").alias("n_turns"), F.max("last").alias("turn"))
    so_far = Window.partitionBy("conv_id", "part").orderBy("turn").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    running = turns.select("conv_id", "part", "turn", *[F.sum(s).over(so_far).alias(s) for s in _SUMS]).alias("t")
    on = F.col("t.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("t.part") == F.col("b.part"))
    prefixes = running.join(base.alias("b"), on).where("t.turn < b.last").select("t.turn", *[(F.col(f"t.{s}") + F.col(f"b.b{s}")).alias(s) for s in _SUMS]).distinct()
    once = whole.groupBy("turn", *_SUMS, "n_turns").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    return once.join(prefixes, ["turn", *_SUMS], "left_anti").select("conv_id", "n_turns", "copies")


def render_chats(conversations: DataFrame, before: str = "<|im_start|>", after: str = "<|im_end|>\n") -> DataFrame:
    """-> conv_id, part, n_turns, copies, text: one row per maximal conversation, and one more for every further 1024 turn numbers.

    Turns are rendered in the order of turn, role, text: `before`, role, a line feed, text, `after`. A null turn comes first, null roles and texts are rendered
    empty; rows without conv_id are one conversation. Repeated rows are rendered as often as they come. An empty table gives no rows; other columns are ignored.
    """
    keep = maximal_conversations(conversations).alias("k")
    line = F.concat(F.lit(before), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(after))
    turns = _turns(conversations).select("conv_id", "part", "turn", "role", "text", line.alias("line")).alias("t")
    rows = turns.join(keep, F.col("t.conv_id").eqNullSafe(F.col("k.conv_id"))).select("t.conv_id", "part", "n_turns", "copies", F.struct("turn", "role", "text", "line").alias("x"))
    grouped = rows.groupBy("conv_id", "part", "n_turns", "copies").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return grouped.select("conv_id", "part", "n_turns", "copies", F.array_join(F.transform("xs", lambda x: x["line"]), "").alias("text"))
