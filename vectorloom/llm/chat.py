"""Chat formatting: collapse cumulative snapshots, then render the maximal conversations.

Chat logs hold the same conversation again and again, each time some turns longer.
A rolling hash over the turns names every prefix: the hash after turn k is
the hash after turn k - 1 xor the hash of (k, role, text), in two 64-bit
lanes. A conversation whose whole hash is a proper prefix hash of another one
is dropped by an anti-join; of equal conversations the smallest conv_id stays.

Turns are numbered by a range sort over (conversation, turn, role, text), written once: a row's place is the
rows of its conversation in earlier ranges plus its distance from the conversation's first row in its own
range. Hashes are summed in blocks of ``BLOCK`` turns, and blocks in a second, smaller window. So a
conversation that holds a third of all rows is spread over many tasks, whatever its turn
values are: rows without a conv_id that all carry the same few turn values included. Prefix hashes are pre-aggregated before the
join, so a first turn that everyone uses costs one row per task. Column expressions only.

Defined results: turns are ordered by turn (null first), then role and text; rows repeated in full
count once; null role or text differ from empty ones and render as
``unknown`` and as nothing; rows with a null conv_id form one conversation,
ordered after the numbered ones; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.llm.common import materialize

#: Turns per block: bounds a window group and a rendered part.
BLOCK = 256


def _said(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text"))


def ranged_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, t1, t2 (hashes of role and text), pid, mid: the distinct turns in their order.

    Ranges follow one another by ``pid``, rows inside one by ``mid`` without gaps. Written, so that both are
    read as often as needed and a lost task finds the same numbers again.
    """
    order = ["conv_id", "turn", "role", "text"]
    rows = conversations.select(*order).distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(rows.select(*order, _said(1).alias("t1"), _said(2).alias("t2"), F.spark_partition_id().alias("pid"),
                                   F.monotonically_increasing_id().alias("mid")), "chat-turns")


def _places(ranged: DataFrame) -> DataFrame:
    """c, p, shift: ``mid + shift`` is the turn's place, from 1; one row per conversation and range."""
    before = Window.partitionBy("conv_id").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("conv_id", "pid").agg(F.count(F.lit(1)).alias("n"), F.min("mid").alias("start"))
    earlier = F.coalesce(F.sum("n").over(before), F.lit(0))
    return sizes.select(F.col("conv_id").alias("c"), F.col("pid").alias("p"), "n", (earlier - F.col("start") + 1).alias("shift"))


def _numbered(rows: DataFrame, places: DataFrame) -> DataFrame:
    """``rows`` with k (place in the conversation, from 1) and block, without pid and mid."""
    out = rows.join(places, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("pid") == F.col("p")))
    out = out.withColumn("k", F.col("mid") + F.col("shift")).withColumn("block", F.floor((F.col("k") - 1) / BLOCK))
    return out.drop("c", "p", "shift", "pid", "mid")


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, t1, t2, k (place in the conversation, from 1), block (k - 1 by ``BLOCK``)."""
    ranged = ranged_turns(conversations)
    return _numbered(ranged, _places(ranged).drop("n"))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, k, p1, p2: the rolling hash after each turn."""
    lane = lambda seed, said: F.xxhash64(F.lit(seed), F.col("k"), F.col(said))
    turns = turns.select("conv_id", "block", "k", lane(1, "t1").alias("e1"), lane(2, "t2").alias("e2"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = turns.groupBy("conv_id", "block").agg(F.bit_xor("e1").alias("x1"), F.bit_xor("e2").alias("x2"))
    blocks = blocks.select(F.col("conv_id").alias("c"), F.col("block").alias("b"),
                           F.coalesce(F.bit_xor("x1").over(before), F.lit(0)).alias("q1"),
                           F.coalesce(F.bit_xor("x2").over(before), F.lit(0)).alias("q2"))
    so_far = Window.partitionBy("conv_id", "block").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rolled = turns.select("conv_id", "block", "k", F.bit_xor("e1").over(so_far).alias("r1"),
                          F.bit_xor("e2").over(so_far).alias("r2"))
    joined = rolled.join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    return joined.select("conv_id", "k", F.col("r1").bitwiseXOR(F.col("q1")).alias("p1"),
                         F.col("r2").bitwiseXOR(F.col("q2")).alias("p2"))


def maximal(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """conv_id, n_turns of the conversations that are no proper prefix of another, one of each equal group.

    ``lengths``: c, n of every conversation.
    """
    named = prefix_hashes(turns).join(lengths, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    named = materialize(named, "chat-prefixes")
    whole = (named.filter("k = n").groupBy("k", "p1", "p2")
             .agg(F.min(F.struct(F.col("conv_id").isNull().alias("no_id"), "conv_id")).alias("first")))
    inner = named.filter("k < n").select("k", "p1", "p2").distinct()
    return (whole.join(inner, ["k", "p1", "p2"], "left_anti")
            .select(F.col("first.conv_id").alias("conv_id"), F.col("k").alias("n_turns")))


def collapse_and_render(conversations: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, text: the maximal conversations, rendered in parts of at most ``BLOCK`` turns
    each, in order (a conversation of usual length has one part)."""
    ranged = ranged_turns(conversations)
    places = _places(ranged)
    lengths = places.groupBy("c").agg(F.sum("n").alias("n"))
    places = places.drop("n")
    narrow = _numbered(ranged.select("conv_id", "t1", "t2", "pid", "mid"), places)
    kept = maximal(narrow, lengths).select(F.col("conv_id").alias("kept_id"), F.col("n_turns").cast("long").alias("n_turns"))
    # texts meet only the places of kept conversations
    places = places.join(kept, F.col("c").eqNullSafe(F.col("kept_id"))).drop("kept_id")
    rows = _numbered(ranged.select("conv_id", "role", "text", "pid", "mid"), places)
    said = F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("unknown")), F.lit("\n"),
                    F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n"))
    return (rows.withColumn("said", said).groupBy("conv_id", "block", "n_turns")
            .agg(F.array_sort(F.collect_list(F.struct("k", "said"))).alias("turns"))
            .select("conv_id", (F.col("block") + 1).cast("int").alias("part"), "n_turns",
                    F.array_join(F.col("turns.said"), "").alias("text")))
