"""Text and batch preparation T1-T5.

Batches are consecutive slices of ``batch_size`` over the seeded order.
The position comes from ``seeded_position`` (never an unpartitioned window),
and the per-batch maximum length is a window partitioned by batch id, whose
groups hold at most ``batch_size`` rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.functions.text import MAX_LENGTH, PAD_TOKEN, truncate_tokens, whitespace_tokens
from vectorloom.operators.sampling import seeded_order


def tokens_truncated(df: DataFrame, text_col: str = "text", key: str = "doc_id",
                     max_length: int = MAX_LENGTH) -> DataFrame:
    """Whitespace tokens cut to ``max_length`` (the model's input budget)."""
    toks = whitespace_tokens(text_col)
    return (df.select(key, toks.alias("_all"))
              .select(key, F.size("_all").alias("n_tokens"),
                      truncate_tokens(F.col("_all"), max_length).alias("tokens"))
              .withColumn("n_kept", F.size("tokens")))


def truncation_report(df: DataFrame, text_col: str = "text", max_length: int = MAX_LENGTH) -> DataFrame:
    """Rows cut by ``max_length`` and tokens lost (one row)."""
    n = F.size(whitespace_tokens(text_col))
    return df.select(n.alias("_n")).agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.sum(F.col("_n").cast("long")).alias("n_tokens"),
        F.sum((F.col("_n") > max_length).cast("long")).alias("n_truncated"),
        F.sum(F.greatest(F.col("_n") - max_length, F.lit(0)).cast("long")).alias("tokens_lost"),
    )


def batch_assign(df: DataFrame, batch_size: int, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """Batch id = global position div ``batch_size`` (last batch may be short)."""
    if batch_size < 1:
        raise ValueError("batch_size must be >= 1")
    ordered = seeded_order(df, key, seed)
    return ordered.withColumn("batch_id", F.floor(F.col("position") / batch_size).cast("long"))


def left_padded(df: DataFrame, batch_size: int, text_col: str = "text", key: str = "doc_id",
                max_length: int = MAX_LENGTH, seed: int = 42) -> DataFrame:
    """T4: each row padded on the left to the longest row of its batch, with mask.

    The text is tokenised once and the tokens travel with their row, so rows
    that repeat an id stay one row each.
    """
    toks = tokens_truncated(df.select(key, text_col), text_col, key, max_length).select(key, "tokens", "n_kept")
    longest = F.max("n_kept").over(Window.partitionBy("batch_id"))
    padded = batch_assign(toks, batch_size, key, seed).withColumn("batch_len", longest)
    pad = F.col("batch_len") - F.col("n_kept")
    return padded.select(
        key, "batch_id", "position", "n_kept", "batch_len",
        F.concat(F.array_repeat(F.lit(PAD_TOKEN), pad), F.col("tokens")).alias("input_tokens"),
        F.concat(F.array_repeat(F.lit(0), pad), F.array_repeat(F.lit(1), F.col("n_kept"))).alias("attention_mask"),
    )


def padding_waste(df: DataFrame, batch_size: int, text_col: str = "text", key: str = "doc_id",
                  max_length: int = MAX_LENGTH, seed: int = 42) -> DataFrame:
    """T5: per batch, padded vs real tokens and the wasted fraction."""
    toks = tokens_truncated(df.select(key, text_col), text_col, key, max_length).select(key, "n_kept")
    batched = batch_assign(toks, batch_size, key, seed)
    agg = batched.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.max("n_kept").alias("batch_len"),
        F.sum(F.col("n_kept").cast("long")).alias("real_tokens"),
    )
    padded_total = (F.col("batch_len") * F.col("rows")).cast("long")
    return agg.select(
        "batch_id", "rows", "batch_len", "real_tokens", padded_total.alias("padded_tokens"),
        (F.lit(1.0) - F.try_divide(F.col("real_tokens").cast("double"), padded_total.cast("double")))
        .alias("waste"),
    )
