"""Deterministic hash keys: seeded shuffle order and corpus split buckets.

The shuffle order is ``md5('<seed>:<id>')`` with the id as tie-break, so the
same rows come out in the same order regardless of partitioning (unlike
``rand(seed)``), and DuckDB can reproduce it with the same expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Split cut points on a 0-99 hash bucket.
TRAIN_CUT = 80
VALIDATION_CUT = 90


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seeded_key(id_col, seed: int) -> Column:
    """32-hex-digit md5 of ``'<seed>:<id>'``: the permutation key for a seed."""
    return F.md5(F.concat(F.lit(f"{int(seed)}:"), _col(id_col).cast("string")))


def hex_prefix_value(hex_col, digits: int) -> Column:
    """Integer value of the first ``digits`` hex digits of a hex string."""
    return F.conv(F.substring(_col(hex_col), 1, digits), 16, 10).cast("bigint")


def split_bucket(id_col) -> Column:
    """0-99 bucket of ``md5('split:<id>')`` (first 8 hex digits mod 100)."""
    h = F.md5(F.concat(F.lit("split:"), _col(id_col).cast("string")))
    return hex_prefix_value(h, 8) % 100


def split_name(id_col) -> Column:
    """train / validation / test for tables that carry no split column."""
    b = split_bucket(id_col)
    return (F.when(b < TRAIN_CUT, F.lit("train"))
             .when(b < VALIDATION_CUT, F.lit("validation"))
             .otherwise(F.lit("test")))
