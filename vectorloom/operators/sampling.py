"""Seeded shuffle, clamped take-n, train/test sampling, label vocabulary.

Order is ``md5('<seed>:<id>'), id``: a permutation that does not depend on
partitioning. Positions are global row numbers in that order, computed
without ever putting the corpus in one partition: ``seeded_position`` for
the seeded (md5) order, ``global_position`` for any other total order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorloom.functions.keys import hex_prefix_value, seeded_key
from vectorloom.session import ensure_scratch

# Hex digits of the sort key used as buckets by seeded positions and samples:
# 16**4 = 65,536 buckets, a table small enough to broadcast.
BUCKET_DIGITS = 4
# Samples of up to this many rows are cut by the smallest keys that each task keeps
# (key and id only), in one narrow pass.
SAMPLE_STATE = 4096


def _cols(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def _row_hash(df: DataFrame) -> Column:
    """xxhash64 of a row's values, the last tie-break of every order here.

    Rows that tie on it are copies (or a 2**-64 collision), so which of them
    comes first does not change any result, and a retried task orders them
    the same way. Map columns cannot be hashed and are left out.
    """
    cols = [c for c, f in zip(df.columns, df.schema.fields) if not isinstance(f.dataType, T.MapType)]
    return F.xxhash64(*cols) if cols else F.lit(0)


def range_tagged(df: DataFrame, order_by) -> DataFrame:
    """``df`` in ``order_by`` order with its range partition (``_vl_pid``) and place in it (``_vl_mid``).

    Range-partitioned sort (splits even a hot key prefix, and, with the
    input row id as the last tie-break, even rows that repeat the whole key),
    written as a checkpoint so that later passes read identical partitions.
    """
    ensure_scratch(df.sparkSession)
    # Ties on the keys go by the row hash, so the order is the same on any partitioning.
    # Last tie-break: the row's id in its input partition, taken after a local
    # sort by a hash of the row. Copies that tie on the whole key then still
    # spread over range partitions instead of one task, and the ids do not
    # depend on the order rows arrive in: a retried map task (say, over a
    # recomputed shuffle) routes every row as the first attempt did, since
    # rows that share a hash are copies and interchangeable.
    ordered = (df.withColumn("_vl_rh", _row_hash(df)).sortWithinPartitions("_vl_rh")
                 .withColumn("_vl_in", F.monotonically_increasing_id())
                 .orderBy(*_cols(order_by), F.col("_vl_rh"), F.col("_vl_in"))
                 .drop("_vl_in", "_vl_rh"))
    return (ordered
            .withColumn("_vl_pid", F.spark_partition_id())
            .withColumn("_vl_mid", F.monotonically_increasing_id())
            .checkpoint(eager=True))


def global_position(df: DataFrame, order_by, name: str = "position") -> DataFrame:
    """0-based global row number of each row in ``order_by`` order.

    Plan: range-partitioned sort, each row tagged with its partition and
    in-partition index (``range_tagged``). Partition
    sizes (one row per partition) are summed into offsets, broadcast
    (bounded by the partition count) and added back. No step holds more
    than one partition.
    """
    tagged = range_tagged(df, order_by)
    counts = tagged.groupBy("_vl_pid").agg(F.count(F.lit(1)).alias("_vl_n"))
    before = Window.orderBy("_vl_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_vl_pid", F.coalesce(F.sum("_vl_n").over(before), F.lit(0)).alias("_vl_off"))
    local_index = F.col("_vl_mid") - F.shiftleft(F.col("_vl_pid").cast("long"), 33)
    return (tagged.join(F.broadcast(offsets), "_vl_pid")
                  .withColumn(name, (F.col("_vl_off") + local_index).cast("long"))
                  .drop("_vl_pid", "_vl_mid", "_vl_off"))


def _bucket_offsets(keyed: DataFrame) -> DataFrame:
    """(bucket, rows before it, rows up to and including it), per non-empty bucket.

    Counting is a partial aggregation (one row per bucket per task leaves
    the map side), and the result has at most 16**BUCKET_DIGITS rows, so
    the running total is a window over that small table only.
    """
    counts = keyed.groupBy("_vl_bucket").agg(F.count(F.lit(1)).alias("_vl_n"))
    upto = Window.orderBy("_vl_bucket").rowsBetween(Window.unboundedPreceding, 0)
    return (counts.withColumn("_vl_after", F.sum("_vl_n").over(upto))
                  .select("_vl_bucket", (F.col("_vl_after") - F.col("_vl_n")).alias("_vl_before"), "_vl_after"))


def _rank_in_buckets(keyed: DataFrame, offsets: DataFrame, id_col: str, name: str) -> DataFrame:
    """Bucket offset + row number inside the bucket = global position."""
    in_bucket = Window.partitionBy("_vl_bucket").orderBy("sort_key", id_col, "_vl_h")
    return (keyed.join(F.broadcast(offsets), "_vl_bucket")
                 .withColumn(name, (F.col("_vl_before") + F.row_number().over(in_bucket) - 1).cast("long")))


def _keyed(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    """The rows with their sort key and bucket; rows with a null id have no key, hence no place, and are left out."""
    return (df.where(F.col(id_col).isNotNull()).withColumn("_vl_h", _row_hash(df))
              .withColumn("sort_key", seeded_key(id_col, seed))
              .withColumn("_vl_bucket", hex_prefix_value("sort_key", BUCKET_DIGITS)))


def seeded_position(df: DataFrame, id_col: str, seed: int = 42, name: str = "position") -> DataFrame:
    """Position of every row in the seed's permutation, with no checkpoint.

    The key is an md5 hex string, so its first BUCKET_DIGITS digits name a
    bucket, buckets are uniform for distinct ids, and bucket order is key
    order. Pass 1 counts rows per bucket (reading only the id column when
    nothing else is needed); the offsets (at most 65,536 rows) are
    broadcast. Pass 2 ranks rows inside their bucket, a window partitioned
    by bucket. Both numbers are functions of the data, not of the
    partitioning, so a retried task recomputes the same positions. Rows that
    repeat an id are ordered by a hash of the row; a bucket that such rows fill is
    ranked by a window that sorts and spills, never by holding it.
    """
    keyed = _keyed(df, id_col, seed)
    offsets = _bucket_offsets(keyed).select("_vl_bucket", "_vl_before")
    return (_rank_in_buckets(keyed, offsets, id_col, name)
            .drop("_vl_bucket", "_vl_before", "_vl_h"))


def seeded_order(df: DataFrame, id_col: str, seed: int = 42, name: str = "position") -> DataFrame:
    """Every row with its position in the seed's permutation."""
    return seeded_position(df, id_col, seed, name)


def _bottom_sample(df: DataFrame, n: int, id_col: str, seed: int, name: str | None) -> DataFrame:
    """The first ``n`` rows by one narrow pass: every task keeps its ``n`` smallest (key, id), the merged ones
    are at most ``n`` broadcast rows with their place, and the wide rows are looked up by id in the scan.

    Rows that repeat an id are told apart by the row hash, among the rows looked up only.
    """
    keys = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_vl_id"), seeded_key(id_col, seed).alias("sort_key"))
    top = keys.orderBy("sort_key", "_vl_id").limit(n)
    placed = top.withColumn("_vl_place", F.row_number().over(Window.orderBy("sort_key", "_vl_id")) - 1)   # n rows
    ids = placed.groupBy("_vl_id", "sort_key").agg(F.min("_vl_place").alias("_vl_place"), F.count(F.lit(1)).alias("_vl_n"))
    found = df.withColumn("_vl_h", _row_hash(df)).join(F.broadcast(ids), F.col(id_col) == F.col("_vl_id"))
    found = found.withColumn("_vl_r", F.row_number().over(Window.partitionBy("_vl_id").orderBy("_vl_h")))
    found = found.where(F.col("_vl_r") <= F.col("_vl_n"))
    if name:
        found = found.withColumn(name, (F.col("_vl_place") + F.col("_vl_r") - 1).cast("long"))
    return found.select(*df.columns, "sort_key", *([name] if name else []))


def sample_n(df: DataFrame, n: int, id_col: str, seed: int = 42, name: str = "position",
             with_position: bool = True) -> DataFrame:
    """The first ``min(n, available)`` rows of the seed's permutation.

    Never fails on a shortfall (see ``sample_shortfall``). Up to SAMPLE_STATE
    rows are found by one narrow pass (``_bottom_sample``). Beyond: count rows per
    key bucket (65,536 buckets), keep whole buckets below the cut in the
    scan, and rank only what has to be ranked. Both give the same rows.
    """
    if n < 0:
        raise ValueError("n must be >= 0")
    if n <= SAMPLE_STATE:
        return _bottom_sample(df, n, id_col, seed, name if with_position else None)
    keyed = _keyed(df, id_col, seed)
    cum = _bucket_offsets(keyed).where(F.col("_vl_before") < n)
    if with_position:
        # every kept row needs its rank: rank inside the kept buckets, cut at n
        ranked = _rank_in_buckets(keyed, cum.select("_vl_bucket", "_vl_before"), id_col, name)
        return ranked.where(F.col(name) < n).drop("_vl_bucket", "_vl_before", "_vl_h")
    joined = keyed.join(F.broadcast(cum), "_vl_bucket")
    whole = joined.where(F.col("_vl_after") <= n)
    in_bucket = Window.partitionBy("_vl_bucket").orderBy("sort_key", id_col, "_vl_h")
    cut = (joined.where(F.col("_vl_after") > n).withColumn("_vl_r", F.row_number().over(in_bucket))
           .where(F.col("_vl_before") + F.col("_vl_r") <= n).drop("_vl_r"))
    helpers = ("_vl_bucket", "_vl_before", "_vl_after", "_vl_h")
    return whole.drop(*helpers).unionByName(cut.drop(*helpers))


def sample_shortfall(df: DataFrame, n: int, id_col: str, seed: int = 42) -> DataFrame:
    """One row: requested, available, taken, and whether the take fell short."""
    available = df.agg(F.count(F.lit(1)).alias("available"))
    return available.select(
        F.lit(int(n)).cast("long").alias("requested"),
        F.col("available").cast("long").alias("available"),
        F.least(F.lit(int(n)).cast("long"), F.col("available")).alias("taken"),
        (F.col("available") < F.lit(int(n))).alias("shortfall"),
    )


def train_test_split(corpus: DataFrame, train_n: int, test_n: int, id_col: str = "doc_id",
                     seed: int = 42, split_col: str = "split") -> DataFrame:
    """Two independent takes, one per split, with the same seed."""
    train = sample_n(corpus.where(F.col(split_col) == "train"), train_n, id_col, seed)
    test = sample_n(corpus.where(F.col(split_col) == "test"), test_n, id_col, seed)
    return train.unionByName(test)


def label_vocab(corpus: DataFrame, name_col: str = "lang", split_col: str = "split",
                from_split: str | None = "train") -> DataFrame:
    """P5: dense label ids from the full (unsampled) split's distinct names.

    The distinct set is tiny (one row per class); the dense rank runs over it
    only, never over the corpus.
    """
    src = corpus if from_split is None else corpus.where(F.col(split_col) == from_split)
    names = src.select(F.col(name_col).alias("label_name")).where(F.col("label_name").isNotNull()).distinct()
    w = Window.orderBy("label_name")
    return names.select((F.dense_rank().over(w) - 1).cast("int").alias("label"), "label_name")
