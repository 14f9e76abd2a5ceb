"""Incremental vector post-processing over a file stream.

The reference has no streaming operator. What it does have is stateless
per-row work (truncate, normalise, hash-encode), and those operators take a
streaming DataFrame unchanged: this module wires them to a parquet file
source and sink. Progress (the source offsets and the sink's commit log) is
kept in a checkpoint folder under the shared ``spark.checkpoint.dir``, so a
restarted query picks up only files it has not processed, and the sink's
commit log makes each file's output appear exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from vectorloom.operators.encode import encode, encode_hashed
from vectorloom.operators.vectors import truncate_normalize
from vectorloom.session import scratch_path

# Files picked up per micro-batch: bounds the size of one batch when a
# backlog of many files is waiting.
MAX_FILES_PER_TRIGGER = 64


def read_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A parquet file stream with an explicit schema (no inference pass)."""
    return (spark.readStream.schema(schema)
                 .option("maxFilesPerTrigger", MAX_FILES_PER_TRIGGER)
                 .parquet(path))


def normalized_vectors(stream: DataFrame, dimension: int | None, col: str = "embedding") -> DataFrame:
    """V4 -> V6 on each arriving row (no state, no shuffle)."""
    return truncate_normalize(stream, dimension, True, col)


def hashed_vectors(stream: DataFrame, dimension: int = 64, text_col: str = "text",
                   key: str = "doc_id") -> DataFrame:
    """V2 on each arriving document."""
    return encode_hashed(stream, dimension, text_col, key)


def encoded_vectors(stream: DataFrame, encoder, dimension: int | None = None, normalize: bool = True,
                    text_col: str = "text", key: str = "doc_id", batch_size: int = 16) -> DataFrame:
    """V1 on each arriving document: the pluggable encoder, loaded once per task."""
    return encode(stream, encoder, text_col, key, batch_size, dimension, normalize)


def run_available(processed: DataFrame, sink_path: str, checkpoint: str | None = None,
                  name: str = "vectors") -> str:
    """Process everything available now, write parquet, stop; returns the checkpoint.

    Call again after new files arrive: only those are processed.
    """
    spark = processed.sparkSession
    ckpt = checkpoint or scratch_path(spark, f"stream-{name}")
    query = (processed.writeStream.format("parquet")
                      .option("path", sink_path)
                      .option("checkpointLocation", ckpt)
                      .outputMode("append")
                      .trigger(availableNow=True)
                      .start())
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return ckpt
