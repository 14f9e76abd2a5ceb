"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import contextvars
from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.session import remove_scratch, scratch_path

__all__ = ["ASCII_SPACE", "few", "free_name", "int64", "map_rows", "materialize", "remove_scratch", "scan_tasks", "signed",
           "small_batches", "temporary", "text_bytes", "written"]

#: The bytes the operators treat as white space: space, tab, LF, VT, FF, CR.
ASCII_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"

#: Rows and bytes per Arrow batch handed to Python; texts are long, so batches stay small.
BATCH_ROWS = 512
BATCH_BYTES = 4 << 20


#: Rows of documents (texts, sketches) and of pairs of ids that fill a file.
FILE_ROWS = 4096
PAIR_ROWS = 65536


def few(df: DataFrame, rows: int, per: int = FILE_ROWS) -> DataFrame:
    """``df`` dealt into as many partitions as about ``rows`` rows fill, if the session's shuffles make over twice as many.

    A table of few rows else becomes one small file for each shuffle partition, and on a local disk
    Hadoop's writer starts processes for each. Rows are dealt out anew, since one task that runs many
    partitions of a join (``coalesce``) keeps the memory of all until it ends.
    """
    n = max(1, -(-rows // per))
    return df.repartition(n) if scan_tasks(df.sparkSession) > 2 * n else df


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back.

    Cuts the lineage with a table every executor can read, so a lost executor
    costs only its running tasks.
    """
    return written(df, name)[0]


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``materialize``, with the table's path, for those who replace it later."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    if (held := _HELD.get()) is not None:
        held.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


#: Paths written inside ``temporary``.
_HELD: contextvars.ContextVar[list | None] = contextvars.ContextVar("held", default=None)


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """The tables that ``materialize`` writes inside go at the end."""
    paths: list[str] = []
    token = _HELD.set(paths)
    try:
        yield
    finally:
        _HELD.reset(token)
        for path in paths:
            remove_scratch(spark, path)


def free_name(columns: list[str], base: str) -> str:
    """``base``, with as many underscores in front as keep it from naming one of ``columns`` (in any case)."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def text_bytes(column: str = "text"):
    """The text as UTF-8 bytes; null becomes empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def small_batches(df: DataFrame, rows: int = BATCH_ROWS) -> None:
    """Bound the Arrow batches of this session's Python tasks."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_rows(df: DataFrame, fn: Callable[[Iterator[dict]], Iterator[dict]], schema: str, rows: int = BATCH_ROWS) -> DataFrame:
    """``mapInArrow`` over dictionaries of Python columns: ``fn`` gets and yields column dicts.

    Each yielded dict becomes one Arrow batch, so a task never holds more than
    the batch it works on; ``rows`` may be larger where rows are narrow.
    """
    small_batches(df, rows)
    target = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def columns() -> Iterator[dict]:
            for batch in batches:
                if batch.num_rows:
                    yield {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        for out in fn(columns()):
            yield pa.RecordBatch.from_arrays(
                [v if isinstance(v := out[f.name], pa.Array) else pa.array(v, type=f.type) for f in arrow],
                schema=arrow)

    return df.mapInArrow(run, schema)


def int64(values) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.int64))


def signed(x: int) -> int:
    """An unsigned 64-bit hash as Spark's signed long."""
    return x - (1 << 64) if x >= 1 << 63 else x


def scan_tasks(spark: SparkSession) -> int:
    """Partitions for a shuffle of the session's own size."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
