"""The corpus pipeline: quality filter, line dedup, near-dedup, decontamination, packing.

Every stage calls one operator of ``vectorloom.llm`` over all rows its predecessor kept. The
first four return the columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vectorloom.llm import decontam, lines, minhash, packing, quality
from vectorloom.llm.common import materialize
from vectorloom.sources.tables import read_table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_quality(docs, read_table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in the smallest document that holds them; documents left without any go."""
    return lines.dedup_lines(docs, drop_emptied=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, judged on the texts as they came in, since line dedup has
    taken the shared lines from all copies but one, and then on the texts that line dedup has left."""
    return minhash.keep_one(docs, read_table(spark, sf_dir, "documents"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest, packed along the curve."""
    return packing.pack_along_curve(docs)


STAGES = [("quality", quality_filter), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("decontamination", decontaminate), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to ``documents``; each result is written and read back before the next stage."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


# The trained classifier and the tokenizer have no SQL form; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None
