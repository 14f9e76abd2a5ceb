"""Labelled corpus scans (S1-S3) over ``documents``.

The corpus has no split column, so one is derived from a hash of the id
(train < 80, validation < 90, else test on a 0-99 bucket). The label is the
document language, coded through the vocabulary of the full train split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.functions.keys import split_name
from vectorloom.operators.sampling import label_vocab, sample_n
from vectorloom.sources.tables import read_table


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, split, text, lang): the documents table with a derived split."""
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", split_name("doc_id").alias("split"), "text", "lang")


# Upper bound on the label vocabulary turned into a literal map expression;
# above it, labels are attached with a join instead.
MAX_LITERAL_CLASSES = 10_000


def vocab_mapping(vocab: DataFrame, max_classes: int = MAX_LITERAL_CLASSES):
    """(number of classes, literal map name -> id, or None above the bound).

    The vocabulary (one row per class) is fetched only up to ``max_classes``
    rows, so the driver never holds more than that; the fetch is what proves
    the lookup small enough to inline.
    """
    rows = vocab.limit(max_classes + 1).collect()
    if len(rows) > max_classes:
        return vocab.count(), None
    mapping = F.create_map(*[F.lit(x) for r in rows for x in (r["label_name"], r["label"])]) if rows else None
    return len(rows), mapping


def attach_label(c: DataFrame, vocab: DataFrame, mapping, name_col: str = "lang") -> DataFrame:
    """Add ``label`` (null for a name outside the vocabulary).

    With a literal map the lookup is a projection: the corpus is not
    shuffled. Above the bound it is a left join that the planner sizes.
    """
    if mapping is not None:
        return c.withColumn("label", F.element_at(mapping, F.col(name_col)).cast("int"))
    return c.join(vocab, c[name_col] == vocab["label_name"], "left").drop("label_name")


def labelled_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 (whole corpus): doc_id, split, text, label id, label name.

    The label comes from the vocabulary of the full train split. A
    vocabulary of up to MAX_LITERAL_CLASSES names becomes a literal map, so
    the corpus (texts included) is never shuffled for the lookup.
    """
    c = corpus(spark, sf_dir)
    vocab = label_vocab(c)
    _, mapping = vocab_mapping(vocab)
    return (attach_label(c, vocab, mapping)
            .select("doc_id", "split", "text", "label", F.col("lang").alias("label_name")))


def sample_texts(spark: SparkSession, sf_dir: str, num_samples: int, split: str = "test",
                 seed: int = 42) -> DataFrame:
    """Unlabelled texts, the first ``num_samples`` of one split's shuffle."""
    c = corpus(spark, sf_dir).where(F.col("split") == split).select("doc_id", "text")
    return sample_n(c, num_samples, "doc_id", seed).select("doc_id", "text", "position")


def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: rows per split (all three)."""
    return corpus(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))
