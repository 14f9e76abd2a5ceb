"""Workflow C: inspect vectors, one summary row per text.

``encode (batch 1, normalised) -> width / norm / min / max / mean / std ->
head and tail previews -> JSON export``. The reference inspects one text;
this runs over any frame of texts (filter it to one row to inspect one).
The text travels through the encoder with its key, and the summary and
the export are one projection: no join and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.functions import vector as V
from vectorloom.operators.encode import encode
from vectorloom.sources.export import export_columns


def inspect_texts(texts: DataFrame, encoder, dimension: int | None = None, n: int = 10,
                  model_size: str = "hashed-64", backend: str = "torch", device: str = "cuda",
                  key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, width, element_type, l2_norm, min/max/mean/std, head, tail, file_name, json)."""
    vecs = encode(texts.select(key, text_col), encoder, text_col, key, batch_size=1,
                  dimension=dimension, normalize=True, carry=[text_col])
    v = F.col("embedding")
    return vecs.select(
        key,
        F.size(v).alias("width"),
        F.lit("float32").alias("element_type"),
        V.l2_norm(v).alias("l2_norm"),
        F.array_min(v).cast("double").alias("min_value"),
        F.array_max(v).cast("double").alias("max_value"),
        V.vec_mean(v).alias("mean_value"),
        V.vec_std_pop(v).alias("std_value"),
        V.preview_head(v, n).alias("head"),
        V.preview_tail(v, n).alias("tail"),
        *export_columns(model_size, backend, device, encoder.native_dim, "embedding", text_col),
    )
