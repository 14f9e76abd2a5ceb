"""Vector export (S7): one JSON document per vector, plus its file name.

The reference saves a single inspected vector to
``<model>_dim<width>_<device>.json``. Here every row gets the JSON text and
that name as columns, and ``write_vectors`` writes the table once
(partitioned by name) instead of one file per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def export_name(model: Column, width: Column, device: Column) -> Column:
    return F.concat(model, F.lit("_dim"), width.cast("string"), F.lit("_"), device)


def vector_export(df: DataFrame, model_size: str, backend: str, device: str, native: int,
                  vector: str = "embedding", text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, file_name, json) with text, model, backend, device label, widths, vector."""
    return df.select(key, *export_columns(model_size, backend, device, native, vector, text))


def export_columns(model_size: str, backend: str, device: str, native: int,
                   vector: str = "embedding", text: str = "text") -> list[Column]:
    """The ``file_name`` and ``json`` columns of S7, for use inside any projection."""
    device_label = "mlx" if backend == "mlx" else device
    width = F.size(F.col(vector))
    doc = F.struct(
        F.col(text).alias("text"),
        F.lit(model_size).alias("model_size"),
        F.lit(backend).alias("backend"),
        F.lit(device_label).alias("device"),
        F.lit(int(native)).alias("native_hidden_size"),
        width.alias("output_dimension"),
        F.col(vector).alias("vector"),
    )
    return [export_name(F.lit(model_size), width, F.lit(device_label)).alias("file_name"),
            F.to_json(doc).alias("json")]


def write_vectors(exported: DataFrame, path: str) -> str:
    exported.select("file_name", "json").write.mode("append").partitionBy("file_name").text(path)
    return path
