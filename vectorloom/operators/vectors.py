"""Vector operators V4-V12: truncation, normalisation, statistics, previews.

All are per-row built-in expressions (no shuffle) except ``norm_stats``,
which is one global aggregate with map-side partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.functions import vector as V


def mrl_truncate(df: DataFrame, dimension: int | None, col: str = "embedding",
                 out: str | None = None) -> DataFrame:
    """V4 (+V9): first ``dimension`` values as float32, before any normalising."""
    return df.withColumn(out or col, V.truncate(F.col(col).cast("array<float>"), dimension))


ENGINES = ("jvm", "arrow")


def _normalize_arrow(df: DataFrame, col: str, out: str) -> DataFrame:
    """V6 as numpy over Arrow batches: every column passes through untouched.

    Squares are summed in double in element order (``bincount`` accumulates
    sequentially, like the JVM fold), then each value is divided by the
    clamped norm and cast to float32. Rows may differ in width; a null
    vector stays null.
    """
    eps = V.NORM_EPS
    names = df.columns
    idx = names.index(col)
    target = out if out != col else col
    out_names = names if target == col else names + [target]

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        for rb in batches:
            arr = rb.column(idx)
            n = rb.num_rows
            lengths = pc.fill_null(pc.list_value_length(arr), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.list_flatten(arr).to_numpy(zero_copy_only=False).astype(np.float64)
            rows = np.repeat(np.arange(n), lengths)
            norms = np.sqrt(np.bincount(rows, weights=flat * flat, minlength=n))
            unit = (flat / np.maximum(norms, eps)[rows]).astype(np.float32)
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
            vec = pa.ListArray.from_arrays(offsets, pa.array(unit, type=pa.float32()), mask=arr.is_null())
            cols = [rb.column(i) for i in range(rb.num_columns)]
            if target == col:
                cols[idx] = vec
            else:
                cols.append(vec)
            yield pa.RecordBatch.from_arrays(cols, names=out_names)

    from pyspark.sql import types as T
    fields = [T.StructField(f.name, T.ArrayType(T.FloatType()) if f.name == col and target == col else f.dataType,
                            f.nullable) for f in df.schema.fields]
    if target != col:
        fields.append(T.StructField(target, T.ArrayType(T.FloatType())))
    return df.mapInArrow(run, T.StructType(fields))


def l2_normalize(df: DataFrame, col: str = "embedding", out: str | None = None,
                 engine: str = "jvm") -> DataFrame:
    """V6: unit L2 norm per row; a zero vector stays zero.

    ``engine="jvm"`` (default) is a built-in expression, planned with the
    rest of the projection. ``engine="arrow"`` runs the same arithmetic in
    numpy over Arrow batches: about 2x faster per element for 64- to
    4,096-wide vectors in local measurements, at the cost of a Python
    worker per task. Pick it by measurement for wide vectors.
    """
    if engine not in ENGINES:
        raise ValueError(f"engine must be one of {ENGINES}")
    if engine == "arrow":
        return _normalize_arrow(df.withColumn(col, F.col(col).cast("array<float>")), col, out or col)
    return df.withColumn(out or col, V.normalize(col))


def truncate_normalize(df: DataFrame, dimension: int | None, normalize: bool = True,
                       col: str = "embedding", out: str | None = None, engine: str = "jvm") -> DataFrame:
    """The encoder's post-processing: cast, truncate, then (optionally) normalise."""
    v = V.truncate(F.col(col).cast("array<float>"), dimension)
    if normalize and engine == "arrow":
        return l2_normalize(df.withColumn(out or col, v), out or col, out or col, engine="arrow")
    return df.withColumn(out or col, V.normalize(v) if normalize else v)


def renormalize_truncated(df: DataFrame, dimension: int | None, col: str = "embedding",
                          out: str | None = None) -> DataFrame:
    """V7: the second backend's path: unit vector -> truncate -> renormalise.

    Always normalised, whatever a ``normalize`` flag says; no zero guard, so
    a zero vector after truncation gives null (deviation: not NaN).
    """
    unit = V.normalize(col)
    return df.withColumn(out or col, V.renormalize(V.truncate(unit, dimension)))


def mrl_path_check(df: DataFrame, dimension: int, col: str = "embedding", key: str = "vec_id") -> DataFrame:
    """V8: max |truncate->normalise - normalise->truncate->normalise| per row."""
    a = V.normalize(V.truncate(F.col(col).cast("array<float>"), dimension))
    b = V.renormalize(V.truncate(V.normalize(col), dimension))
    return df.select(key, V.max_abs_diff(a, b).alias("max_abs_diff"))


def norm_stats(df: DataFrame, col: str = "embedding") -> DataFrame:
    """Mean and population std of the row norms (one output row)."""
    norms = df.select(V.l2_norm(col).alias("_n"))
    return norms.agg(F.count(F.lit(1)).alias("n_vectors"),
                     F.avg("_n").alias("mean_l2_norm"),
                     F.stddev_pop("_n").alias("std_l2_norm"))


def vector_summary(df: DataFrame, col: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Width, norm, min, max, mean, population std of each vector."""
    v = F.col(col)
    return df.select(
        key,
        F.size(v).alias("width"),
        V.l2_norm(v).alias("l2_norm"),
        F.array_min(v).cast("double").alias("min_value"),
        F.array_max(v).cast("double").alias("max_value"),
        V.vec_mean(v).alias("mean_value"),
        V.vec_std_pop(v).alias("std_value"),
    )


def element_type(df: DataFrame, col: str = "embedding") -> Column:
    """The element type name of the vector column (``float`` for float32)."""
    return F.lit(df.schema[col].dataType.elementType.simpleString())


def vector_preview(df: DataFrame, n: int = 10, col: str = "embedding", key: str = "vec_id") -> DataFrame:
    """First ``n`` and last ``n`` values (n = 0 -> both empty)."""
    return df.select(key, V.preview_head(col, n).alias("head"), V.preview_tail(col, n).alias("tail"))
