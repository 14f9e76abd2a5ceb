"""Comparison reports over run records: R5-R10, R13, P6-P9, S8.

Aggregations shrink the run table to one row per cell first (partial
aggregation on the map side); joins and windows then run on those cell
frames, whose size is bounded by the number of configurations, not runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.functions.fmt import fmt_float, fmt_plain
from vectorloom.operators.sampling import global_position
from vectorloom.sources.runs import MODEL_PARAMS

# The report's dimension categories, in order.
DIMENSION_ORDER = ["768", "1024", "default"]

# Report columns (key, label) of the embedding comparison.
EMBEDDING_COLUMNS = [
    ("model_size", "Model"),
    ("backend", "Backend"),
    ("device", "Device"),
    ("requested_dimension", "ReqDim"),
    ("output_dimension", "OutDim"),
    ("native_hidden_size", "NativeDim"),
    ("status", "Status"),
    ("embed_generation_time_sec", "Time(s)"),
    ("throughput_samples_per_sec", "Samples/s"),
    ("peak_mem_gb", "PeakMem(GB)"),
    ("mean_l2_norm", "MeanNorm"),
]
# Report columns (key, label) of the classification comparison.
CLASSIFICATION_COLUMNS = [
    ("model_size", "Model"),
    ("mode", "Mode"),
    ("device", "Device"),
    ("status", "Status"),
    ("embed_extraction_time_sec", "Embed(s)"),
    ("embed_extraction_samples_per_sec", "Embed/s"),
    ("train_time_sec", "Train(s)"),
    ("total_time_sec", "Total(s)"),
    ("train_peak_mem_gb", "PeakMem(GB)"),
    ("accuracy", "Accuracy"),
    ("macro_f1", "MacroF1"),
]


def runs_union(*frames: DataFrame) -> DataFrame:
    """Union by column name; a key missing from a frame becomes null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def successful(runs: DataFrame) -> DataFrame:
    """P6."""
    return runs.where(F.col("status") == "success")


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def runs_sorted(runs: DataFrame, keys=("model_size", "backend", "device", "requested_dimension")) -> DataFrame:
    """Position in (keys..., run_id) order; a missing key sorts as ''.

    ``requested_dimension`` compares as a string (1024 < 768 < default). The
    run id is the tie-break: the reference's stable sort keeps file-name
    order, and file names start with the run id.
    """
    return global_position(runs, [_blank(k) for k in keys] + [F.col("run_id")])


def dimension_rank(c: Column) -> Column:
    """0, 1, 2 for 768, 1024, default; null for anything else."""
    expr = None
    for i, d in enumerate(DIMENSION_ORDER):
        expr = F.when(c == d, F.lit(i)) if expr is None else expr.when(c == d, F.lit(i))
    return expr.cast("int")


def runs_ranked(runs: DataFrame) -> DataFrame:
    """Ordered-category sort; unlisted dimensions get a null rank and sort last."""
    ranked = runs.withColumn("dim_rank", dimension_rank(F.col("requested_dimension")))
    order = [F.col("model_size").asc_nulls_last(), F.col("backend").asc_nulls_last(),
             F.col("device").asc_nulls_last(), F.col("dim_rank").asc_nulls_last(),
             F.col("requested_dimension").asc_nulls_last(), F.col("run_id")]
    return global_position(ranked, order)


def _pivot(runs: DataFrame, value: str) -> DataFrame:
    ok = successful(runs).where(F.col("model_size").isNotNull() & F.col("backend").isNotNull()
                                & F.col("device").isNotNull())
    piv = (ok.groupBy("model_size", "backend", "device")
             .pivot("requested_dimension", DIMENSION_ORDER)
             .agg(F.avg(value)))
    return piv.na.drop(how="all", subset=DIMENSION_ORDER)


def throughput_pivot(runs: DataFrame) -> DataFrame:
    """Mean throughput per (model, backend, device) x dimension, successes only.

    Pivot values are pinned (no extra job to discover them). Groups whose
    values are all null vanish, as do unlisted dimensions; the three
    dimension columns are always present (stable schema; deviation).
    """
    return _pivot(runs, "throughput_samples_per_sec")


def memory_pivot(runs: DataFrame) -> DataFrame:
    """The same pivot over peak memory."""
    return _pivot(runs, "peak_mem_gb")


def _formatted(df: DataFrame, columns) -> list[Column]:
    out = []
    for key, label in columns:
        dtype = df.schema[key].dataType.simpleString() if key in df.columns else "string"
        src = F.col(key) if key in df.columns else F.lit(None).cast("string")
        out.append((fmt_float(src) if dtype in ("double", "float") else fmt_plain(src)).alias(label))
    return out


def _report(runs: DataFrame, columns, keys) -> DataFrame:
    """Sort and format, with only the report's columns, its keys and the run id in the sort."""
    needed = dict.fromkeys([c for c, _ in columns if c in runs.columns] + list(keys) + ["run_id"])
    ordered = runs_sorted(runs.select(*needed), keys)
    return ordered.select(F.col("position"), *_formatted(ordered, columns))


def report_embedding(runs: DataFrame) -> DataFrame:
    """R8 (generation): sorted, renamed, floats as %.3f, missing as '-'."""
    return _report(runs, EMBEDDING_COLUMNS, ("model_size", "backend", "device", "requested_dimension"))


def report_classification(runs: DataFrame) -> DataFrame:
    """R8 (classification)."""
    return _report(runs, CLASSIFICATION_COLUMNS, ("model_size", "mode", "device"))


def cell_throughput(runs: DataFrame) -> DataFrame:
    """Mean throughput of successful runs per (model, backend, device, dimension)."""
    return (successful(runs)
            .where(F.col("backend").isNotNull())
            .groupBy("model_size", "backend", "device", "requested_dimension")
            .agg(F.avg("throughput_samples_per_sec").alias("throughput")))


def gpu_speedup(runs: DataFrame) -> DataFrame:
    """Cuda / cpu throughput per (model, backend, dimension); 'n/a' without a CPU cell."""
    cells = cell_throughput(runs)
    gpu = cells.where(F.col("device") == "cuda").select(
        "model_size", "backend", "requested_dimension", F.col("throughput").alias("gpu_throughput"))
    cpu = cells.where(F.col("device") == "cpu").select(
        "model_size", "backend", "requested_dimension", F.col("throughput").alias("cpu_throughput"))
    joined = gpu.join(cpu, ["model_size", "backend", "requested_dimension"], "left")
    speed = F.try_divide(F.col("gpu_throughput"), F.col("cpu_throughput"))
    return joined.select(
        "model_size", "backend", "requested_dimension", "gpu_throughput", "cpu_throughput",
        speed.alias("speedup"),
        F.when(speed.isNull(), F.lit("n/a"))
         .otherwise(F.concat(fmt_float(speed, 2), F.lit("x"))).alias("speedup_label"),
    )


def size_step_ratio(runs: DataFrame, dimension: str = "default") -> DataFrame:
    """Throughput of the next smaller model / this model, per backend and device.

    The window runs over the per-cell means (a handful of rows per device).
    """
    params = F.element_at(F.create_map(*[F.lit(x) for kv in MODEL_PARAMS.items() for x in kv]),
                          F.col("model_size"))
    cells = (cell_throughput(runs).where(F.col("requested_dimension") == dimension)
             .withColumn("params", params))
    w = Window.partitionBy("backend", "device").orderBy("params")
    return cells.select(
        "model_size", "backend", "device", "throughput",
        F.lag("model_size").over(w).alias("smaller_model"),
        F.try_divide(F.lag("throughput").over(w), F.col("throughput")).alias("step_ratio"),
    )


def status_counts(runs: DataFrame, by=("status",)) -> DataFrame:
    """R13."""
    return runs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_runs"))


def write_report(runs: DataFrame, path: str, fmt: str = "parquet") -> dict[str, str]:
    """The three report sheets as three tables under ``path``.

    ``raw_results`` always; the two pivots too (empty, full schema, when no
    run succeeded: deviation, the reference skips those sheets).
    """
    sheets = {
        "raw_results": runs_ranked(runs),
        "throughput_samples_per_sec": throughput_pivot(runs),
        "peak_mem_gb": memory_pivot(runs),
    }
    out = {}
    for name, df in sheets.items():
        target = f"{path.rstrip('/')}/{name}"
        writer = df.write.mode("overwrite")
        (writer.option("header", True).csv(target) if fmt == "csv" else writer.parquet(target))
        out[name] = target
    return out
