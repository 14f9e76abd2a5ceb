"""Run records: the derived run tables, and JSON run files (read/write).

The reference writes one indented JSON object per run and later globs a
directory of them. Here run records are one table: written once with
``partitionBy("status")`` and read back with an explicit, all-nullable schema
(missing keys become null). Both record kinds can also be derived from the
``events`` table so that every report runs over real volume.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorloom.sources.tables import read_table

log = logging.getLogger("vectorloom.runs")

# The model sizes, their native widths, parameter counts and
# per-model batch sizes of the reference's benchmark grid.
MODEL_SIZES = ["0.6b", "4b", "8b"]
NATIVE_HIDDEN = {"0.6b": 1024, "4b": 2560, "8b": 4096}
MODEL_PARAMS = {"0.6b": 0.6e9, "4b": 4e9, "8b": 8e9}
GRID_BATCH_SIZES = {"0.6b": 16, "4b": 8, "8b": 4}
# Requested dimensions seen in the derived embedding runs
# (512 is outside the report's category list on purpose).
DERIVED_DIMENSIONS = ["768", "1024", "default", "512"]

EMBEDDING_RUN_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("model_size", T.StringType()),
    T.StructField("backend", T.StringType()),
    T.StructField("device", T.StringType()),
    T.StructField("requested_dimension", T.StringType()),
    T.StructField("num_samples", T.IntegerType()),
    T.StructField("batch_size", T.IntegerType()),
    T.StructField("max_length", T.IntegerType()),
    T.StructField("actual_num_samples", T.IntegerType()),
    T.StructField("native_hidden_size", T.IntegerType()),
    T.StructField("output_dimension", T.IntegerType()),
    T.StructField("embed_generation_time_sec", T.DoubleType()),
    T.StructField("throughput_samples_per_sec", T.DoubleType()),
    T.StructField("mean_l2_norm", T.DoubleType()),
    T.StructField("std_l2_norm", T.DoubleType()),
    T.StructField("peak_mem_gb", T.DoubleType()),
    T.StructField("status", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("started_at", T.TimestampNTZType()),
])

CLASSIFICATION_RUN_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("model_size", T.StringType()),
    T.StructField("mode", T.StringType()),
    T.StructField("device", T.StringType()),
    T.StructField("train_samples", T.IntegerType()),
    T.StructField("test_samples", T.IntegerType()),
    T.StructField("epochs", T.IntegerType()),
    T.StructField("batch_size", T.IntegerType()),
    T.StructField("max_length", T.IntegerType()),
    T.StructField("lr", T.DoubleType()),
    T.StructField("num_classes", T.IntegerType()),
    T.StructField("actual_train_samples", T.IntegerType()),
    T.StructField("actual_test_samples", T.IntegerType()),
    T.StructField("embed_extraction_time_sec", T.DoubleType()),
    T.StructField("embed_extraction_samples_per_sec", T.DoubleType()),
    T.StructField("embed_extraction_peak_mem_gb", T.DoubleType()),
    T.StructField("train_time_sec", T.DoubleType()),
    T.StructField("train_peak_mem_gb", T.DoubleType()),
    T.StructField("total_time_sec", T.DoubleType()),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("macro_f1", T.DoubleType()),
    T.StructField("weighted_f1", T.DoubleType()),
    T.StructField("status", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("started_at", T.TimestampNTZType()),
])


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _by_model(mapping: dict, model: Column) -> Column:
    expr = None
    for key, value in mapping.items():
        expr = (F.when(model == key, F.lit(value)) if expr is None
                else expr.when(model == key, F.lit(value)))
    return expr


def effective_dimension(requested: Column, native: Column) -> Column:
    """``'default'`` -> native width; an integer -> min(integer, native).

    A value that is not an integer (or is below 1) gives null, which marks
    the run as failed: the reference crashes on ``int('abc')`` before any
    record exists. The explicit null test matters because ``least`` skips
    nulls.
    """
    as_int = requested.try_cast("int")
    return (F.when(requested == "default", native)
             .when(as_int.isNull() | (as_int < 1), F.lit(None).cast("int"))
             .otherwise(F.least(as_int, native)))


def embedding_runs(spark: SparkSession, sf_dir: str, carry: tuple = ()) -> DataFrame:
    """Embedding-generation run records derived from ``events`` (one per event).

    ``carry`` names ``events`` columns to append unchanged, so a caller that
    needs one (say ``event_type``) gets it from the same scan instead of
    joining the records back to the table they came from.
    """
    ev = read_table(spark, sf_dir, "events")
    carry = list(carry)
    ok = F.col("event_type") != "error"
    model = _pick(MODEL_SIZES, F.col("user_id") % 3)
    dims = _pick(DERIVED_DIMENSIONS, F.expr("(event_id div 2) % 4"))
    native = _by_model(NATIVE_HIDDEN, F.col("model_size")).cast("int")
    df = ev.select(
        F.col("event_id").cast("string").alias("run_id"),
        model.alias("model_size"),
        F.when(F.col("event_type") == "signup", F.lit(None).cast("string"))
         .when(F.col("event_id") % 5 == 0, F.lit("mlx")).otherwise(F.lit("torch")).alias("backend"),
        F.when(F.col("event_id") % 2 == 0, F.lit("cpu")).otherwise(F.lit("cuda")).alias("device"),
        dims.alias("requested_dimension"),
        F.lit(500).cast("int").alias("num_samples"),
        F.col("value"), ok.alias("_ok"), F.col("props"), F.col("ts"), *carry,
    )
    df = df.select(
        "run_id", "model_size", "backend", "device", "requested_dimension", "num_samples",
        _by_model(GRID_BATCH_SIZES, F.col("model_size")).cast("int").alias("batch_size"),
        F.lit(256).cast("int").alias("max_length"),
        F.when(F.col("_ok"), F.lit(500)).cast("int").alias("actual_num_samples"),
        F.when(F.col("_ok"), native).cast("int").alias("native_hidden_size"),
        F.when(F.col("_ok"), effective_dimension(F.col("requested_dimension"), native))
         .cast("int").alias("output_dimension"),
        F.col("value").alias("embed_generation_time_sec"),
        F.when(F.col("_ok"), F.try_divide(F.lit(500.0), F.col("value"))).alias("throughput_samples_per_sec"),
        F.when(F.col("_ok"), F.lit(1.0)).alias("mean_l2_norm"),
        F.when(F.col("_ok"), F.lit(0.0)).alias("std_l2_norm"),
        F.when(F.col("_ok"), F.round(F.col("value") / 100, 4)).alias("peak_mem_gb"),
        F.when(F.col("_ok"), F.lit("success")).otherwise(F.lit("failed")).alias("status"),
        F.when(~F.col("_ok"), F.concat(F.lit("run failed: "), F.col("props"))).alias("error"),
        F.col("ts").alias("started_at"),
        *carry,
    )
    return df


def classification_runs(spark: SparkSession, sf_dir: str, with_backend: bool = False) -> DataFrame:
    """Classification run records derived from ``events``; ``with_backend`` adds the backend they ran on.

    ``epochs``, ``batch_size`` and ``lr`` hold what the user passed: null for
    ``view`` events, so the mode defaults apply (see ``mode_defaults``).
    ``total_time_sec`` follows the reference: extraction + training when
    frozen, training only for the adapter mode.
    """
    ev = read_table(spark, sf_dir, "events")
    ok = F.col("event_type") != "error"
    frozen = F.col("mode") == "frozen"
    given = F.col("event_type") != "view"
    df = ev.select(
        F.col("event_id"), F.col("user_id"), F.col("value"), F.col("props"), F.col("ts"),
        ok.alias("_ok"), given.alias("_given"),
        _pick(MODEL_SIZES, F.col("user_id") % 3).alias("model_size"),
        F.when(F.expr("(event_id div 3) % 2") == 0, F.lit("frozen")).otherwise(F.lit("lora")).alias("mode"),
        F.when(F.col("event_id") % 2 == 0, F.lit("cpu")).otherwise(F.lit("cuda")).alias("device"),
    )
    extraction = F.when(F.col("_ok") & frozen, F.col("value"))
    train = F.when(F.col("_ok"), F.round(F.col("value") / 4, 4))
    return df.select(
        F.col("event_id").cast("string").alias("run_id"),
        "model_size", "mode", "device",
        F.lit(2000).cast("int").alias("train_samples"),
        F.lit(500).cast("int").alias("test_samples"),
        F.when(F.col("_given"), 1 + F.col("event_id") % 10).cast("int").alias("epochs"),
        F.when(F.col("_given"), 8 * (1 + F.col("user_id") % 4)).cast("int").alias("batch_size"),
        F.lit(256).cast("int").alias("max_length"),
        F.when(F.col("_given"), F.lit(0.0001) * (1 + F.col("event_id") % 10)).alias("lr"),
        F.when(F.col("_ok"), F.lit(151)).cast("int").alias("num_classes"),
        F.when(F.col("_ok"), F.lit(2000)).cast("int").alias("actual_train_samples"),
        F.when(F.col("_ok"), F.lit(500)).cast("int").alias("actual_test_samples"),
        extraction.alias("embed_extraction_time_sec"),
        F.when(F.col("_ok") & frozen, F.try_divide(F.lit(2500.0), F.col("value")))
         .alias("embed_extraction_samples_per_sec"),
        F.when(F.col("_ok") & frozen, F.round(F.col("value") / 100, 4)).alias("embed_extraction_peak_mem_gb"),
        train.alias("train_time_sec"),
        F.when(F.col("_ok"), F.round(F.col("value") / 50, 4)).alias("train_peak_mem_gb"),
        F.when(frozen, extraction + train).otherwise(train).alias("total_time_sec"),
        F.when(F.col("_ok"), F.round(F.col("value") / 600, 6)).alias("accuracy"),
        F.when(F.col("_ok"), F.round(F.col("value") / 700, 6)).alias("macro_f1"),
        F.when(F.col("_ok"), F.round(F.col("value") / 650, 6)).alias("weighted_f1"),
        F.when(F.col("_ok"), F.lit("success")).otherwise(F.lit("failed")).alias("status"),
        F.when(~F.col("_ok"), F.concat(F.lit("run failed: "), F.col("props"))).alias("error"),
        F.col("ts").alias("started_at"),
        *([F.when(F.col("event_id") % 5 == 0, F.lit("mlx")).otherwise(F.lit("torch")).alias("backend")] if with_backend else []),
    )


# ---------------------------------------------------------------- JSON files

# The JSON writer's default timestamp format keeps milliseconds only; run
# records keep the microseconds they were created with. Reading accepts 1 to
# 6 fraction digits, or none, so records written elsewhere still parse.
TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
TIMESTAMP_READ_FORMAT = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"

def write_runs(df: DataFrame, path: str, mode: str = "append", keep_nulls: bool = True) -> str:
    """Write run records as one JSON table partitioned by status.

    Success and failure rows land in the same table (the reference writes a
    file for both). ``keep_nulls`` writes explicit ``null`` values so that a
    reader can tell an explicit null from an absent key.
    """
    (df.write.mode(mode).partitionBy("status")
       .option("ignoreNullFields", str(not keep_nulls).lower())
       .option("timestampNTZFormat", TIMESTAMP_FORMAT)
       .option("timestampFormat", TIMESTAMP_FORMAT + "XXX")
       .json(path))
    return path


def read_runs(spark: SparkSession, path: str, schema: T.StructType = EMBEDDING_RUN_SCHEMA,
              multi_line: bool = False) -> DataFrame:
    """Read a directory of run records with an explicit, all-nullable schema.

    Pass the directory, not a ``dir/*.json`` glob: an empty directory then
    yields an empty frame (with a warning) instead of an error. Set
    ``multi_line`` for the one-indented-object-per-file layout. Nested
    folders other than ``key=value`` partitions are not descended into.
    """
    reader = (spark.read.schema(schema)
                   .option("timestampNTZFormat", TIMESTAMP_READ_FORMAT)
                   .option("timestampFormat", TIMESTAMP_READ_FORMAT + "[XXX]"))
    if multi_line:
        reader = reader.option("multiLine", True)
    try:
        df = reader.json(path)
    except Exception as exc:  # an empty or missing directory
        if "PATH_NOT_FOUND" in str(exc) or "UNABLE_TO_INFER_SCHEMA" in str(exc):
            log.warning("no run records found in %s", path)
            return spark.createDataFrame([], schema)
        raise
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


def load_runs(spark: SparkSession, path: str, schema: T.StructType = EMBEDDING_RUN_SCHEMA,
              pattern: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """(records, unreadable files) of a folder with one JSON object per file named like ``pattern``, indented or not.

    Other files and nested folders are left out. A record without the ``backend`` key
    gets ``torch``; an explicit null stays null (S5). A file that is no JSON object is
    reported as (path, text), never read as a row of nulls.
    """
    files = (spark.read.text(path, wholetext=True, pathGlobFilter=pattern)
             .select(F.input_file_name().alias("path"), F.col("value").alias("json")))
    keys = F.json_object_keys("json")
    good = files.where(keys.isNotNull())
    options = {"timestampNTZFormat": TIMESTAMP_READ_FORMAT, "timestampFormat": TIMESTAMP_READ_FORMAT + "[XXX]"}
    parsed = good.select("json", F.from_json("json", schema, options).alias("r")).select("json", "r.*")
    if "backend" in schema.names:
        parsed = parsed.withColumn("backend", resolve_backend_default(F.col("json")))
    return parsed.drop("json"), files.where(keys.isNull()).select("path", F.col("json").alias("text"))


def append_run_log(records: DataFrame, path: str, commit: int) -> str:
    """Append records (``json``, one object a row) to the log at ``path`` as one commit.

    A commit is written once and as a whole: its files appear when the job commits, and a
    number that is already there is refused, so a repeated append cannot double it.
    """
    if commit < 0:
        raise ValueError("commit must be >= 0")
    records.select(F.col("json").alias("value")).write.mode("errorifexists").text(f"{path.rstrip('/')}/commit={int(commit)}")
    return path


def read_run_log(spark: SparkSession, path: str,
                 schema: T.StructType = EMBEDDING_RUN_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """(latest record of every run id with its ``commit``, unreadable lines) of an appended log.

    Records of equal run ids overwrite each other: the latest commit wins, inside one commit
    the greatest text, so the result does not depend on the order lines are read in. The
    maximum is a partial aggregate, so a run id that is logged again and again is
    one row per task in the shuffle. A line that is no JSON object, or has no run id, is
    reported as (path, commit, text) and overwrites nothing. The backend default is that of
    ``load_runs``. No commits: both frames are empty.
    """
    try:
        lines = spark.read.schema("value string, commit int").text(path)
    except Exception as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        lines = spark.createDataFrame([], "value string, commit int")
    lines = lines.select("value", "commit", F.input_file_name().alias("path"))
    run_id = F.when(F.json_object_keys("value").isNotNull(), F.get_json_object("value", "$.run_id"))
    lines = lines.withColumn("id", run_id)
    latest = lines.where(F.col("id").isNotNull()).groupBy("id").agg(F.max(F.struct("commit", "value")).alias("last"))
    options = {"timestampNTZFormat": TIMESTAMP_READ_FORMAT, "timestampFormat": TIMESTAMP_READ_FORMAT + "[XXX]"}
    parsed = latest.select(F.col("last.value").alias("json"), F.col("last.commit").alias("commit"),
                           F.from_json("last.value", schema, options).alias("r")).select("json", "commit", "r.*")
    if "backend" in schema.names:
        parsed = parsed.withColumn("backend", resolve_backend_default(F.col("json")))
    return parsed.drop("json"), lines.where(F.col("id").isNull()).select("path", "commit", F.col("value").alias("text"))


def runs_as_json_text(df: DataFrame, absent_when: Column | None = None, key: str = "backend",
                      columns: list[str] | None = None) -> DataFrame:
    """Serialise each run record to a JSON string with explicit nulls.

    Rows matching ``absent_when`` omit ``key`` entirely, the way records
    written before that key existed look. ``columns`` limits the record to
    those fields (default: all), so helper columns stay out of the JSON.
    """
    cols = list(columns) if columns is not None else list(df.columns)
    full = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    if absent_when is None:
        return df.select("run_id", full.alias("json"))
    without = F.to_json(F.struct(*[c for c in cols if c != key]), {"ignoreNullFields": "false"})
    return df.select("run_id", F.when(absent_when, without).otherwise(full).alias("json"))


def resolve_backend_default(json_col: Column, key: str = "backend", default: str = "torch") -> Column:
    """``default`` only where the key is absent; an explicit null stays null."""
    present = F.array_contains(F.json_object_keys(json_col), key)
    return F.when(present, F.get_json_object(json_col, f"$.{key}")).otherwise(F.lit(default))
