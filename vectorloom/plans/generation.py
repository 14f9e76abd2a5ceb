"""Workflow B: one embedding-generation run, recorded as a run record.

``sample -> encode (timed) -> norm statistics -> run record``. The record
has the embedding-run schema whatever happens: a failure at any step (a
non-integer dimension, an encoder error) becomes a ``failed`` record with
the error text and the fields filled so far, as the reference does, and the
caller's grid goes on. Records are written with ``sources.runs.write_runs``
and compared with the ``operators.report`` functions.
"""

from __future__ import annotations

import datetime as dt
import time

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.operators.encode import HashedEncoder, encode, resolve_dimension
from vectorloom.operators.grid import failure_capture
from vectorloom.operators.metrics import peak_accumulator
from vectorloom.operators.vectors import norm_stats
from vectorloom.sources.corpus import sample_texts
from vectorloom.sources.runs import EMBEDDING_RUN_SCHEMA


def _run_name(started: dt.datetime, model_size: str, requested: str, backend: str, device: str) -> str:
    label = "mlx" if backend == "mlx" else device
    return f"{started:%Y%m%d_%H%M%S}_{model_size}_embed_d{requested}_{label}"


def run_generation(spark: SparkSession, sf_dir: str, encoder=None, model_size: str = "hashed-64",
                   backend: str = "torch", device: str = "cpu", requested_dimension: str = "default",
                   num_samples: int = 500, batch_size: int = 16, max_length: int = 256,
                   seed: int = 42, available_gb: dict | None = None) -> DataFrame:
    """Encode a seeded sample of the test split; return its run record (one row).

    Vectors are normalised, as in generation. The timer covers the encode
    pass (each task loads the encoder in it; sampling is outside).
    ``peak_mem_gb`` is the largest growth of an encoder task's resident
    memory in that pass; every text is encoded once. An mlx run records the
    device ``mlx``. With ``available_gb`` (free memory by device) the run's
    configuration is checked first (R4b, R4): a run that is refused is a ``failed`` record with the
    reason, and nothing is read or encoded for it.
    """
    encoder = encoder or HashedEncoder(64, max_length)
    started = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None, microsecond=0)
    rec = {f.name: None for f in EMBEDDING_RUN_SCHEMA.fields}
    rec.update(model_size=model_size, backend=backend, device="mlx" if backend == "mlx" else device,
               requested_dimension=str(requested_dimension), num_samples=int(num_samples),
               batch_size=int(batch_size), max_length=int(max_length), started_at=started,
               run_id=_run_name(started, model_size, str(requested_dimension), backend, device))
    texts = vecs = None
    if available_gb is not None:
        cell = spark.createDataFrame([rec], EMBEDDING_RUN_SCHEMA).drop("status", "error")
        refused = failure_capture(cell, available_gb=available_gb).first()["error"]
        if refused:
            rec.update(status="failed", error=refused)
            return spark.createDataFrame([rec], EMBEDDING_RUN_SCHEMA)
    try:
        native = int(encoder.native_dim)
        wanted = None if requested_dimension == "default" else int(requested_dimension)
        dim = resolve_dimension(wanted, native)
        texts = sample_texts(spark, sf_dir, num_samples, "test", seed).select("doc_id", "text")
        texts = texts.persist(StorageLevel.MEMORY_AND_DISK)
        rec["actual_num_samples"] = texts.count()
        rec["native_hidden_size"] = native
        peak = peak_accumulator(spark)
        vecs = encode(texts, encoder, "text", "doc_id", batch_size, dim, normalize=True, max_length=max_length,
                      peak=peak)
        vecs = vecs.persist(StorageLevel.MEMORY_AND_DISK)
        t0 = time.perf_counter()
        n = vecs.count()
        elapsed = time.perf_counter() - t0
        rec["output_dimension"] = dim or native
        rec["embed_generation_time_sec"] = elapsed
        rec["throughput_samples_per_sec"] = n / elapsed if elapsed > 0 else None
        stats = norm_stats(vecs).first()
        rec["mean_l2_norm"] = stats["mean_l2_norm"]
        rec["std_l2_norm"] = stats["std_l2_norm"]
        rec["peak_mem_gb"] = peak.value / 1e9
        rec["status"] = "success"
    except Exception as exc:  # every failure is a record; the grid goes on
        rec["status"] = "failed"
        rec["error"] = f"{type(exc).__name__}: {exc}"
    finally:
        for frame in (texts, vecs):
            if frame is not None:
                frame.unpersist()
    return spark.createDataFrame([rec], EMBEDDING_RUN_SCHEMA)


def run_grid_generation(spark: SparkSession, sf_dir: str, cells: list[dict], **common) -> DataFrame:
    """Run several generation cells one after another; one record per cell.

    Each cell is a dict of ``run_generation`` keyword arguments. The cells
    run in turn (each is itself a distributed job over the whole sample),
    and the records are unioned into one frame.
    """
    out = None
    for cell in cells:
        rec = run_generation(spark, sf_dir, **{**common, **cell})
        out = rec if out is None else out.unionByName(rec)
    if out is None:
        return spark.createDataFrame([], EMBEDDING_RUN_SCHEMA)
    return out.select(*[F.col(f.name) for f in EMBEDDING_RUN_SCHEMA.fields])
