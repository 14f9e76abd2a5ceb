"""Workflow A: a classification run over a labelled corpus.

``read -> split -> label vocabulary -> sample -> encode the sample (raw
vectors) -> persist -> fit -> score -> metrics -> run record``, in the
frozen mode or the adapter mode, with failures captured as records.
"""

from __future__ import annotations

import datetime as dt
import time

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.operators import metrics as M
from vectorloom.operators.encode import encode_hashed
from vectorloom.operators.metrics import peak_accumulator
from vectorloom.operators.sampling import label_vocab, sample_n
from vectorloom.operators.training import MODE_DEFAULTS, fit_adapter, fit_head, score_heads, train_heads
from vectorloom.sources.corpus import attach_label, corpus, vocab_mapping
from vectorloom.sources.runs import CLASSIFICATION_RUN_SCHEMA


def vocab_lookup(spark: SparkSession, sf_dir: str):
    """(vocab frame, number of classes, literal map or None); see ``vocab_mapping``."""
    vocab = label_vocab(corpus(spark, sf_dir))
    k, mapping = vocab_mapping(vocab)
    return vocab, k, mapping


def labelled_split(spark: SparkSession, sf_dir: str, split: str, vocab_info) -> DataFrame:
    """(doc_id, text, label) of one split; the label is null for a name outside the vocabulary."""
    vocab, _, mapping = vocab_info
    c = corpus(spark, sf_dir).where(F.col("split") == split)
    return attach_label(c, vocab, mapping).select("doc_id", "text", "label")


def split_features(spark: SparkSession, sf_dir: str, dim: int = 64, splits=("train", "test"),
                   num_partitions: int | None = None) -> tuple[dict, int]:
    """Per split a frame (doc_id, label, features) of raw hashed vectors; one vocabulary lookup.

    The split filter runs before the encoder, which Catalyst cannot see through.
    """
    info = vocab_lookup(spark, sf_dir)
    frames = {s: encode_hashed(labelled_split(spark, sf_dir, s, info), dim, out="features", carry=["label"],
                               num_partitions=num_partitions) for s in splits}
    return frames, info[1]


def _run_name(started: dt.datetime, model_size: str, mode: str, device: str) -> str:
    return f"{started:%Y%m%d_%H%M%S}_{model_size}_{mode}_{device}"


def run_classification(spark: SparkSession, sf_dir: str, mode: str = "frozen", train_samples: int = 2000,
                       test_samples: int = 500, epochs: int | None = None, batch_size: int | None = None,
                       lr: float | None = None, max_length: int = 256, dim: int = 64, seed: int = 42,
                       model_size: str = "hashed-64", device: str = "spark", solver: str = "adam",
                       max_iter: int = 100) -> DataFrame:
    """One classification run; returns its run record (one row, run-record schema).

    As the reference: ``epochs``, ``batch_size`` and ``lr`` default by mode
    (C8); the samples are drawn first, and only they are encoded, unnormalised
    and cut to ``max_length`` tokens. ``frozen`` encodes them (timed as
    extraction) and trains the head with synchronous Adam (``solver="adam"``,
    C2: one Spark job per chunk of steps, see ``train_heads``) or with Spark ML's
    L-BFGS (``solver="lbfgs"``, C1); ``lora`` trains the vector adapter with
    the head (C6) and its total time is the training time alone. The training
    time stops before scoring. Test rows with a label outside the vocabulary
    count as misses. Peak memory is the largest growth of a Python task (not
    measured for L-BFGS, which runs in the JVM: null). Any failure becomes a
    ``failed`` record with the error text and the fields filled so far.
    """
    defaults = MODE_DEFAULTS.get(mode, MODE_DEFAULTS["lora"])
    epochs = int(epochs if epochs is not None else defaults["epochs"])
    batch_size = int(batch_size if batch_size is not None else defaults["batch_size"])
    lr = float(lr if lr is not None else defaults["lr"])
    started = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None, microsecond=0)
    rec = {f.name: None for f in CLASSIFICATION_RUN_SCHEMA.fields}
    rec.update(run_id=_run_name(started, model_size, mode, device), model_size=model_size, mode=mode,
               device=device, train_samples=int(train_samples), test_samples=int(test_samples),
               epochs=epochs, batch_size=batch_size, max_length=int(max_length), lr=lr, started_at=started)
    held: list[DataFrame] = []
    try:
        if mode not in MODE_DEFAULTS:
            raise ValueError(f"Unknown mode {mode!r}, expected one of {list(MODE_DEFAULTS)}")
        info = vocab_lookup(spark, sf_dir)
        rec["num_classes"] = k = info[1]
        samples = [sample_n(labelled_split(spark, sf_dir, split, info), n, "doc_id", seed, with_position=False)
                   .persist(StorageLevel.MEMORY_AND_DISK)
                   for split, n in (("train", train_samples), ("test", test_samples))]
        held += samples
        n_train, n_test = (f.count() for f in samples)
        rec["actual_train_samples"], rec["actual_test_samples"] = n_train, n_test
        encode_peak, train_peak = peak_accumulator(spark), peak_accumulator(spark)
        train, test = (encode_hashed(f, dim, max_length=max_length, out="features", carry=["label"],
                                     peak=encode_peak).persist(StorageLevel.MEMORY_AND_DISK) for f in samples)
        held += [train, test]
        t0 = time.time()
        train.count(), test.count()  # encodes both samples once
        extract = time.time() - t0
        t1 = time.time()
        if mode == "lora":
            _, preds, _ = fit_adapter(train, test, k, dim, epochs=epochs, lr=lr, batch_size=batch_size,
                                      seed=seed, peak=train_peak, key="doc_id")
        elif solver == "lbfgs":
            _, preds = fit_head(train, test, k, "features", "label", max_iter)
        else:
            cfg = {"lr": lr, "epochs": epochs, "batch_size": batch_size}
            params, _ = train_heads(train, k, dim, [cfg], seed=seed, peak=train_peak, key="doc_id")
            preds = score_heads(test, params).drop("config_id")
        train_time = time.time() - t1
        mets = M.classification_metrics(preds).first()
        if mode == "frozen":
            rec["embed_extraction_time_sec"] = extract
            rec["embed_extraction_samples_per_sec"] = (n_train + n_test) / extract if extract > 0 else None
            rec["embed_extraction_peak_mem_gb"] = encode_peak.value / 1e9
            rec["total_time_sec"] = extract + train_time
        else:
            rec["total_time_sec"] = train_time
        rec["train_time_sec"] = train_time
        if mode == "lora" or solver != "lbfgs":
            rec["train_peak_mem_gb"] = train_peak.value / 1e9
        rec.update(accuracy=mets["accuracy"], macro_f1=mets["macro_f1"], weighted_f1=mets["weighted_f1"],
                   status="success")
    except Exception as exc:  # every failure is a record; the grid goes on
        rec["status"] = "failed"
        rec["error"] = f"{type(exc).__name__}: {exc}"
    finally:
        for frame in held:
            frame.unpersist()
    return spark.createDataFrame([rec], CLASSIFICATION_RUN_SCHEMA)
