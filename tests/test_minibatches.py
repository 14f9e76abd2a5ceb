"""Mini-batch training over an epoch bucketed by step, isolation of failing rows, progress of a whole run."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.operators import encode as E
from vectorloom.operators import grid as G
from vectorloom.operators import metrics as M
from vectorloom.operators import sampling as S
from vectorloom.operators import training as C


def _rows(spark, n=150, seed=3):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, [float(x) for x in rng.normal(0, 1, 4)], int(rng.integers(0, 3))) for i in range(n)],
                                 "doc_id long, features array<float>, label int")


def _place(spark, n, epoch):
    ids = spark.range(n).select(F.col("id").alias("doc_id"))
    return {r["doc_id"]: r["p"] for r in S.seeded_position(ids, "doc_id", C.epoch_seed(42, epoch), "p").collect()}


@pytest.mark.parametrize("partitions", [1, 7])
def test_keyed_minibatches_are_the_loaders_loop(spark, partitions):
    df = _rows(spark)
    rows = df.collect()
    X = np.hstack([np.array([r["features"] for r in rows], dtype=np.float32).astype(float), np.ones((len(rows), 1))])
    y = np.array([r["label"] for r in rows])
    W, m, v, t, want = np.zeros((3, 5)), np.zeros((3, 5)), np.zeros((3, 5)), 0, []
    for epoch in (1, 2):
        place = _place(spark, len(rows), epoch)
        order = sorted(range(len(rows)), key=lambda i: place[rows[i]["doc_id"]])
        for step in range(math.ceil(len(rows) / 32)):
            idx = order[32 * step:32 * step + 32]
            z = X[idx] @ W.T
            logp = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
            want.append((epoch, step, len(idx), -logp[np.arange(len(idx)), y[idx]].mean()))
            g = np.exp(logp)
            g[np.arange(len(idx)), y[idx]] -= 1.0
            t += 1
            W, m, v = C._adam_step(W, g.T @ X[idx] / len(idx), m, v, t, 0.05)
    got = [tuple(r) for r in C.minibatch_curve(df.repartition(partitions), 3, 4, 32, "doc_id", 2, 0.05).collect()]
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=0, atol=1e-9)


def test_jobs_grow_with_the_rows_not_the_steps(spark, monkeypatch):
    """150 steps in one chunk, in 25 and one by one: the same losses and weights; one chunk takes far fewer jobs than steps."""
    df = _rows(spark, n=600).union(_rows(spark, n=1).withColumn("doc_id", F.lit(None).cast("long")))
    sc, curves, heads, adapters, jobs = spark.sparkContext, [], [], [], []
    for chunk in (C.CHUNK_ROWS, 24, 1):
        monkeypatch.setattr(C, "CHUNK_ROWS", chunk)
        sc.setJobGroup(f"vl-chunk-{chunk}", "one epoch")
        curves.append([tuple(r) for r in C.minibatch_curve(df, 3, 4, 4, "doc_id", 1, 0.05).collect()])
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"vl-chunk-{chunk}")))
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert [c[:3] for c in curves[0]] == [(1, i, 4) for i in range(150)] and jobs[0] < 50
    assert all([c[:3] for c in curve] == [c[:3] for c in curves[0]] for curve in curves)
    assert all(np.allclose([c[3] for c in curve], [c[3] for c in curves[0]], rtol=0, atol=1e-9) for curve in curves)
    for chunk in (C.MERGE_WIDTH, 1):
        monkeypatch.setattr(C, "CHUNK_ROWS", chunk)
        small = df.where("doc_id < 60")
        heads.append(C.train_heads(small, 3, 4, [{"lr": lr, "epochs": e, "batch_size": 8} for lr, e in ((0.1, 2), (0.01, 1))], key="doc_id"))
        adapters.append(C.fit_adapter(small, small, 3, 4, epochs=2, lr=0.01, dropout=0.5, batch_size=8, key="doc_id")[0])
    assert np.allclose(heads[0][0], heads[1][0], rtol=0, atol=1e-9) and np.allclose(heads[0][1], heads[1][1], rtol=0, atol=1e-9)
    assert np.allclose(*adapters, rtol=0, atol=1e-9)
    nothing = C.minibatch_curve(df.limit(0), 3, 4, 4, "doc_id")
    assert nothing.columns == ["epoch", "step", "n_rows", "loss"] and nothing.count() == 0


@pytest.mark.parametrize("batch_size", [10, 50])
def test_an_epoch_reads_its_rows_once(spark, batch_size):
    """Every step scans only its own bucket, so the files read in an epoch do not depend on the number of steps."""
    data, n = C._training_rows(_rows(spark), "features", "label", "doc_id")
    seen, total, ids = [], 0, []
    for batch, alone in C._batches_of(data, n, batch_size, 42, 1, 8, "doc_id"):
        assert alone and batch.rdd.getNumPartitions() == 1
        seen += batch.inputFiles()
        total += batch.count()
        ids.append(batch.count())
    assert total == n == 150 and len(seen) == len(set(seen)) == 150 // batch_size and set(ids) == {batch_size}
    data.unpersist()


def test_large_steps_are_dealt_over_files(spark, monkeypatch):
    """Small partitions are put together again, so the toy table shows the dealing only without that."""
    monkeypatch.setattr(C, "SHARD_ROWS", 10)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    data, n = C._training_rows(_rows(spark), "features", "label", "doc_id")
    batch, alone = next(C._batches_of(data, n, 75, 42, 1, 1024, "doc_id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert not alone and len(batch.inputFiles()) > 3
    data.unpersist()


class Refusing:
    """Fails on any batch that holds a text with ``bad`` in it; counts its calls in an accumulator."""

    native_dim = 2

    def __init__(self, calls):
        self.calls = calls

    def load(self):
        def run(texts):
            self.calls.add(1)
            if any("bad" in (t or "") for t in texts):
                raise RuntimeError("bad text in batch")
            return np.array([[len(t or ""), 1.0] for t in texts], dtype=np.float32)
        return run


@pytest.mark.parametrize("bad", [set(), {5}, {0, 63, 64, 200}, set(range(256))])
def test_bad_rows_fail_alone(spark, bad):
    calls = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([(f"k{i}", "bad" if i in bad else None if i == 7 else "x" * (i % 9), i) for i in range(256)],
                               "k string, text string, n int").coalesce(1)
    rows = E.encode(df, Refusing(calls), key="k", batch_size=64, isolate=True, carry=["n"]).collect()
    assert {r["n"] for r in rows if r["status"] == "failed"} == bad and len(rows) == 256
    for r in rows:
        if r["n"] in bad:
            assert r["embedding"] is None and r["error"] == "RuntimeError: bad text in batch"
        else:
            assert r["embedding"] == [0.0 if r["n"] == 7 else r["n"] % 9, 1.0] and r["error"] is None
    assert 4 <= calls.value <= 4 + 2 * len(bad) * math.log2(64)


def test_isolation_normalises_and_keeps_its_names(spark):
    calls = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([(1, "xxx", "z"), (2, "bad", "z")], "doc_id long, text string, status string")
    out = {r["doc_id"]: r for r in E.encode(df, Refusing(calls), normalize=True, isolate=True).collect()}
    assert abs(sum(x * x for x in out[1]["embedding"]) - 1) < 1e-6 and out[2]["embedding"] is None
    with pytest.raises(ValueError):
        E.encode(df, Refusing(calls), isolate=True, carry=["status"])
    with pytest.raises(Exception, match="bad text"):
        E.encode(df, Refusing(calls)).collect()


def _progress(rows, lines):
    rows = sorted(rows)
    total, done, out = sum(r[3] for r in rows), 0, []
    for end, _, _, n in rows:
        done += n
        for k in range((done - n) * lines // total + 1, done * lines // total + 1):
            seconds = (end - rows[0][0]) / 1e6
            out.append((100.0 * k / lines, done, total, end, seconds, done / seconds if seconds else None))
    return sorted(out)


def test_run_progress_merges_all_tasks(spark):
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(0, 40)) * 1_000_000, int(rng.integers(0, 5)), i, int(rng.integers(0, 33))) for i in range(700)]
    rows += [(50_000_000, 9, 1000, 4000), (60_000_000, 9, 1001, 1)]
    df = spark.createDataFrame(rows, "ended_at long, task_id int, batch_no long, rows long").repartition(6)
    for lines in (1, 10, 37):
        assert sorted(tuple(r) for r in M.run_progress(df, lines).collect()) == _progress(rows, lines)
    assert M.run_progress(df.limit(0)).count() == 0
    assert M.run_progress(spark.createDataFrame([(5, 1, 1, 0)], df.schema)).count() == 0


def test_progress_of_a_real_run(spark, sf_dir):
    from vectorloom.sources.tables import read_table
    docs = read_table(spark, sf_dir, "documents")
    out = M.run_progress(E.encode_telemetry(docs, E.HashedEncoder(16), batch_size=16)).collect()
    assert max(r["done"] for r in out) == docs.count() and {r["percent"] for r in out} == {10.0 * k for k in range(1, 11)}


def test_sample_is_the_same_on_either_side_of_the_state(spark, sf_dir, monkeypatch):
    from vectorloom.sources.tables import read_table
    docs = read_table(spark, sf_dir, "documents")
    repeated = spark.createDataFrame([(i % 7, f"p{i}", i) for i in range(200)] + [(None, "null", 1)], "doc_id long, text string, n int")
    for df in (docs, repeated):
        for n in (0, 1, 50, 10_000):
            for placed in (True, False):
                monkeypatch.setattr(S, "SAMPLE_STATE", 20_000)
                small = S.sample_n(df, n, "doc_id", with_position=placed)
                monkeypatch.setattr(S, "SAMPLE_STATE", -1)
                large = S.sample_n(df, n, "doc_id", with_position=placed)
                assert sorted(map(repr, small.select(*large.columns).collect())) == sorted(map(repr, large.collect()))


def test_failed_runs_stay_failed(spark):
    runs = spark.createDataFrame([("1", "0.6b", "cuda", "768", "torch", "failed", "out of memory"), ("2", "0.6b", "cuda", "768", "torch", "failed", None),
                                  ("3", "9b", "cpu", "768", "torch", "failed", "late"), ("4", "0.6b", "cpu", "768", "torch", "success", None)],
                                 "run_id string, model_size string, device string, requested_dimension string, backend string, status string, error string")
    got = {r["run_id"]: (r["status"], r["error"]) for r in G.failure_capture(runs).collect()}
    assert got == {"1": ("failed", "out of memory"), "2": ("failed", "run failed"), "3": ("failed", "unknown model size"), "4": ("success", None)}


def test_adapters_on_mlx_are_refused_by_the_records(spark, sf_dir):
    from vectorloom.sources import runs as RU
    out = G.grid_validation(RU.embedding_runs(spark, sf_dir), RU.classification_runs(spark, sf_dir, with_backend=True))
    assert out.where(F.col("reject_reason") == G.MLX_FROZEN_ONLY).count() > 0


class _Hungry:
    """An encoder that holds 200 MB while it works on the batch with the text ``big``."""
    native_dim = 2

    def load(self):
        def call(texts):
            held = np.ones(25_000_000) if "big" in texts else None
            time.sleep(0.05)
            del held
            return np.zeros((len(texts), 2), dtype=np.float32)
        return call


def test_peak_inside_a_batch_is_seen(spark):
    texts = ["t"] * 8 + ["big"] + ["t"] * 8
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    peak = M.peak_accumulator(spark)
    E.encode(df, _Hungry(), batch_size=4, peak=peak).count()
    assert 180e6 < peak.value < 260e6
    growth = {r["batch_no"]: r["rss_growth"] for r in E.encode_telemetry(df, _Hungry(), batch_size=4).collect()}
    assert 180e6 < growth[2] < 260e6 and growth[0] < 60e6


def test_adapter_masks_follow_the_key(spark):
    df = _rows(spark, n=60)
    curves = [[x for _, x in C.fit_adapter(df.repartition(p), df, 3, 4, epochs=2, lr=0.01, dropout=0.5, key="doc_id")[0]] for p in (1, 6)]
    assert np.allclose(*curves, rtol=0, atol=1e-9)
    other = C.fit_adapter(df.withColumn("doc_id", F.col("doc_id") + 1000), df, 3, 4, epochs=2, lr=0.01, dropout=0.5, key="doc_id")[0]
    assert abs(other[1][1] - curves[0][1]) > 1e-6          # other keys, other masks (B starts at zero, so from the second epoch on)
    unkeyed = df.withColumn("doc_id", F.lit(None).cast("long"))
    assert len(C.fit_adapter(unkeyed, df, 3, 4, epochs=1, key="doc_id")[0]) == 1
