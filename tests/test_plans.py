"""Workflows A-C end to end on the smoke tables."""

import json

import pytest
from pyspark.sql import functions as F

from vectorloom.operators import report as R
from vectorloom.operators.encode import HashedEncoder
from vectorloom.plans.classification import run_classification
from vectorloom.plans.generation import run_generation, run_grid_generation
from vectorloom.plans.inspection import inspect_texts
from vectorloom.session import scratch_path
from vectorloom.sources import runs as RU
from vectorloom.sources.tables import read_table


def test_generation_record_and_report(spark, sf_dir):
    cells = [{"requested_dimension": "default"}, {"requested_dimension": "32"},
             {"requested_dimension": "abc"}, {"requested_dimension": "768"}]
    recs = run_grid_generation(spark, sf_dir, cells, num_samples=20)
    rows = {r["requested_dimension"]: r for r in recs.collect()}
    assert rows["default"]["status"] == "success" and rows["default"]["output_dimension"] == 64
    assert rows["32"]["output_dimension"] == 32
    assert rows["768"]["output_dimension"] == 64  # wider than native: native
    assert rows["abc"]["status"] == "failed" and "ValueError" in rows["abc"]["error"]
    assert rows["default"]["mean_l2_norm"] == pytest.approx(1.0, abs=1e-5)
    assert rows["default"]["run_id"].endswith("_hashed-64_embed_ddefault_cpu")
    path = scratch_path(spark, "gen-runs")
    RU.write_runs(recs, path)
    back = RU.read_runs(spark, path)
    assert back.count() == 4
    piv = R.throughput_pivot(back).collect()
    assert len(piv) == 1 and piv[0]["default"] is not None and piv[0]["768"] is not None


def test_classification_record(spark, sf_dir):
    rec = run_classification(spark, sf_dir, train_samples=100, test_samples=30, dim=32, max_iter=20,
                             solver="lbfgs").first()
    assert rec["status"] == "success" and rec["actual_train_samples"] == 100
    assert 0.0 <= rec["accuracy"] <= 1.0


def test_classification_runs_follow_the_mode_defaults(spark, sf_dir):
    recs = {m: run_classification(spark, sf_dir, mode=m, train_samples=80, test_samples=20, dim=16).first()
            for m in ("frozen", "lora", "bogus")}
    f, a, bad = recs["frozen"], recs["lora"], recs["bogus"]
    assert (f["epochs"], f["batch_size"], f["lr"]) == (10, 32, 1e-3)
    assert (a["epochs"], a["batch_size"], a["lr"]) == (3, 8, 2e-4)
    assert f["status"] == a["status"] == "success" and f["run_id"].endswith("_hashed-64_frozen_spark")
    assert f["total_time_sec"] == pytest.approx(f["embed_extraction_time_sec"] + f["train_time_sec"])
    assert a["embed_extraction_time_sec"] is None and a["total_time_sec"] == a["train_time_sec"]
    assert bad["status"] == "failed" and "Unknown mode" in bad["error"] and bad["accuracy"] is None


def test_classification_encodes_only_the_sample_and_honours_max_length(spark, sf_dir, monkeypatch):
    from vectorloom.plans import classification as CL
    seen = []
    real = CL.encode_hashed

    def counted(df, *args, **kw):
        seen.append(df.count())
        return real(df, *args, **kw)

    monkeypatch.setattr(CL, "encode_hashed", counted)
    runs = [run_classification(spark, sf_dir, train_samples=60, test_samples=20, dim=32, batch_size=60, epochs=3,
                               lr=0.1, max_length=n).first() for n in (1, 256)]
    assert seen == [60, 20, 60, 20]
    assert [r["status"] for r in runs] == ["success"] * 2
    assert (runs[0]["accuracy"], runs[0]["macro_f1"]) != (runs[1]["accuracy"], runs[1]["macro_f1"])
    assert all(r["embed_extraction_peak_mem_gb"] >= 0 and r["train_peak_mem_gb"] >= 0 for r in runs)


def test_generation_records_the_mlx_device(spark, sf_dir):
    r = run_generation(spark, sf_dir, backend="mlx", num_samples=5).first()
    assert r["status"] == "success" and r["device"] == "mlx" and r["peak_mem_gb"] >= 0


def test_generation_is_refused_before_it_reads(spark, sf_dir):
    r = run_generation(spark, sf_dir, model_size="8b", available_gb={"cpu": 1.0}).first()
    assert (r["status"], r["error"], r["actual_num_samples"]) == ("failed", "capacity: insufficient", None)
    assert run_generation(spark, sf_dir, model_size="0.6b", num_samples=5, available_gb={"cpu": 64.0}).first()["status"] == "success"
    assert run_generation(spark, sf_dir, model_size="0.6b", device="tpu", available_gb={"cpu": 64.0}).first()["error"] == "unknown device"


def test_inspection_one_text(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    one = docs.orderBy("doc_id").limit(1)
    r = inspect_texts(one, HashedEncoder(64), dimension=16, n=4).first()
    assert r["width"] == 16 and r["l2_norm"] == pytest.approx(1.0, abs=1e-5)
    assert len(r["head"]) == 4 and len(r["tail"]) == 4
    doc = json.loads(r["json"])
    assert doc["output_dimension"] == 16 and doc["native_hidden_size"] == 64
    assert r["file_name"] == "hashed-64_dim16_cuda"
