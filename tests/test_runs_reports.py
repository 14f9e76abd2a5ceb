"""R1-R14, S4-S8, P7-P9 golden cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vectorloom.operators import grid as G
from vectorloom.operators import report as R
from vectorloom.session import local_dir_of, scratch_path
from vectorloom.sources import runs as RU


def test_run_grid_defaults(spark):
    g = G.run_grid(spark).orderBy("ordinal").collect()
    assert len(g) == 18 and g[0]["total"] == 18
    assert (g[0]["model_size"], g[0]["device"], g[0]["dimension"], g[0]["batch_size"]) == ("0.6b", "cpu", "768", 16)
    assert (g[-1]["model_size"], g[-1]["device"], g[-1]["dimension"], g[-1]["batch_size"]) == ("8b", "cuda", "default", 4)


def test_required_gb_and_verdicts(spark):
    rows = [(m, d) for m in ("0.6b", "4b", "8b") for d in ("cpu", "cuda")]
    df = spark.createDataFrame(rows, "m string, d string")
    got = {(r["m"], r["d"]): round(r["g"], 2) for r in
           df.select("m", "d", G.required_gb(F.col("m"), F.col("d")).alias("g")).collect()}
    assert got == {("0.6b", "cpu"): 3.12, ("4b", "cpu"): 10.4, ("8b", "cpu"): 20.8,
                   ("0.6b", "cuda"): 1.8, ("4b", "cuda"): 3.6, ("8b", "cuda"): 7.2}
    v = spark.createDataFrame([("4b", "cpu", "lora", 1.0, 999.0), ("0.6b", "cpu", "frozen", 3.12, 3.12),
                               ("8b", "cpu", "frozen", 20.8, 16.0)],
                              "m string, d string, mode string, req double, avail double")
    verdicts = [r[0] for r in v.select(G.capacity_verdict(F.col("m"), F.col("d"), F.col("mode"),
                                                          F.col("req"), F.col("avail"))).collect()]
    assert verdicts == ["unsupported", "ok", "insufficient"]


def test_run_id_golden(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 2, 3, 4, 5), "0.6b", "768", "torch", "cuda")],
                               "ts timestamp, m string, r string, b string, d string")
    got = df.select(G.embedding_run_id(F.col("ts"), F.col("m"), F.col("r"), F.col("b"), F.col("d"))).first()[0]
    assert got == "20240102_030405_0.6b_embed_d768_cuda"


def test_format_golden(spark):
    from vectorloom.functions.fmt import fmt_float, fmt_plain
    df = spark.createDataFrame([(0.5, None, 16, "cpu")], "a double, b double, c int, d string")
    r = df.select(fmt_float("a"), fmt_float("b"), fmt_plain("c"), fmt_plain("d")).first()
    assert tuple(r) == ("0.500", "-", "16", "cpu")


def _runs(spark, rows):
    return spark.createDataFrame(rows, "run_id string, model_size string, backend string, device string, "
                                       "requested_dimension string, status string, "
                                       "throughput_samples_per_sec double, peak_mem_gb double")


def test_pivot_drops_and_averages(spark):
    runs = _runs(spark, [
        ("1", "0.6b", "torch", "cuda", "768", "success", 1.0, 0.1),
        ("2", "0.6b", "torch", "cuda", "768", "success", 3.0, 0.1),
        ("3", "4b", "torch", "cuda", "512", "success", 5.0, 0.1),
        ("4", "8b", "torch", "cuda", "768", "success", None, None),
        ("5", "8b", "torch", "cpu", "768", "failed", 9.0, None),
    ])
    piv = R.throughput_pivot(runs).collect()
    assert len(piv) == 1 and piv[0]["768"] == 2.0 and piv[0]["1024"] is None


def test_sort_and_rank(spark):
    runs = _runs(spark, [(str(i), "0.6b", "torch", "cpu", d, "success", 1.0, 1.0)
                         for i, d in enumerate(["768", "1024", "default", "512"])])
    by_pos = [r["requested_dimension"] for r in R.runs_sorted(runs).orderBy("position").collect()]
    assert by_pos[:3] == ["1024", "512", "768"] and by_pos[-1] == "default"
    ranked = [r["requested_dimension"] for r in R.runs_ranked(runs).orderBy("position").collect()]
    assert ranked == ["768", "1024", "default", "512"]


def test_speedup_and_step_ratio(spark):
    rows = [("a", "0.6b", "torch", "cpu", "default", "success", 18.9, 0.21),
            ("b", "0.6b", "torch", "cuda", "default", "success", 378.9, 1.26),
            ("c", "4b", "torch", "cuda", "default", "success", 73.0, 2.78),
            ("d", "8b", "torch", "cuda", "default", "success", 38.0, 4.88)]
    runs = _runs(spark, rows)
    sp = {r["model_size"]: r["speedup_label"] for r in R.gpu_speedup(runs).collect()}
    assert sp == {"0.6b": "20.05x", "4b": "n/a", "8b": "n/a"}
    st = {r["model_size"]: r["step_ratio"] for r in R.size_step_ratio(runs).where("device = 'cuda'").collect()}
    assert round(st["4b"], 2) == 5.19 and round(st["8b"], 2) == 1.92


def test_backend_absent_vs_null(spark):
    df = spark.createDataFrame([('{"run_id": "1"}',), ('{"run_id": "2", "backend": null}',),
                                ('{"run_id": "3", "backend": "mlx"}',)], "json string")
    got = [r[0] for r in df.select(RU.resolve_backend_default(F.col("json"))).collect()]
    assert got == ["torch", None, "mlx"]


def test_write_and_read_runs_roundtrip(spark):
    runs = spark.createDataFrame([("1", "0.6b", "success"), ("2", "4b", "failed")],
                                 "run_id string, model_size string, status string")
    path = scratch_path(spark, "runs-test")
    RU.write_runs(runs, path)
    back = RU.read_runs(spark, path)
    assert back.count() == 2 and set(back.columns) >= {"run_id", "status", "backend"}
    assert back.where("backend is null").count() == 2


def test_read_runs_empty_directory(spark, tmp_path):
    empty = tmp_path / "none"
    empty.mkdir()
    assert RU.read_runs(spark, str(empty)).count() == 0


def test_failure_capture_never_fails(spark):
    runs = spark.createDataFrame([("1", "0.6b", "cuda", "768", "torch"), ("2", "9b", "cpu", "768", "torch"),
                                  ("3", "8b", "cpu", "abc", "torch"), ("4", "8b", "cpu", "768", "torch")],
                                 "run_id string, model_size string, device string, requested_dimension string, "
                                 "backend string")
    got = {r["run_id"]: r["status"] for r in G.failure_capture(runs).collect()}
    assert got == {"1": "success", "2": "failed", "3": "failed", "4": "failed"}


def test_fmt_float_of_values_that_no_decimal_holds(spark):
    from vectorloom.functions.fmt import fmt_float
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (1e30,), (-0.5,), (None,)],
                               "v double")
    got = [r[0] for r in df.select(fmt_float("v")).collect()]
    assert got == ["nan", "inf", "-inf", "1" + "0" * 30 + ".000", "-0.500", "-"]


def test_write_report_sheets(spark):
    runs = _runs(spark, [("1", "0.6b", "torch", "cuda", "768", "failed", None, None)])
    out = R.write_report(runs, scratch_path(spark, "report-test"))
    assert set(out) == {"raw_results", "throughput_samples_per_sec", "peak_mem_gb"}
    assert spark.read.parquet(out["peak_mem_gb"]).count() == 0
    assert spark.read.parquet(out["raw_results"]).count() == 1
    assert local_dir_of(out["raw_results"])


def test_read_runs_accepts_indented_files_and_short_fractions(spark, tmp_path):
    d = tmp_path / "runs"
    d.mkdir()
    (d / "a.json").write_text('{\n  "run_id": "a",\n  "status": "success",\n'
                              '  "started_at": "2024-01-02T03:04:05.123"\n}\n')
    (d / "b.json").write_text('{\n  "run_id": "b",\n  "status": "failed",\n'
                              '  "started_at": "2024-01-02T03:04:05"\n}\n')
    rows = {r["run_id"]: r["started_at"] for r in RU.read_runs(spark, str(d), multi_line=True).collect()}
    assert rows["a"] == dt.datetime(2024, 1, 2, 3, 4, 5, 123000)
    assert rows["b"] == dt.datetime(2024, 1, 2, 3, 4, 5)


def test_write_runs_keeps_microseconds(spark):
    ts = dt.datetime(2024, 1, 2, 3, 4, 5, 101046)
    runs = spark.createDataFrame([("1", "success", ts)], "run_id string, status string, started_at timestamp_ntz")
    path = scratch_path(spark, "runs-us")
    RU.write_runs(runs, path)
    assert RU.read_runs(spark, path).first()["started_at"] == ts


def test_failure_errors_and_native_plan(spark):
    cases = [("0.6b", "cpu", "768", "torch", None), ("8b", "cpu", "default", "torch", "capacity: insufficient"),
             ("8b", "cpu", "default", "mlx", None), ("8b", "cuda", "512", None, "unknown backend"),
             ("9b", "cpu", "768", "torch", "unknown model size"), (None, "cuda", "768", None, "unknown model size"),
             ("4b", "tpu", "768", "torch", "unknown device"), ("4b", None, "768", "torch", "device required for torch backend"),
             ("0.6b", "cuda", "abc", "torch", "dimension is not an integer"),
             ("0.6b", "cuda", "0", "torch", "dimension must be >= 1")]
    runs = spark.createDataFrame([(str(i), *c) for i, c in enumerate(cases)],
                                 "run_id string, model_size string, device string, requested_dimension string, "
                                 "backend string, want string")
    out = G.failure_capture(runs)
    assert {r["run_id"]: r["error"] for r in out.collect()} == {str(i): c[-1] for i, c in enumerate(cases)}
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    lora = G.failure_capture(runs.where("run_id in ('1', '2')"), mode="lora")
    assert {r["error"] for r in lora.collect()} == {"capacity: unsupported", G.MLX_FROZEN_ONLY}
    small = G.failure_capture(runs.where("run_id = '0'"), available_gb={"cuda": 8.0})
    assert small.first()["error"] == "capacity: unknown"


def test_load_runs_reads_the_indented_layout(spark, tmp_path):
    d = tmp_path / "runs"
    (d / "nested").mkdir(parents=True)
    (d / "a.json").write_text('{\n  "run_id": "a",\n  "status": "success"\n}\n')
    (d / "b.json").write_text('{\n  "run_id": "b",\n  "backend": null\n}')
    (d / "c.json").write_text('{\n  "run_id": "c",\n  "backend": "mlx"\n}')
    (d / "bad.json").write_text('{"run_id": ')
    (d / "comparison.xlsx").write_bytes(b"PK\x03\x04 not json")
    (d / "nested" / "x.json").write_text('{"run_id": "x"}')
    rows, bad = RU.load_runs(spark, str(d))
    assert {r["run_id"]: r["backend"] for r in rows.collect()} == {"a": "torch", "b": None, "c": "mlx"}
    assert [r["path"].rsplit("/", 1)[1] for r in bad.collect()] == ["bad.json"]

def test_run_log_latest_commit_wins(spark):
    path = scratch_path(spark, "run-log-test")
    log = lambda lines, n: RU.append_run_log(spark.createDataFrame([(x,) for x in lines], "json string"), path, n)
    log(['{"run_id": "a", "status": "failed", "error": "x"}', '{"run_id": "b", "status": "success", "backend": null}',
         '{"run_id": "a", "status": "failed", "error": "w"}', '[1]', '{"status": "success"}'], 0)
    log(['{"run_id": "a", "status": "success", "backend": "mlx"}', '{"run_id": "b", "sta'], 1)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        log(['{"run_id": "c"}'], 1)
    rows, bad = RU.read_run_log(spark, path)
    assert {(r["run_id"], r["status"], r["backend"], r["error"], r["commit"]) for r in rows.collect()} == {
        ("a", "success", "mlx", None, 1), ("b", "success", None, None, 0)}
    assert sorted((r["commit"], r["text"]) for r in bad.collect()) == [(0, "[1]"), (0, '{"status": "success"}'), (1, '{"run_id": "b", "sta')]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
    none, broken = RU.read_run_log(spark, path + "-missing")
    assert none.count() == 0 and broken.count() == 0
