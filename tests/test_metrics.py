"""M1-M4, M6, M7 golden cases."""

import pytest
from pyspark.sql import functions as F

from vectorloom.operators import metrics as M

PAIRS = [(0, 0), (0, 0), (0, 1), (1, 1), (1, 2), (3, 0)]


def test_classification_metrics_golden(spark):
    df = spark.createDataFrame(PAIRS, "truth int, pred int")
    r = M.classification_metrics(df).first()
    assert r["accuracy"] == pytest.approx(0.5)
    assert r["macro_f1"] == pytest.approx(0.291667, abs=1e-6)
    assert r["weighted_f1"] == pytest.approx(0.5)
    f1 = {int(x["cls"]): x["f1"] for x in M.class_report(df).collect()}
    assert f1[0] == pytest.approx(2 / 3) and f1[1] == pytest.approx(0.5)
    assert f1[2] == 0.0 and f1[3] == 0.0


def test_perfect_predictions_weighted_f1_equals_accuracy(spark):
    df = spark.createDataFrame([(i % 5, i % 5) for i in range(50)], "truth int, pred int")
    r = M.classification_metrics(df).first()
    assert r["accuracy"] == 1.0 and r["weighted_f1"] == pytest.approx(1.0) and r["macro_f1"] == pytest.approx(1.0)


def test_metrics_by_group(spark):
    df = spark.createDataFrame([(g, t, p) for g in (0, 1) for t, p in PAIRS], "g int, truth int, pred int")
    rows = M.classification_metrics(df, by=["g"]).collect()
    assert len(rows) == 2 and all(r["macro_f1"] == pytest.approx(0.291667, abs=1e-6) for r in rows)


def test_throughput_guard_and_total_time(spark):
    df = spark.createDataFrame([(500, 0.0, "frozen", 1.0, 2.0), (500, 4.0, "lora", None, 3.0)],
                               "n int, el double, mode string, embed_extraction_time_sec double, "
                               "train_time_sec double")
    rows = df.select(M.throughput("n", "el").alias("t"), M.total_time().alias("tt")).collect()
    assert rows[0]["t"] is None and rows[1]["t"] == 125.0
    assert rows[0]["tt"] == 3.0 and rows[1]["tt"] == 3.0


def test_telemetry_rows(spark, sf_dir):
    from vectorloom.operators.encode import HashedEncoder, encode_telemetry
    from vectorloom.sources.tables import read_table
    docs = read_table(spark, sf_dir, "documents")
    tel = encode_telemetry(docs, HashedEncoder(16), batch_size=16)
    total = tel.agg(F.sum("rows")).first()[0]
    assert total == docs.count()
    res = M.task_resources(tel).first()
    assert res["rows"] == total and res["busy_sec"] >= 0


def test_align_pairs_by_key_and_drops_unmatched(spark):
    truth = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id long, truth int")
    pred = spark.createDataFrame([(3, 1), (1, 1), (9, 0)], "doc_id long, pred int")
    got = sorted(tuple(r) for r in M.align(truth, pred, "doc_id").select("doc_id", "truth", "pred").collect())
    assert got == [(1, 0, 1), (3, 1, 1)]
