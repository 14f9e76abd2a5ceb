"""Physical-plan properties that matter at scale, checked on the smoke tables.

Results are checked elsewhere; these tests keep the plans honest: no
exchange where none is needed, no join where rows can be paired in place,
and scans that read only the columns a query uses.
"""

import re

import pytest

from vectorloom.plans import catalog


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _read_schemas(plan: str) -> list[str]:
    return re.findall(r"ReadSchema: (struct<[^\n]*>)", plan)


def _run(spark, sf_dir, key):
    return catalog.queries()[key](spark, sf_dir)


def test_labelled_corpus_is_one_stage(spark, sf_dir):
    plan = _plan(_run(spark, sf_dir, "labelled_corpus"))
    assert "Exchange" not in plan and "Join" not in plan, plan


@pytest.mark.parametrize("key", ["accuracy", "macro_f1", "weighted_f1", "class_report", "backend_default"])
def test_no_self_join(spark, sf_dir, key):
    plan = _plan(_run(spark, sf_dir, key))
    assert "Join" not in plan, plan


@pytest.mark.parametrize("key", ["seeded_order", "batch_assign", "sample_n"])
def test_seeded_order_reads_only_the_id(spark, sf_dir, key):
    schemas = _read_schemas(_plan(_run(spark, sf_dir, key)))
    assert schemas and all(s == "struct<doc_id:bigint>" for s in schemas), schemas


def test_seeded_positions_broadcast_only_bucket_offsets(spark, sf_dir):
    plan = _plan(_run(spark, sf_dir, "batch_assign"))
    assert "BroadcastExchange" in plan
    # the data itself is shuffled once, by bucket, for the rank window
    assert plan.count("Exchange hashpartitioning(_vl_bucket") >= 1, plan


@pytest.mark.parametrize("key,columns", [
    ("norm_stats", "struct<embedding:array<float>>"),
    ("tokens_truncated", "struct<doc_id:bigint,text:string>"),
    ("truncation_report", "struct<text:string>"),
    ("split_counts", "struct<doc_id:bigint>"),
])
def test_column_pruning_reaches_the_scan(spark, sf_dir, key, columns):
    schemas = _read_schemas(_plan(_run(spark, sf_dir, key)))
    assert schemas == [columns], schemas


def test_pivot_values_are_pinned(spark, sf_dir):
    # pinned pivot values: building the query runs no job to discover them
    sc = spark.sparkContext
    sc.setJobGroup("vl-pivot-build", "build only")
    try:
        df = _run(spark, sf_dir, "throughput_pivot")
        assert list(sc.statusTracker().getJobIdsForGroup("vl-pivot-build")) == []
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert df.columns == ["model_size", "backend", "device", "768", "1024", "default"]
