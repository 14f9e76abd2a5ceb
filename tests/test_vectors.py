"""V4-V12 golden cases (FIXTURES.md section 3) and invariants."""

import math

import pytest
from pyspark.sql import functions as F

from vectorloom.functions import vector as V
from vectorloom.operators import vectors as VO


def _vecs(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)],
                                 "vec_id long, embedding array<float>")


def _one(df, col="embedding"):
    return [r[col] for r in df.orderBy("vec_id").collect()]


def test_l2_normalize_golden(spark):
    out = _one(VO.l2_normalize(_vecs(spark, [[3, 4, 0, 0], [0, 0]])))
    assert out[0] == pytest.approx([0.6, 0.8, 0.0, 0.0], abs=1e-7)
    assert out[1] == [0.0, 0.0]


def test_truncate_then_normalize(spark):
    out = _one(VO.truncate_normalize(_vecs(spark, [[3, 4, 0, 0]]), 1))
    assert out == [[1.0]]


def test_renormalize_truncated_golden(spark):
    df = _vecs(spark, [[0.6, 0.8, 0, 0], [0, 1]])
    out = _one(VO.renormalize_truncated(df, 1))
    assert out[0] == pytest.approx([1.0])
    assert out[1] is None  # the reference divides by zero; null here


def test_truncate_past_end_and_rejects_zero(spark):
    assert _one(VO.mrl_truncate(_vecs(spark, [[1, 2, 3, 4]]), 99)) == [[1.0, 2.0, 3.0, 4.0]]
    with pytest.raises(ValueError):
        VO.mrl_truncate(_vecs(spark, [[1, 2]]), 0)


def test_norm_stats_population_std(spark):
    r = VO.norm_stats(_vecs(spark, [[1, 0], [0, 2]])).first()
    assert r["n_vectors"] == 2
    assert r["mean_l2_norm"] == pytest.approx(1.5)
    assert r["std_l2_norm"] == pytest.approx(0.5)


def test_vector_summary_golden(spark):
    r = VO.vector_summary(_vecs(spark, [[3, 4, 0, 0]])).first()
    assert (r["width"], r["l2_norm"], r["min_value"], r["max_value"]) == (4, 5.0, 0.0, 4.0)
    assert r["mean_value"] == pytest.approx(1.75)
    assert r["std_value"] == pytest.approx(1.785357, abs=1e-6)


def test_preview_tail_edges(spark):
    df = _vecs(spark, [[1, 2, 3], []])
    for n, expect in [(2, [[2.0, 3.0], []]), (0, [[], []]), (10, [[1.0, 2.0, 3.0], []])]:
        rows = VO.vector_preview(df, n).orderBy("vec_id").collect()
        assert [r["tail"] for r in rows] == expect
    rows = VO.vector_preview(df, 2).orderBy("vec_id").collect()
    assert [r["head"] for r in rows] == [[1.0, 2.0], []]


def test_unit_norm_invariant_on_table(spark, sf_dir):
    from vectorloom.sources.tables import read_table
    emb = read_table(spark, sf_dir, "embeddings")
    unit = VO.truncate_normalize(emb, 16)
    norms = unit.select(V.l2_norm("embedding").alias("n")).agg(F.min("n"), F.max("n")).first()
    assert norms[0] == pytest.approx(1.0, abs=1e-5) and norms[1] == pytest.approx(1.0, abs=1e-5)


def test_mrl_path_equivalence(spark, sf_dir):
    from vectorloom.sources.tables import read_table
    emb = read_table(spark, sf_dir, "embeddings")
    worst = VO.mrl_path_check(emb, 32).agg(F.max("max_abs_diff")).first()[0]
    assert worst < 1e-6


def test_normalize_is_linear_in_width(spark):
    """The norm is bound once per row: 4,096-wide vectors stay cheap."""
    d = 4096
    df = spark.range(64).select(F.col("id").alias("vec_id"),
                                F.transform(F.sequence(F.lit(1), F.lit(d)),
                                            lambda i: (i % 7).cast("float")).alias("embedding"))
    out = VO.l2_normalize(df).select(V.l2_norm("embedding").alias("n")).agg(F.max("n")).first()[0]
    assert out == pytest.approx(1.0, abs=1e-5)
    expr = str(V.normalize("embedding")).lower()
    assert expr.count("sqrt") == 1 and expr.startswith("column<'aggregate(")


def test_effective_dimension(spark):
    from vectorloom.sources.runs import effective_dimension
    df = spark.createDataFrame([("default",), ("768",), ("4096",), ("abc",)], "req string")
    got = [r[0] for r in df.select(effective_dimension(F.col("req"), F.lit(1024))).collect()]
    assert got == [1024, 768, 1024, None]


def test_math_constant():
    assert V.NORM_EPS == 1e-12 and math.isclose(math.log(10), 2.302585, abs_tol=1e-6)


@pytest.mark.parametrize("width", [1, 64, 1024])
def test_arrow_engine_equals_jvm(spark, width):
    rows = [(i, [float((i * 7 + j) % 11 - 5) for j in range(width)]) for i in range(40)]
    rows += [(100, [0.0] * width), (101, None), (102, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    jvm = {r["vec_id"]: r["embedding"] for r in VO.l2_normalize(df).collect()}
    arrow = {r["vec_id"]: r["embedding"] for r in VO.l2_normalize(df, engine="arrow").collect()}
    assert jvm == arrow
    side = VO.l2_normalize(df, out="unit", engine="arrow")
    assert side.columns == ["vec_id", "embedding", "unit"]
    a = {r["vec_id"]: r["unit"] for r in side.collect()}
    assert a == jvm
    t = {r["vec_id"]: r["embedding"] for r in VO.truncate_normalize(df, 8, engine="arrow").collect()}
    assert t == {r["vec_id"]: r["embedding"] for r in VO.truncate_normalize(df, 8).collect()}
