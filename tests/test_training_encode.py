"""V1-V3 encoders and C1-C6 training invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.operators import encode as E
from vectorloom.operators import training as C
from vectorloom.sources.tables import read_table


def test_hashed_encoders_agree(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    a = {r["doc_id"]: r["embedding"] for r in E.encode_hashed(docs, 32).collect()}
    b = {r["doc_id"]: r["embedding"] for r in E.encode(docs, E.HashedEncoder(32), batch_size=7).collect()}
    assert a.keys() == b.keys()
    assert all(np.allclose(a[k], b[k]) for k in a)


def test_encode_carries_columns_through(spark):
    df = spark.createDataFrame([(1, "a b", 3, "x"), (2, "c", None, "y")],
                               "doc_id long, text string, label int, tag string")
    got = {r["doc_id"]: r for r in E.encode(df, E.HashedEncoder(8), carry=["text", "label", "tag"]).collect()}
    assert (got[1]["text"], got[1]["label"], got[1]["tag"]) == ("a b", 3, "x")
    assert (got[2]["text"], got[2]["label"], got[2]["tag"]) == ("c", None, "y")
    plain = {r["doc_id"]: r["embedding"] for r in E.encode(df, E.HashedEncoder(8)).collect()}
    assert {k: v["embedding"] for k, v in got.items()} == plain


def test_encode_empty_input(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert E.encode(empty, E.HashedEncoder(8)).count() == 0


def test_encode_dimension_and_normalize(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma delta")], "doc_id long, text string")
    v = E.encode(df, E.HashedEncoder(16), dimension=8, normalize=True).first()["embedding"]
    assert len(v) == 8
    assert math.isclose(sum(x * x for x in v), 1.0, rel_tol=1e-5) or sum(x * x for x in v) == 0
    wide = E.encode(df, E.HashedEncoder(16), dimension=99).first()["embedding"]
    assert len(wide) == 16


def test_last_token_pool_golden(spark):
    rows = [(0, p, m, [float(h)]) for p, m, h in zip(range(3), [0, 1, 1], [0, 1, 2])]
    rows += [(1, p, m, [float(h)]) for p, m, h in zip(range(3), [1, 1, 0], [3, 4, 9])]
    df = spark.createDataFrame(rows, "seq long, pos int, mask int, hidden array<double>")
    got = {r["seq"]: r["pooled"][0] for r in E.last_token_pool(df, "seq", "pos", "mask", "hidden").collect()}
    assert got == {0: 2.0, 1: 4.0}


def test_linear_predict_ties_to_lowest_label(spark):
    df = spark.createDataFrame([(1, [1.0, 1.0, 0.5], 0)], "vec_id long, embedding array<double>, label int")
    W = np.array([[0.0, 0.0, 0.0, 0.0], [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0]])
    assert C.linear_predict(df, W).first()["pred"] == 1


def _toy(spark, n=200, d=4, k=3, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, k, n)
    X = rng.normal(size=(n, d)) + np.eye(k, d)[y] * 3
    return spark.createDataFrame([(int(i), X[i].tolist(), int(y[i])) for i in range(n)],
                                 "doc_id long, features array<double>, label int")


def test_softmax_grad0_loss_is_ln_k(spark):
    df = _toy(spark, k=10).withColumnRenamed("features", "embedding")
    r = C.softmax_grad0(df).agg(F.max("loss")).first()[0]
    assert r == pytest.approx(math.log(10), abs=1e-9)


def test_loss_curve_decreases(spark):
    curve = C.loss_curve(_toy(spark), 3, 4, epochs=10, lr=0.05).orderBy("epoch").collect()
    losses = [r["loss"] for r in curve]
    assert len(losses) == 10 and losses[-1] < losses[0]


def _reference_loop(X, y, hashes, k, epochs, batch_size, lr):
    """The head's training loop in plain numpy, batches taken by the rows' hashes per epoch."""
    n, d = X.shape
    W = np.zeros((k, d + 1))
    m, v, t = np.zeros_like(W), np.zeros_like(W), 0
    Xb = np.hstack([X, np.ones((n, 1))])
    steps = math.ceil(n / batch_size) if batch_size else 1
    losses = []
    for epoch in range(epochs):
        total = 0.0
        for s in range(steps):
            idx = np.flatnonzero(hashes[epoch] % steps == s)
            if not len(idx):
                continue
            z = Xb[idx] @ W.T
            logp = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
            total += -logp[np.arange(len(idx)), y[idx]].sum()
            g = np.exp(logp)
            g[np.arange(len(idx)), y[idx]] -= 1.0
            g = g.T @ Xb[idx] / len(idx)
            t += 1
            m = 0.9 * m + 0.1 * g
            v = 0.999 * v + 0.001 * g ** 2
            W = W - lr * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        losses.append(total / n)
    return W, losses


@pytest.mark.parametrize("batch_size", [None, 40])
@pytest.mark.parametrize("partitions", [1, 4, 32])
def test_training_is_the_sequential_loop_on_any_partitioning(spark, batch_size, partitions):
    df = _toy(spark, n=150)
    rows = df.select("*", *[F.xxhash64(F.xxhash64("features", "label"), F.lit(42), F.lit(e)).alias(f"h{e}")
                            for e in (1, 2, 3)]).collect()
    X = np.array([r["features"] for r in rows])
    y = np.array([r["label"] for r in rows])
    hashes = [np.array([r[f"h{e}"] for r in rows]) for e in (1, 2, 3)]
    params, curve = C.train_heads(df.repartition(partitions), 3, 4,
                                  [{"lr": 0.05, "epochs": 3, "batch_size": batch_size}])
    W, losses = _reference_loop(X, y, hashes, 3, 3, batch_size, 0.05)
    assert [e for _, e, _ in curve] == [1, 2, 3]
    assert np.allclose([x for _, _, x in curve], losses, rtol=0, atol=1e-9)
    assert np.allclose(params[0], W, rtol=0, atol=1e-9)


def test_adapter_does_not_depend_on_the_partitioning(spark):
    df = _toy(spark, n=90)
    curves = [[x for _, x in C.fit_adapter(df.repartition(p), df, 3, 4, epochs=2, lr=0.01, batch_size=45)[0]]
              for p in (1, 4, 32)]
    assert np.allclose(curves, curves[0], rtol=0, atol=1e-9)


def test_gradient_blocks_cover_models_wider_than_one_block(spark, monkeypatch):
    df = _toy(spark, n=60)
    whole = C.train_heads(df, 3, 4, [{"lr": 0.05, "epochs": 2}])
    monkeypatch.setattr(C, "BLOCK_WIDTH", 7)
    cut = C.train_heads(df, 3, 4, [{"lr": 0.05, "epochs": 2}])
    assert np.allclose(whole[0], cut[0], rtol=0, atol=1e-12) and np.allclose(whole[1], cut[1])


def test_training_without_rows_gives_zero_weights(spark):
    empty = spark.createDataFrame([(1, [1.0, 2.0], None)], "doc_id long, features array<double>, label int")
    params, curve = C.train_heads(empty, 3, 2, [{"lr": 0.1, "epochs": 2}])
    assert not params.any() and curve == []


def test_unknown_labels_count_as_misses(spark):
    df = _toy(spark, n=80)
    test = df.limit(40).unionByName(df.limit(40).withColumn("label", F.lit(None).cast("int")))
    out = C.sweep_heads(df, test, 3, 4, [{"lr": 0.1, "epochs": 15}]).first()
    assert out["n"] == 80 and 0.3 < out["accuracy"] <= 0.5


def test_dropout_mask_follows_the_row():
    h = np.array([5, 9, 5], dtype=np.uint64)
    keep = C._dropout_mask(h, 2000, 0.25)
    assert np.array_equal(keep[0], keep[2]) and not np.array_equal(keep[0], keep[1])
    assert set(np.unique(keep)) == {0.0, 1 / 0.75} and abs((keep == 0).mean() - 0.25) < 0.03


def test_encode_keeps_the_key_type_and_fills_batches(spark):
    df = spark.range(30).select(F.concat(F.lit("k"), "id").alias("doc_id"), F.lit("a b").alias("text")).coalesce(1)

    class Sizes(E.HashedEncoder):
        def load(self):
            return lambda texts: np.full((len(texts), 1), len(texts), dtype=np.float32)

    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        rows = E.encode(df, Sizes(1), batch_size=4).collect()
        assert E.encode_hashed(df, 8).schema["doc_id"].dataType.simpleString() == "string"
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len({r["doc_id"] for r in rows}) == 30
    assert sorted(int(r["embedding"][0]) for r in rows) == [2] * 2 + [4] * 28


def test_encode_max_length_cuts_for_any_encoder(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, None), (3, "")], "doc_id long, text string")
    cut = {r[0]: r[1] for r in E.encode(df, E.HashedEncoder(8), max_length=2).collect()}
    want = {r[0]: r[1] for r in E.encode_hashed(df, 8, max_length=2).collect()}
    assert cut == want


def test_building_an_encode_runs_no_job(spark):
    sc = spark.sparkContext
    sc.setJobGroup("vl-encode-build", "build only")
    try:
        grouped = spark.range(50).groupBy((F.col("id") % 5).alias("doc_id")).agg(F.lit("a").alias("text"))
        E.encode(grouped, E.HashedEncoder(8))
        assert list(sc.statusTracker().getJobIdsForGroup("vl-encode-build")) == []
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_fit_head_learns_separable_data(spark):
    df = _toy(spark)
    _, preds = C.fit_head(df, df, 3, "features", "label", max_iter=50)
    acc = preds.select(F.avg((F.col("truth") == F.col("pred")).cast("double"))).first()[0]
    assert acc > 0.9


def test_sweep_heads_one_row_per_config(spark):
    df = _toy(spark)
    cfgs = [{"lr": 0.05, "epochs": 3}, {"lr": 0.1, "epochs": 5}]
    out = C.sweep_heads(df, df, 3, 4, cfgs).collect()
    assert sorted(r["config_id"] for r in out) == [0, 1]
    assert all(0.0 <= r["accuracy"] <= 1.0 for r in out)


def test_fit_adapter_param_count(spark):
    df = _toy(spark)
    curve, preds, trainable = C.fit_adapter(df, df, 3, 4, epochs=2)
    assert trainable == 2 * C.ADAPTER_RANK * 4 and len(curve) == 2
    assert preds.count() == df.count()


def test_adapter_gradient_matches_finite_differences():
    rng = np.random.default_rng(1)
    d, r, k, n = 5, 2, 3, 7
    shapes = [(r, d), (d, r), (k, d + 1)]
    flat = rng.normal(size=sum(int(np.prod(s)) for s in shapes)) * 0.3
    X = rng.normal(size=(n, d))
    y = rng.integers(0, k, n)
    keep = (rng.random((n, d)) >= 0.2) / 0.8
    _, g = C._adapter_grads(flat, shapes, X, y, keep)
    eps = 1e-6
    num = np.zeros_like(flat)
    for i in range(flat.size):
        e = np.zeros_like(flat)
        e[i] = eps
        up = C._adapter_grads(flat + e, shapes, X, y, keep)[0]
        down = C._adapter_grads(flat - e, shapes, X, y, keep)[0]
        num[i] = (up - down) / (2 * eps)
    assert np.allclose(g, num, atol=1e-7)


def test_fit_adapter_loss_falls(spark):
    df = _toy(spark, n=400).repartition(2, "doc_id")
    curve, _, _ = C.fit_adapter(df, df, 3, 4, epochs=3, lr=0.01, batch_size=100)
    assert [e for e, _ in curve] == [1, 2, 3] and curve[-1][1] < curve[0][1]


def test_hashed_encoder_cache_bound_does_not_change_vectors(monkeypatch):
    texts = ["a b a c", None, "", "b b  d\ta", "a"]
    full = E.HashedEncoder(8).load()(texts)
    monkeypatch.setattr(E, "CODE_CACHE_MAX", 1)
    tiny = E.HashedEncoder(8).load()(texts)
    assert np.array_equal(full, tiny) and full.dtype == np.float32 and full.shape == (5, 8)
    assert not full[1].any()


def test_scatter_memory_does_not_follow_the_batch(spark):
    """Ten million codes, 40 MB, come in few Arrow batches; the task's growth on them was over 300 MB."""
    from vectorloom.operators import metrics as M
    peak = M.peak_accumulator(spark)
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a b c d e "), 1000).alias("text")).coalesce(1)
    counts = E.encode_hashed(df, 8, peak=peak)
    assert counts.select("embedding").distinct().count() == 1 and peak.value < 150e6


def test_scatter_in_pieces_gives_the_same_counts(monkeypatch):
    import pyarrow as pa
    rng = np.random.default_rng(5)
    lists = [None if n == 3 else [int(x) for x in rng.integers(1, 9, n) * rng.choice([-1, 1], n)] for n in rng.integers(0, 40, 60)]
    want = np.zeros((60, 8))
    for i, codes in enumerate(lists):
        for c in codes or []:
            want[i, abs(c) - 1] += np.sign(c)
    held = pa.array([[1]] * 4 + lists, type=pa.list_(pa.int32())).slice(4)
    for size in (1, 7, 64, 1 << 18):
        monkeypatch.setattr(E, "SCATTER_CODES", size)
        assert np.array_equal(E.signed_counts(held, 8).reshape(60, 8), want.astype(np.float32))
        assert len(E.signed_counts(held.slice(0, 0), 8)) == 0


def test_objectives_get_pieces(monkeypatch):
    import pandas as pd
    monkeypatch.setattr(C, "PIECE_ROWS", 4)
    got = [list(p["x"]) for p in C._pieces([pd.DataFrame({"x": range(10)}), pd.DataFrame({"x": []}), pd.DataFrame({"x": [7]})])]
    assert got == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9], [7]]


def test_head_gradient_is_that_of_the_loss_and_certifies_a_fit(spark):
    import numpy as np
    from vectorloom.operators import training as C
    rng = np.random.default_rng(3)
    X, y = rng.normal(size=(90, 3)), rng.integers(0, 3, size=90)
    rows = [([float(v) for v in x], int(c) * 2, "p") for x, c in zip(X, y)] + [([0.0, 1.0, 2.0], None, "p"), ([0.0, 1.0, 2.0], 9, "p")]
    df = spark.createDataFrame(rows, "features array<double>, label int, extra string")
    classes, W = np.array([0, 2, 4]), rng.normal(size=(3, 4))

    def loss_at(w):
        z = np.hstack([X, np.ones((90, 1))]) @ w.T
        return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(90), y]))

    for parts in (1, 7):
        loss, n, grad = C.head_gradient(df.repartition(parts), W, classes)
        assert n == 90 and abs(loss - loss_at(W)) < 1e-12
    for k, j in ((0, 0), (1, 2), (2, 3)):
        step = np.zeros_like(W)
        step[k, j] = 1e-6
        assert abs((loss_at(W + step) - loss_at(W - step)) / 2e-6 - grad[k, j]) < 1e-7
    train = df.where("label <= 4").selectExpr("features", "label div 2 AS label")
    model, _ = C.fit_head(train, train, 3)
    fitted = np.column_stack([model.coefficientMatrix.toArray(), model.interceptVector.toArray()])
    loss, _, grad = C.head_gradient(train, fitted)
    assert np.abs(grad).max() < 1e-3 < np.abs(C.head_gradient(train, fitted + 0.5 * W)[2]).max()
    assert C.head_gradient(df.limit(0), W, classes)[:2] == (None, 0)
