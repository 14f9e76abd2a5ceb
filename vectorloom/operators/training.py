"""Classifier heads on vectors: C1-C8.

* ``fit_head`` (C1): Spark ML multinomial logistic regression, no
  regularisation: the reference's objective (softmax cross-entropy with a
  bias), solved by L-BFGS over distributed ``treeAggregate`` instead of Adam.
* ``loss_curve`` / ``sweep_heads`` (C2, C5): synchronous Adam. A large step is
  one Spark job: the state is broadcast (size checked), every task adds up
  the gradient of its rows of the step's batch, Spark sums the partial
  gradients in fixed-width blocks, and the driver takes the step. Small keyed
  steps go by the chunk: one job takes the steps of up to CHUNK_ROWS rows one
  after the other and hands the state on, so jobs grow with the rows, not the steps.
* ``fit_adapter`` (C6): the same scheme with AdamW and the adapter's gradient.
  The training frame is persisted once and re-read by every step.
* ``head_gradient`` (C1): loss and gradient at given weights in one pass over
  the rows, the certificate that a fitted head is at its (convex) optimum.
* ``softmax_grad0`` (C3) and ``linear_predict`` (C4) are the checkable
  pieces: the gradient at zero weights in pure SQL, and argmax scoring.

The batch of a row, and its dropout mask, follow from a seeded hash of its
values, or its batch from the epoch's seeded permutation of a key column
(``key``: exact batches, the last one short, as a shuffling loader deals
them), so losses and weights do not depend on the partitioning (only the
last bits of floating-point sums do). An epoch of several steps is written
once, bucketed by step or by chunk of steps, and each job reads its own bucket:
an epoch reads its rows once however many steps it has. Deviations from the reference: heads
start at zero weights, batches without a key hold about ``batch_size`` rows
(copies of a row share a batch), and runs are seeded.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorloom.functions.keys import hex_prefix_value, seeded_key
from vectorloom.operators import metrics as M
from vectorloom.operators.sampling import seeded_position
from vectorloom.session import remove_scratch, scratch_path

# Upper bound for anything broadcast or collected as model state
# (weights, centroids, gradients): K x (d + 1) doubles.
MAX_MODEL_BYTES = 256 << 20

# Values in one row of a partial gradient.
BLOCK_WIDTH = 4096

# Most tasks that add up one step's gradient; a step shuffles at most this many models.
MERGE_WIDTH = 1024
# Rows of a step that share a file: larger steps are dealt over several.
SHARD_ROWS = 65_536
# Most rows of the consecutive small steps that one job takes, in one task.
CHUNK_ROWS = 16_384
# Rows of an Arrow batch that an objective is given at once.
PIECE_ROWS = 2048
PARTIALS = "block int, part array<double>"
STEP_LOG = "config_id int, epoch int, step int, n_rows long, loss double"

# Per-mode defaults of the reference (frozen head / adapter).
MODE_DEFAULTS = {
    "frozen": {"epochs": 10, "batch_size": 32, "lr": 1e-3},
    "lora": {"epochs": 3, "batch_size": 8, "lr": 2e-4},
}
# Adapter hyper-parameters of the reference.
ADAPTER_RANK = 8
ADAPTER_ALPHA = 16
ADAPTER_DROPOUT = 0.05
ADAMW_WEIGHT_DECAY = 0.01


def _check_model_size(n_values: int, what: str) -> None:
    if n_values * 8 > MAX_MODEL_BYTES:
        raise ValueError(f"{what} has {n_values} values, above the {MAX_MODEL_BYTES >> 20} MB "
                         "bound for broadcast model state")


def _sum_blocks(partials: DataFrame, size: int, few_tasks: bool = False) -> np.ndarray:
    """Sum the tasks' partial vectors (``block``, ``part``) into one array of ``size``.

    The blocks are summed elementwise in the JVM; the result is model-sized
    and checked before training starts. ``few_tasks``: the rows lie in one small
    file, so the partials are its task's own and need no exchange.
    """
    if few_tasks:
        out = np.zeros(size, dtype=np.float64)
        for block, part in partials.collect():
            out[block * BLOCK_WIDTH:block * BLOCK_WIDTH + len(part)] += part
        return out
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    summed = (partials.groupBy("block").agg(Summarizer.sum(array_to_vector("part")).alias("v"))
              .select("block", vector_to_array("v").alias("v")).collect())
    out = np.zeros(size, dtype=np.float64)
    for r in summed:
        at = r["block"] * BLOCK_WIDTH
        out[at:at + len(r["v"])] = r["v"]
    return out


def _pieces(batches):
    """The batches in pieces of at most PIECE_ROWS rows; empty ones go."""
    for pdf in batches:
        for a in range(0, len(pdf), PIECE_ROWS):
            yield pdf.iloc[a:a + PIECE_ROWS]


def _gradient_sums(state_bc, objective, size: int, features: str, label: str, peak=None):
    """mapInPandas body: the task's sum of ``objective`` over its rows, in blocks.

    ``objective(state, X, y, h)`` returns one vector of ``size`` values, summed
    over the rows given. Rows are read one Arrow batch at a time and worked on in pieces.
    """
    def run(batches):
        import pandas as pd
        total, seen = np.zeros(size), False
        with M.PeakWatch(peak is not None) as watch:
            for pdf in _pieces(batches):
                seen = True
                total += objective(state_bc.value, _stack(pdf[features]), pdf[label].to_numpy().astype(np.int64),
                                   pdf["_h"].to_numpy().astype(np.int64).view(np.uint64))
                if peak is not None:
                    peak.add(watch.lap())
        if seen:
            starts = range(0, size, BLOCK_WIDTH)
            yield pd.DataFrame({"block": np.arange(len(starts), dtype=np.int32),
                                "part": [total[i:i + BLOCK_WIDTH] for i in starts]})

    return run


def _chunk_steps(state_bc, shapes, objective, update, size: int, ids: list, epoch: int, log: bool, features: str,
                 label: str, peak=None):
    """mapInPandas body: takes the steps of a chunk, whose rows come sorted by ``step_no``, one after the other.

    ``update(state, sums)`` returns the state after a step, whose rows' sum of ``objective`` at the first array of the
    state is ``sums``. Rows are read one Arrow batch at a time. Yields, with ``log``, a row per step and head of ``ids``,
    and the last state in blocks.
    """
    def run(batches):
        import pandas as pd
        state, number, sums, done = _unflatten(state_bc.value, shapes), None, np.zeros(size), []

        def take():
            nonlocal state
            if number is not None:
                done.extend((c, epoch, number, int(sums[-1]), float(x / sums[-1]))
                            for c, x in zip(ids if log else (), sums[-1 - len(ids):-1]))
                state = update(state, sums)

        with M.PeakWatch(peak is not None) as watch:
            for pdf in _pieces(batches):
                X, y = _stack(pdf[features]), pdf[label].to_numpy().astype(np.int64)
                h, step = pdf["_h"].to_numpy().astype(np.int64).view(np.uint64), pdf["step_no"].to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(step)) + 1), len(step)]
                for a, b in zip(cuts, cuts[1:]):
                    if step[a] != number:
                        take()
                        number, sums = int(step[a]), np.zeros(size)
                    sums += objective(state[0], X[a:b], y[a:b], h[a:b])
                if peak is not None:
                    peak.add(watch.lap())
        take()
        if done:
            yield pd.DataFrame(done, columns=["config_id", "epoch", "step", "n_rows", "loss"]).assign(block=None, part=None)
        if number is not None:
            flat = np.concatenate([np.ravel(a) for a in state])
            starts = range(0, len(flat), BLOCK_WIDTH)
            yield pd.DataFrame({"config_id": None, "epoch": epoch, "step": None, "n_rows": None, "loss": None,
                                "block": np.arange(len(starts), dtype=np.int32),
                                "part": [flat[i:i + BLOCK_WIDTH] for i in starts]})

    return run


def _training_rows(train: DataFrame, features: str, label: str, key: str | None = None) -> tuple[DataFrame, int]:
    """(persisted rows with a labelled class, their content hash and key, how many)."""
    data = (train.where(F.col(label).isNotNull())
                 .select(features, label, F.xxhash64(features, label).alias("_h0"), *([key] if key else []))
                 .persist(StorageLevel.MEMORY_AND_DISK))
    return data, data.count()


def epoch_seed(seed: int, epoch: int) -> int:
    """Seed of one epoch's permutation."""
    return int(seed) * 1_000_003 + int(epoch)


def bucket_by_step(rows: DataFrame, batch_size: int, merge_width: int = MERGE_WIDTH) -> tuple[str, list[int]]:
    """Write ``rows`` (with ``step_no``) once, one folder per step; returns the path and the steps present.

    A step of up to SHARD_ROWS rows is one file; a larger one is dealt over
    several by a hash of its rows, so no task writes a whole large step.
    """
    spark = rows.sparkSession
    shards = max(1, min(merge_width, -(-batch_size // SHARD_ROWS)))
    path = scratch_path(spark, "epoch")
    (rows.withColumn("_shard", F.pmod(F.xxhash64("_h"), F.lit(shards))).repartition("step_no", "_shard")
         .drop("_shard").write.partitionBy("step_no").parquet(path))
    # One value per step, which the training loop goes through one by one anyway.
    steps = spark.read.schema(rows.schema).parquet(path).select("step_no").distinct().collect()
    return path, sorted(r[0] for r in steps)


def _batches_of(data: DataFrame, n: int, batch_size: int | None, seed: int, epoch: int, merge_width: int,
                key: str | None = None):
    """(frame of a batch, whether it is one small file), batch after batch of an epoch.

    With a key a row's step is its place in the epoch's permutation divided by
    ``batch_size``, else a seeded hash of its values. ``batch_size`` None: one
    batch of all rows. At most ``merge_width`` tasks run a batch, so a step
    shuffles at most that many models.
    """
    steps = -(-n // batch_size) if batch_size else 1
    own = F.xxhash64("_h0", F.lit(int(seed)), F.lit(int(epoch)))
    if key:
        own = F.coalesce(hex_prefix_value(seeded_key(key, epoch_seed(seed, epoch)), 15), own)
    dealt = data.withColumn("_h", own).drop("_h0")
    columns = [c for c in dealt.columns if c != key]
    if steps == 1:
        yield dealt.select(columns).coalesce(merge_width), False
        return
    if key:
        step = F.floor(F.col("_place") / int(batch_size))
        dealt = seeded_position(dealt, key, epoch_seed(seed, epoch), "_place")
    else:
        step = F.pmod(F.col("_h"), F.lit(steps))
    spark = data.sparkSession
    bucketed = dealt.select(*columns, step.cast("long").alias("step_no"))
    path, present = bucket_by_step(bucketed, batch_size, merge_width)
    schema = bucketed.drop("step_no").schema
    try:
        for number in present:
            yield (spark.read.schema(schema).parquet(f"{path}/step_no={number}").coalesce(merge_width),
                   batch_size <= SHARD_ROWS)
    finally:
        remove_scratch(spark, path)


def _chunks_of(data: DataFrame, batch_size: int, seed: int, epoch: int, key: str):
    """Frames of one partition with the rows of consecutive keyed steps, sorted by ``step_no``, chunk after chunk of an epoch."""
    spark = data.sparkSession
    own = F.xxhash64("_h0", F.lit(int(seed)), F.lit(int(epoch)))
    own = F.coalesce(hex_prefix_value(seeded_key(key, epoch_seed(seed, epoch)), 15), own)
    placed = seeded_position(data.withColumn("_h", own).drop("_h0"), key, epoch_seed(seed, epoch), "_place")
    step = F.floor(F.col("_place") / int(batch_size)).cast("long")
    rows = placed.select(*[c for c in placed.columns if c not in (key, "_place", "sort_key")], step.alias("step_no"))
    rows = rows.withColumn("chunk", F.floor(F.col("step_no") / (CHUNK_ROWS // int(batch_size))).cast("long"))
    path = scratch_path(spark, "epoch")
    try:
        rows.repartition("chunk").write.partitionBy("chunk").parquet(path)
        # One value per chunk, which the training loop goes through one by one anyway.
        chunks = spark.read.schema(rows.schema).parquet(path).select("chunk").distinct().collect()
        schema = rows.drop("chunk").schema
        for number in sorted(r[0] for r in chunks):
            yield spark.read.schema(schema).parquet(f"{path}/chunk={number}").coalesce(1).sortWithinPartitions("step_no")
    finally:
        remove_scratch(spark, path)


def _run_epoch(data: DataFrame, n: int, batch_size: int | None, seed: int, epoch: int, merge_width: int, key: str | None,
               state: list, objective, update, size: int, ids: list, features: str, label: str, peak=None,
               log: str | None = None) -> list:
    """The state after an epoch's steps; ``update`` and ``ids`` as in ``_chunk_steps``.

    ``log``: a folder that gets the epoch's steps (STEP_LOG), written by the tasks where they take the steps.
    """
    spark = data.sparkSession
    if key and batch_size and batch_size < n and 2 * batch_size <= CHUNK_ROWS:
        shapes = [np.shape(a) for a in state]
        for number, chunk in enumerate(_chunks_of(data, batch_size, seed, epoch, key)):
            flat = np.concatenate([np.ravel(a) for a in state])
            bc = spark.sparkContext.broadcast(flat)
            fn = _chunk_steps(bc, shapes, objective, update, size, ids, epoch, log is not None, features, label, peak)
            out = chunk.mapInPandas(fn, f"{STEP_LOG}, {PARTIALS}")
            if log:
                path = f"{log}/part=chunk-{epoch}-{number}"
                out.write.parquet(path)
                out = spark.read.schema(out.schema).parquet(path)
            state = _unflatten(_sum_blocks(out.where("block IS NOT NULL").select("block", "part"), len(flat), True), shapes)
            bc.unpersist()
        return state
    steps = []
    for number, (batch, alone) in enumerate(_batches_of(data, n, batch_size, seed, epoch, merge_width, key)):
        bc = spark.sparkContext.broadcast(state[0])
        sums = _sum_blocks(batch.mapInPandas(_gradient_sums(bc, objective, size, features, label, peak), PARTIALS), size, alone)
        bc.unpersist()
        if not sums[-1]:
            continue  # no row fell into this batch
        steps += [(c, epoch, number, int(sums[-1]), float(x / sums[-1])) for c, x in zip(ids, sums[-1 - len(ids):-1])]
        state = update(state, sums)
    if log:
        spark.createDataFrame(steps, STEP_LOG).write.parquet(f"{log}/part=steps-{epoch}")
    return state


def _stack(series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in series]) if len(series) else np.zeros((0, 0))


# ------------------------------------------------------------ C1 (Spark ML)

def fit_head(train: DataFrame, test: DataFrame, num_classes: int, features: str = "features",
             label: str = "label", max_iter: int = 100):
    """Fit the linear head on ``train``, score ``test``.

    Returns (model, predictions frame with ``truth``/``pred``; a test row
    without a known label keeps a null truth). The label
    column carries nominal metadata so the head has one output per
    vocabulary class, even for classes absent from the sample.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    meta = {"ml_attr": {"type": "nominal", "num_vals": int(num_classes), "name": label}}

    def prep(df):
        return df.select(
            array_to_vector(F.col(features).cast("array<double>")).alias("features"),
            F.col(label).cast("double").alias("label", metadata=meta))

    lr = LogisticRegression(family="multinomial", regParam=0.0, elasticNetParam=0.0,
                            standardization=False, maxIter=max_iter, tol=1e-6)
    # The estimator makes a statistics pass over its input before it builds
    # (and caches) its training blocks, so an unpersisted input would run the
    # encoder twice. Encode once: persist for the fit, release afterwards.
    prepared = prep(train.where(F.col(label).isNotNull()))
    owned = not train.storageLevel.useMemory and not train.storageLevel.useDisk
    if owned:
        prepared = prepared.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = lr.fit(prepared)
    finally:
        if owned:
            prepared.unpersist()
    scored = model.transform(prep(test))
    return model, scored.select(F.col("label").cast("int").alias("truth"),
                                F.col("prediction").cast("int").alias("pred"))


def _certified_objective(state, X, y, h):
    """``_heads_objective`` of one head over the rows whose label is one of its classes."""
    weights, classes = state
    place = np.searchsorted(classes, y).clip(max=len(classes) - 1)
    known = classes[place] == y
    return _heads_objective(weights[None], X[known], place[known], h)


def head_gradient(df: DataFrame, W: np.ndarray, classes: np.ndarray | None = None, features: str = "features",
                  label: str = "label", merge_width: int = MERGE_WIDTH) -> tuple[float | None, int, np.ndarray]:
    """(mean loss, rows, gradient (K, d + 1)) of softmax cross-entropy at the weights ``W``, in one pass.

    The objective is convex, so a gradient near zero certifies a fitted head, whatever fitted
    it. Weights are broadcast (size checked), tasks add up their rows, at most ``merge_width``
    partial gradients are shuffled. Rows without a label among ``classes`` (default 0..K-1)
    have no part in it; no rows: no loss and a zero gradient.
    """
    _check_model_size(W.size, "head parameters")
    ids = np.arange(W.shape[0]) if classes is None else np.asarray(classes)
    if not W.size:
        return None, 0, np.zeros_like(W)
    bc = df.sparkSession.sparkContext.broadcast((W, ids))
    rows = df.where(F.col(label).isNotNull()).select(features, label, F.lit(0).cast("long").alias("_h")).coalesce(merge_width)
    fn = _gradient_sums(bc, _certified_objective, W.size + 2, features, label)
    sums = _sum_blocks(rows.mapInPandas(fn, PARTIALS), W.size + 2)
    bc.unpersist()
    n = int(sums[-1])
    return (float(sums[-2] / n) if n else None), n, sums[:-2].reshape(W.shape) / max(n, 1)


# ---------------------------------- C2 / C5: synchronous Adam

def _adam_step(p, g, m, v, t, lr, betas=(0.9, 0.999), eps=1e-8, weight_decay=0.0):
    b1, b2 = betas
    if weight_decay:
        p = p * (1 - lr * weight_decay)
    m = b1 * m + (1 - b1) * g
    v = b2 * v + (1 - b2) * g * g
    mhat = m / (1 - b1 ** t)
    vhat = v / (1 - b2 ** t)
    return p - lr * mhat / (np.sqrt(vhat) + eps), m, v


def _heads_objective(params, X, y, _h):
    """Per head: gradient and loss of softmax cross-entropy, summed over the rows; then the row count."""
    Xb = np.hstack([X, np.ones((X.shape[0], 1))])
    rows = np.arange(X.shape[0])
    grads, losses = [], []
    for p in params:
        z = Xb @ p.T
        z -= z.max(axis=1, keepdims=True)
        logp = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        losses.append(-logp[rows, y].sum())
        prob = np.exp(logp)
        prob[rows, y] -= 1.0
        grads.append((prob.T @ Xb).ravel())
    return np.concatenate([*grads, losses, [float(len(rows))]])


def _heads_update(lrs: list[float]):
    """An Adam step of every head: state (weights, moments, moments, steps taken, summed losses), sums of ``_heads_objective``."""
    def update(state, sums):
        params, m, v, t, total = state
        grads = sums[:params.size].reshape(params.shape) / sums[-1]
        moved = [_adam_step(p, g, m[c], v[c], t[c] + 1, lrs[c]) for c, (p, g) in enumerate(zip(params, grads))]
        return [*(np.stack(x) for x in zip(*moved)), t + 1, total + sums[params.size:-1]]
    return update


def train_heads(train: DataFrame, num_classes: int, dim: int, configs: list[dict],
                features: str = "features", label: str = "label", seed: int = 42,
                merge_width: int = MERGE_WIDTH, peak=None, key: str | None = None, log: str | None = None):
    """Train several heads: one Spark job per step, or per chunk of small keyed steps, for all heads of a batch size.

    ``configs``: dicts with ``lr``, ``epochs`` and ``batch_size`` (rows of one
    synchronous step over the cluster; None or absent: all rows, one step an
    epoch). Weights start at zero. The epoch loss is the reference's: the
    size-weighted mean of the batch losses, each taken before its step. Rows
    without a label are left out; no rows: zero weights and no losses.
    ``peak`` (``metrics.peak_accumulator``) receives the tasks' memory growth.
    ``key`` names a column whose seeded permutation deals exact batches; rows with a
    null key cannot be placed and are left out of epochs of several steps. ``log`` is a
    folder that gets every step's head, epoch, number, rows and mean loss before the step.
    Returns (params (C, K, d+1), loss rows [(config_id, epoch, loss)]).
    """
    C, K = len(configs), int(num_classes)
    _check_model_size(3 * C * K * (dim + 1), "head parameters and Adam moments")
    by_size: dict = {}
    for c, cfg in enumerate(configs):
        size = cfg.get("batch_size")
        if size is not None and int(size) < 1:
            raise ValueError("batch_size must be >= 1")
        by_size.setdefault(size, []).append(c)
    params = np.zeros((C, K, dim + 1))
    m, v, t = np.zeros_like(params), np.zeros_like(params), np.zeros(C, dtype=int)
    curve = []
    data, n = _training_rows(train, features, label, key)
    try:
        for size, members in by_size.items() if n else ():
            for epoch in range(1, max(int(configs[c]["epochs"]) for c in members) + 1):
                live = [c for c in members if int(configs[c]["epochs"]) >= epoch]
                update = _heads_update([float(configs[c]["lr"]) for c in live])
                state = [params[live], m[live], v[live], t[live], np.zeros(len(live))]
                *state, total = _run_epoch(data, n, size, seed, epoch, merge_width, key, state, _heads_objective, update,
                                           len(live) * K * (dim + 1) + len(live) + 1, live, features, label, peak, log)
                params[live], m[live], v[live], t[live] = state
                curve += [(c, epoch, float(x / n)) for c, x in zip(live, total)]
    finally:
        data.unpersist()
    return params, sorted(curve)


def score_heads(df: DataFrame, params: np.ndarray, features: str = "features", label: str = "label",
                key: str | None = None, classes: np.ndarray | None = None) -> DataFrame:
    """Argmax predictions of every head in ``params`` (C, K, d+1) per row.

    Weights are broadcast (size checked); ties go to the lowest label.
    ``classes`` maps weight rows to label ids (default 0..K-1).
    Output: config_id, [key], truth, pred.
    """
    spark = df.sparkSession
    _check_model_size(params.size, "head parameters")
    ids = np.arange(params.shape[1]) if classes is None else np.asarray(classes)
    bc = spark.sparkContext.broadcast((params, ids))
    cols = [features, label] + ([key] if key else [])

    def run(batches):
        import pandas as pd
        P, ids = bc.value
        for pdf in batches:
            if len(pdf) == 0:
                continue
            X = _stack(pdf[features])
            Xb = np.hstack([X, np.ones((X.shape[0], 1))])
            for c in range(P.shape[0]):
                pred = ids[np.argmax(Xb @ P[c].T, axis=1)]
                out = {"config_id": np.full(len(pdf), c, dtype=np.int32)}
                if key:
                    out[key] = pdf[key].to_numpy()
                out["truth"] = pdf[label].astype("Int32")
                out["pred"] = pred.astype(np.int32)
                yield pd.DataFrame(out)

    schema = "config_id int, " + (f"{key} long, " if key else "") + "truth int, pred int"
    return df.select(*cols).mapInPandas(run, schema)


def score_counts(df: DataFrame, params: np.ndarray, features: str = "features",
                 label: str = "label") -> DataFrame:
    """config_id, truth, pred, n: how often every head pairs a label with a prediction.

    Counted inside the tasks, so rows x heads are never written out. A null
    label stays a null truth.
    """
    spark = df.sparkSession
    _check_model_size(params.size, "head parameters")
    bc = spark.sparkContext.broadcast(params)

    def run(batches):
        import pandas as pd
        for pdf in batches:
            if len(pdf) == 0:
                continue
            X = _stack(pdf[features])
            Xb = np.hstack([X, np.ones((X.shape[0], 1))])
            truth = pdf[label].astype("Int32")
            for c, p in enumerate(bc.value):
                pairs = pd.DataFrame({"truth": truth, "pred": np.argmax(Xb @ p.T, axis=1).astype(np.int32)})
                out = pairs.groupby(["truth", "pred"], dropna=False).size().reset_index(name="n")
                out.insert(0, "config_id", np.int32(c))
                yield out

    counted = df.select(features, label).mapInPandas(run, "config_id int, truth int, pred int, n long")
    return counted.groupBy("config_id", "truth", "pred").agg(F.sum("n").alias("n"))


def loss_curve(train: DataFrame, num_classes: int, dim: int, epochs: int = 10, lr: float = 1e-3,
               features: str = "features", label: str = "label", seed: int = 42,
               batch_size: int | None = None) -> DataFrame:
    """Mean training loss per epoch of synchronous Adam (see ``train_heads``)."""
    cfg = {"lr": lr, "epochs": epochs, "batch_size": batch_size}
    _, curve = train_heads(train, num_classes, dim, [cfg], features, label, seed)
    rows = [(e, loss) for _, e, loss in curve]
    return train.sparkSession.createDataFrame(rows, "epoch int, loss double")


def minibatch_curve(train: DataFrame, num_classes: int, dim: int, batch_size: int, key: str, epochs: int = 1,
                    lr: float = 1e-3, features: str = "features", label: str = "label", seed: int = 42) -> DataFrame:
    """C2, step by step: epoch, step, rows and mean loss (before the step) of every mini-batch, in this order."""
    spark = train.sparkSession
    log = scratch_path(spark, "steps")
    spark.createDataFrame([], STEP_LOG).write.parquet(f"{log}/part=none")
    train_heads(train, num_classes, dim, [{"lr": lr, "epochs": epochs, "batch_size": batch_size}], features, label,
                seed, key=key, log=log)
    steps = spark.read.schema(STEP_LOG).parquet(log).where("config_id IS NOT NULL")
    return steps.select("epoch", "step", "n_rows", "loss").orderBy("epoch", "step")


def sweep_heads(train: DataFrame, test: DataFrame, num_classes: int, dim: int, configs: list[dict],
                features: str = "features", label: str = "label", seed: int = 42) -> DataFrame:
    """One head per configuration, trained together; metrics per config.

    A test row whose label is not in the vocabulary (null) counts as a miss.
    """
    params, curve = train_heads(train, num_classes, dim, configs, features, label, seed)
    final = {c: loss for c, _, loss in curve}
    cfg = train.sparkSession.createDataFrame(
        [(i, float(c["lr"]), int(c["epochs"]), c.get("batch_size"), final.get(i)) for i, c in
         enumerate(configs)],
        "config_id int, lr double, epochs int, batch_size int, final_loss double")
    mets = M.classification_metrics(score_counts(test, params, features, label), by=["config_id"], weight="n")
    return cfg.join(F.broadcast(mets), "config_id", "left")


# ------------------------------------------------------------ C6: adapter

def _adapter_grads(flat, shapes, X, y, keep):
    """Mean loss and flat gradient of the adapter + head objective on a batch.

    x' = x + s * B (A (x * keep)); logits = W x' + b; softmax cross-entropy.
    ``keep`` is the dropout mask already scaled by 1 / (1 - p), or 1.0.
    """
    scale = ADAPTER_ALPHA / ADAPTER_RANK
    A, B, Wb = _unflatten(flat, shapes)
    W, b = Wb[:, :-1], Wb[:, -1]
    n = X.shape[0]
    rows = np.arange(n)
    Xd = X * keep
    H = Xd @ A.T
    Xp = X + scale * (H @ B.T)
    z = Xp @ W.T + b
    z -= z.max(axis=1, keepdims=True)
    logp = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    loss = -logp[rows, y].mean()
    dz = np.exp(logp)
    dz[rows, y] -= 1.0
    dz /= n
    gW = np.hstack([dz.T @ Xp, dz.sum(axis=0)[:, None]])
    dXp = dz @ W
    gB = scale * (dXp.T @ H)
    gA = (scale * (dXp @ B)).T @ Xd
    return loss, np.concatenate([gA.ravel(), gB.ravel(), gW.ravel()])


def _dropout_mask(h: np.ndarray, d: int, dropout: float):
    """Scaled keep mask (rows, d) from the rows' seeded hashes; 1.0 without dropout."""
    return (_uniforms(h, d) >= dropout) / (1.0 - dropout) if dropout > 0 else 1.0


def _uniforms(h: np.ndarray, d: int) -> np.ndarray:
    """(rows, d) numbers in [0, 1): the first ``d`` of the SplitMix64 stream that starts at each ``h``."""
    bits = h[:, None] + np.arange(1, d + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, mult in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        bits = (bits ^ (bits >> np.uint64(shift))) * np.uint64(mult)
    return ((bits ^ (bits >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def _adapter_objective(shapes, dropout: float):
    def objective(flat, X, y, h):
        loss, g = _adapter_grads(flat, shapes, X, y, _dropout_mask(h, X.shape[1], dropout))
        return np.concatenate([g * len(y), [loss * len(y), float(len(y))]])
    return objective


def _unflatten(flat, shapes):
    out, pos = [], 0
    for shp in shapes:
        size = int(np.prod(shp))
        out.append(flat[pos:pos + size].reshape(shp))
        pos += size
    return out


def fit_adapter(train: DataFrame, test: DataFrame, num_classes: int, dim: int, epochs: int = 3,
                lr: float = 2e-4, rank: int = ADAPTER_RANK, dropout: float = ADAPTER_DROPOUT,
                features: str = "features", label: str = "label", seed: int = 42,
                batch_size: int | None = None, merge_width: int = MERGE_WIDTH, peak=None, key: str | None = None):
    """C6 (re-aimed): a low-rank residual adapter on the vector, trained with the head.

    The reference adapts the backbone's attention projections, which needs
    the model runtime; here the adapter acts on the pooled vector
    (x' = x + alpha/r * B A x), a different model with the same training
    recipe (rank 8, alpha 16, dropout 0.05, AdamW, three epochs).
    Synchronous steps as in ``train_heads``. The start follows from the seed, the dropout mask of a row from the
    seed, the epoch and its ``key`` (without one: its values). The epoch loss is the unweighted
    mean of the batch losses, as the reference reports it. Returns (loss
    rows, predictions frame with truth/pred, trainable parameter count).
    """
    spark = train.sparkSession
    K, d, r = int(num_classes), int(dim), int(rank)
    if batch_size is not None and batch_size < 1:
        raise ValueError("batch_size must be >= 1")
    shapes = [(r, d), (d, r), (K, d + 1)]
    total = sum(int(np.prod(s)) for s in shapes)
    _check_model_size(3 * total, "adapter parameters and AdamW moments")
    # A and the head start uniform in +-1/sqrt(d), by their place in the flat state; B starts at zero.
    flat = (2 * _uniforms(np.array([int(seed) & (2 ** 64 - 1)], dtype=np.uint64), total)[0] - 1) / math.sqrt(d)
    flat[r * d:2 * r * d] = 0.0
    m, v, t = np.zeros_like(flat), np.zeros_like(flat), np.zeros(1)
    objective = _adapter_objective(shapes, dropout)

    def update(state, sums):
        flat, m, v, t, seen = state
        moved = _adam_step(flat, sums[:total] / sums[-1], m, v, t[0] + 1, lr, weight_decay=ADAMW_WEIGHT_DECAY)
        return [*moved, t + 1, seen + [sums[total] / sums[-1], 1.0]]

    curve = []
    data, n = _training_rows(train, features, label, key)
    try:
        for epoch in range(1, int(epochs) + 1) if n else ():
            flat, m, v, t, (losses, taken) = _run_epoch(
                data, n, batch_size, seed, epoch, merge_width, key, [flat, m, v, t, np.zeros(2)], objective, update,
                total + 2, [0], features, label, peak)
            curve.append((epoch, float(losses / taken) if taken else math.nan))
    finally:
        data.unpersist()
    A, B, Wb = _unflatten(flat, shapes)
    # fold the adapter into the head for scoring: W x' = W (I + sBA) x
    scale = ADAPTER_ALPHA / ADAPTER_RANK
    folded = Wb.copy()
    folded[:, :-1] = Wb[:, :-1] @ (np.eye(d) + scale * (B @ A))
    preds = score_heads(test, folded[None, :, :], features, label)
    return curve, preds.drop("config_id"), 2 * r * d


# ------------------------------------------------------- C3, C4 (checkable)

def softmax_grad0(df: DataFrame, features: str = "embedding", label: str = "label") -> DataFrame:
    """Loss and gradient of softmax cross-entropy at W = 0, b = 0.

    loss = ln K; grad[k, j] = mean_i((1/K - [y_i = k]) * x_ij). Per-(class,
    dim) sums with partial aggregation, then small windows over the
    K x d result (never over the data).
    """
    cells = (df.where(F.col(label).isNotNull())
               .select(F.col(label).alias("label"), F.posexplode(features).alias("dim", "x"))
               .groupBy("label", "dim")
               .agg(F.sum(F.col("x").cast("double")).alias("s"), F.count(F.lit(1)).alias("n_k")))
    per_dim = Window.partitionBy("dim")
    total = F.sum("s").over(per_dim)
    n_all = F.sum("n_k").over(per_dim).cast("double")
    k = F.count(F.lit(1)).over(per_dim).cast("double")
    return cells.select(
        "label", "dim",
        (total / (k * n_all) - F.col("s") / n_all).alias("grad"),
        F.log(k).alias("loss"),
    )


def class_centroids(df: DataFrame, features: str = "embedding", label: str = "label",
                    digits: int = 6) -> DataFrame:
    """Mean vector per class, one row per (label, dim), rounded to ``digits``."""
    return (df.where(F.col(label).isNotNull())
              .select(F.col(label).alias("label"), F.posexplode(features).alias("dim", "x"))
              .groupBy("label", "dim")
              .agg(F.round(F.avg(F.col("x").cast("double")), digits).alias("w")))


def collect_weights(weights: DataFrame, max_values: int = MAX_MODEL_BYTES // 8):
    """Long-form (label, dim, w) -> ((K, d + 1) matrix with zero bias, label ids).

    Only classes that have weights become rows. The collect is bounded: classes
    times width, and cells, are counted first, and more than ``max_values`` are refused.
    """
    size = weights.agg(F.countDistinct("label").alias("k"), F.max("dim").alias("d")).first()
    if size["k"] * ((size["d"] or 0) + 1) > max_values or weights.count() > max_values:
        raise ValueError("head weights exceed the broadcast bound")
    pdf = weights.toPandas()
    classes = np.sort(pdf["label"].unique())
    dim = int(pdf["dim"].max()) + 1 if len(pdf) else 0
    W = np.zeros((len(classes), dim + 1))
    W[np.searchsorted(classes, pdf["label"].to_numpy()), pdf["dim"].to_numpy()] = pdf["w"].to_numpy()
    return W, classes


def linear_predict(df: DataFrame, W: np.ndarray, classes: np.ndarray | None = None,
                   features: str = "embedding", label: str = "label", key: str = "vec_id") -> DataFrame:
    """C4: argmax of ``W x + b`` per row; ties to the lowest label."""
    return score_heads(df, W[None, :, :], features, label, key, classes).drop("config_id")


# ---------------------------------------------------------- C7, C8 (runs)

def param_counts(lora_runs: DataFrame, native: F.Column, backbone_params: F.Column,
                 num_classes: F.Column, rank: int = ADAPTER_RANK) -> DataFrame:
    """Trainable / total / percent for the vector adapter, plus head size."""
    trainable = (F.lit(2 * rank) * native).cast("long")
    total = (backbone_params + trainable).cast("long")
    return lora_runs.select(
        "run_id", "model_size",
        trainable.alias("trainable_params"),
        total.alias("total_params"),
        (F.lit(100.0) * trainable / total).alias("trainable_pct"),
        (num_classes * (native + 1)).cast("long").alias("head_params"),
    )


def mode_defaults(runs: DataFrame) -> DataFrame:
    """Epochs / batch size / learning rate, filled from the mode when null."""
    frozen = F.col("mode") == "frozen"

    def fill(col, key, cast):
        return F.coalesce(F.col(col), F.when(frozen, F.lit(MODE_DEFAULTS["frozen"][key]))
                          .otherwise(F.lit(MODE_DEFAULTS["lora"][key]))).cast(cast)

    return runs.select("run_id", "mode", fill("epochs", "epochs", "int").alias("epochs"),
                       fill("batch_size", "batch_size", "int").alias("batch_size"),
                       fill("lr", "lr", "double").alias("lr"))
