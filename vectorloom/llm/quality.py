"""Quality classifier: random-indexing word vectors, pooled, into a two-layer network.

Words (and their shapes: case, digits, punctuation runs) fall into ``BUCKETS``
hashed buckets. Each bucket owns a fixed sparse ternary index vector; its word
vector is the sum of the index vectors seen within ``WINDOW`` words of it in
the fit sample. A document is the mean of its word vectors, the mean of its
index vectors (a repeated word keeps that mean long), and three counts. A
tanh layer and a sigmoid unit, trained with Adam in numpy, give a logit whose
temperature is calibrated on rows the training did not see.

Fitted on at most ``MAX_FIT_ROWS`` labelled rows (whole texts), chosen by a
hash of their id among rows whose ``crc32(id) mod 5`` is not 0. That is the only sample:
every document is scored, over its whole text. The model has a fixed size
(``BUCKETS x DIM`` floats), so broadcasting it does not grow with the corpus.

Defined results: null, empty and white-space texts have zero vectors and get
the network's score for them; rows with equal texts get equal scores; without labels of both classes
every score is the smoothed share of label 1 (0.5 if there are none); labels
other than 0 and 1, and labels without a document, are ignored, several labels
of one id count as their smallest; a null doc_id counts as held out; extra
columns are ignored by the score and kept by the filter; an empty table gives
an empty result.
"""

from __future__ import annotations

import functools
import re
import zlib
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.common import map_rows, small_batches

BUCKETS = 1 << 14
DIM = 48
NONZERO = 6
WINDOW = 2
HIDDEN = 24
EPOCHS = 400
LEARNING_RATE = 0.02
WEIGHT_DECAY = 1e-3
#: Bound of the labelled sample the model is fitted on; its texts reach the driver as bucket ids.
MAX_FIT_ROWS = 3000
#: Rows with a score from here on are predicted 1.
THRESHOLD = 0.3
#: Bound of a worker's word cache; a full cache is dropped, results do not depend on it.
CACHE_WORDS = 200_000

_SHAPES = [(re.compile(r"[^\W\d_]*[a-zß-öø-ÿ][^\W\d_]*"), "a"), (re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"),
           (re.compile(r"\d+"), "9")]


def _shape(word: str) -> str:
    """The word with letters, capitals and digits reduced to one sign each."""
    for pattern, sign in _SHAPES:
        word = pattern.sub(sign, word)
    return word[:8]


class _Words(dict):
    """word -> two little-endian int32 bucket ids (the word, its shape)."""

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        core = zlib.crc32(word.lower().encode("utf-8", "replace")) % (BUCKETS - 1024)
        shape = BUCKETS - 1024 + zlib.crc32(_shape(word).encode("utf-8", "replace")) % 1024
        value = self[word] = np.array([core, shape], dtype="<i4").tobytes()
        return value


_WORDS = _Words()


def word_ids(text: str) -> np.ndarray:
    """(n_words, 2) bucket ids of the whole text."""
    return np.frombuffer(b"".join(map(_WORDS.__getitem__, text.split())), dtype="<i4").reshape(-1, 2)


@functools.lru_cache(1)
def index_vectors() -> np.ndarray:
    rng = np.random.default_rng(20240901)
    out = np.zeros((BUCKETS, DIM), dtype=np.float32)
    for _ in range(NONZERO):
        out[np.arange(BUCKETS), rng.integers(0, DIM, BUCKETS)] += rng.choice((-1.0, 1.0), BUCKETS)
    return out / np.sqrt(NONZERO)


def word_vectors(sequences: list[np.ndarray], index: np.ndarray) -> np.ndarray:
    """Sum of the index vectors of each bucket's neighbours, one row per bucket, unit length."""
    out = np.zeros((BUCKETS, DIM), dtype=np.float64)
    for ids in sequences:
        core = ids[:, 0]
        around = np.zeros((len(core), DIM), dtype=np.float32)
        own = index[core] + index[ids[:, 1]]
        for step in range(1, WINDOW + 1):
            if len(core) > step:
                around[step:] += own[:-step]
                around[:-step] += own[step:]
        for column in (0, 1):
            order = np.argsort(ids[:, column], kind="stable")
            keys = ids[order, column]
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)
            if len(starts):
                out[keys[starts]] += np.add.reduceat(around[order], starts, axis=0)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.maximum(norm, 1e-9)).astype(np.float32)


def pooled(ids: np.ndarray, vectors: np.ndarray, index: np.ndarray) -> np.ndarray:
    """A document's features; zeros for a text without words."""
    out = np.zeros(4 * DIM + 3, dtype=np.float32)
    n = len(ids)
    if n:
        distinct = 0
        for column in (0, 1):
            used, counts = np.unique(ids[:, column], return_counts=True)
            weight = (counts / n).astype(np.float32)
            out[column * 2 * DIM:(column * 2 + 1) * DIM] = weight @ vectors[used]
            out[(column * 2 + 1) * DIM:(column * 2 + 2) * DIM] = weight @ index[used]
            distinct = distinct or len(used)
        out[-3:] = np.log1p(n) / 8, distinct / n, np.sqrt(np.sum(out[DIM:2 * DIM] ** 2))
    return out


class Network:
    """Standardised features -> tanh layer -> logit / temperature."""

    def __init__(self, prior: float):
        self.prior, self.layers = prior, None

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Network":
        if len(y) < 10 or y.min() == y.max():
            return self
        held = np.zeros(len(y), dtype=bool)
        for label in (0, 1):   # a fifth of each class calibrates the temperature
            held[np.flatnonzero(y == label)[::5]] = True
        self.mean, self.scale = x[~held].mean(0), x[~held].std(0) + 1e-3
        z, t = (x[~held] - self.mean) / self.scale, y[~held].astype(np.float64)
        weight = np.where(t == 1, 0.5 / max(t.mean(), 1e-9), 0.5 / max(1 - t.mean(), 1e-9))
        rng = np.random.default_rng(7)
        params = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN),
                  rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, EPOCHS + 1):
            h = np.tanh(z @ params[0] + params[1])
            d = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -30, 30))) - t) * weight / len(t)
            back = np.outer(d, params[2]) * (1 - h * h)
            grads = [z.T @ back, back.sum(0), h.T @ d, np.array([d.sum()])]
            for i, g in enumerate(grads):
                g = g + WEIGHT_DECAY * params[i] * (params[i].ndim == 2 or i == 2)
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                params[i] = params[i] - LEARNING_RATE * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)
        self.layers, self.temperature = params, 1.0
        logit, target = self.logit(x[held]), y[held]
        grid = np.geomspace(0.25, 8, 41)
        self.temperature = float(grid[np.argmin([np.mean(np.logaddexp(0, np.where(target == 1, -logit, logit) / g)) for g in grid])])
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh((x - self.mean) / self.scale @ self.layers[0] + self.layers[1])
        return h @ self.layers[2] + self.layers[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -500, 500)))


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, Network]:
    """Word vectors and network from the bounded labelled sample."""
    spark = docs.sparkSession
    small_batches(docs)
    known = (labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
             .groupBy("doc_id").agg(F.min("quality").alias("quality")))
    # A hash of the id orders the rows; the sample is the first MAX_FIT_ROWS of that order.
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_FIT_ROWS).collect()
    quality = {r["doc_id"]: r["quality"] for r in chosen}

    def ids_of(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            ids = b["doc_id"].to_pylist()
            yield {"doc_id": ids, "ids": [word_ids(t or "").tobytes() for t in b["text"].to_pylist()]}

    wanted = spark.createDataFrame([(k,) for k in quality], "doc_id long")   # at most MAX_FIT_ROWS rows
    rows = (docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id", "left_semi")
            .groupBy("doc_id").agg(F.min("text").alias("text")))
    seqs = sorted((r["doc_id"], np.frombuffer(r["ids"], dtype="<i4").reshape(-1, 2))
                  for r in map_rows(rows, ids_of, "doc_id long, ids binary").collect())
    index = index_vectors()
    vectors = word_vectors([s for _, s in seqs], index)
    y = np.array([quality[k] for k, _ in seqs], dtype=np.int64)
    x = np.array([pooled(s, vectors, index) for _, s in seqs], dtype=np.float64).reshape(len(seqs), 4 * DIM + 3)
    return vectors, Network((y.sum() + 1) / (len(y) + 2)).fit(x, y)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        vectors, network = model.value
        index = index_vectors()
        for b in batches:
            x = np.array([pooled(word_ids(t or ""), vectors, index) for t in b["text"].to_pylist()], dtype=np.float64)
            s = network.score(x)
            yield {"doc_id": b["doc_id"], "held_out": b["held_out"], "score": s,
                   "predicted": (s >= THRESHOLD).astype(np.int32)}

    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return map_rows(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` predicted 1, all columns kept."""
    small_batches(docs)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    @F.pandas_udf("boolean")
    def good(text: pd.Series) -> pd.Series:
        vectors, network = model.value
        index = index_vectors()
        x = np.array([pooled(word_ids(t or ""), vectors, index) for t in text], dtype=np.float64).reshape(len(text), 4 * DIM + 3)
        return pd.Series(network.score(x) >= THRESHOLD)

    return docs.filter(good("text"))
