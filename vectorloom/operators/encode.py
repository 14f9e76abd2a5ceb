"""Encoders: the pluggable batched encoder (V1), the hashed encoder (V2),
and last-token pooling (V3).

V1 runs a user-supplied encoder inside ``mapInPandas``: the encoder is
loaded once per task, then fed Arrow batches cut into mini-batches of
``batch_size``; keys travel with the rows, so order never matters. No model
weights ship with this package: the built-in ``HashedEncoder`` is an offline
stand-in (signed feature hashing of whitespace tokens) and any callable
``list[str] -> (n, d) float32`` can take its place.

V2 is the same hashed encoder split between JVM and Python: the JVM
tokenises and hashes (``transform`` + ``md5``), Python only scatters integer
codes into a dense matrix with numpy. No shuffle at all: one pass over the
documents.
"""

from __future__ import annotations

import hashlib
import logging
import re
import time
from dataclasses import dataclass
from typing import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.functions.text import hashed_token_codes, truncate_tokens, whitespace_tokens
from vectorloom.functions.vector import NORM_EPS
from vectorloom.operators.metrics import PeakWatch

log = logging.getLogger("vectorloom.encode")

# Most distinct tokens one encoder task remembers the hash code of.
CODE_CACHE_MAX = 1_000_000
# Rows and token codes that the scatter works on at once, whatever the Arrow batch holds.
SCATTER_ROWS, SCATTER_CODES = 1024, 1 << 18

# Java's ``\s``: space, tab, newline, vertical tab, form feed, carriage return.
_WS = re.compile(r"[ \t\n\x0b\f\r]+")


@dataclass(frozen=True)
class HashedEncoder:
    """Signed feature hashing of whitespace tokens into ``dimension`` buckets.

    Matches ``encode_hashed`` (V2) exactly. ``max_length`` reproduces the
    model's token budget; ``None`` encodes the whole text. ``refuse`` makes a
    text beyond ``max_length`` an error of the whole batch instead of cutting it.
    """

    dimension: int = 64
    max_length: int | None = None
    name: str = "hashed"
    refuse: bool = False

    @property
    def native_dim(self) -> int:
        return self.dimension

    def load(self) -> Callable[[list], np.ndarray]:
        d = int(self.dimension)
        limit, refuse = self.max_length, self.refuse
        # Token -> signed code (sign * (bucket + 1)), kept for the life of the
        # task: words repeat, so most tokens skip the digest. Bounded, so a
        # task over an open vocabulary never grows it past CODE_CACHE_MAX.
        cache: dict[str, int] = {}

        def code_of(tok: str) -> int:
            h = hashlib.md5(tok.encode("utf-8")).hexdigest()
            c = (int(h[:8], 16) % d + 1) * (1 if int(h[8], 16) < 8 else -1)
            if len(cache) < CODE_CACHE_MAX:
                cache[tok] = c
            return c

        def encode(texts: list) -> np.ndarray:
            rows: list[int] = []
            codes: list[int] = []
            for i, text in enumerate(texts):
                if text is None:
                    continue
                tokens = _WS.split(text.strip(" "))
                if limit is not None and len(tokens) > limit:
                    if refuse:
                        raise ValueError(f"{len(tokens)} tokens exceed {limit}")
                    tokens = tokens[:limit]
                codes.extend([cache.get(t) or code_of(t) for t in tokens])
                rows.extend([i] * len(tokens))
            c = np.asarray(codes, dtype=np.int64)
            flat = np.asarray(rows, dtype=np.int64) * d + (np.abs(c) - 1)
            out = np.bincount(flat, weights=np.sign(c), minlength=len(texts) * d)
            return out.reshape(len(texts), d).astype(np.float32)

        return encode


def _postprocess(mat: np.ndarray, native: int, dimension: int | None, normalize: bool) -> np.ndarray:
    mat = mat.astype(np.float32, copy=False)
    if dimension is not None:
        mat = mat[:, :dimension]
    if normalize:
        norms = np.sqrt((mat.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
        mat = (mat.astype(np.float64) / np.maximum(norms, NORM_EPS)).astype(np.float32)
    return mat


def encode_apart(model, texts: list, native: int) -> tuple[np.ndarray, list]:
    """(matrix, error per text or None): a batch that fails is halved until the texts that fail stand alone.

    ``k`` bad texts in a batch of ``b`` cost at most about ``2 k log2(b)`` calls; a batch without any, one.
    Vectors of the good texts are what the encoder gives for the part they were encoded in.
    """
    try:
        return np.asarray(model(texts), dtype=np.float32).reshape(len(texts), native), [None] * len(texts)
    except Exception as exc:  # any failure of the encoder belongs to some text of this part
        if len(texts) == 1:
            return np.full((1, native), np.nan, dtype=np.float32), [f"{type(exc).__name__}: {exc}"]
    half = len(texts) // 2
    parts = [encode_apart(model, part, native) for part in (texts[:half], texts[half:])]
    return np.concatenate([m for m, _ in parts]), [e for _, errors in parts for e in errors]


def resolve_dimension(dimension: int | None, native: int) -> int | None:
    """``None`` -> native; wider than native -> native (with a warning)."""
    if dimension is None:
        return None
    if dimension < 1:
        raise ValueError(f"dimension must be >= 1, got {dimension}")
    if dimension > native:
        log.warning("requested dimension %d exceeds native width %d; using native", dimension, native)
        return None
    return dimension


def _full_batches(batches, size: int):
    """Regroup Arrow batches so that each holds a multiple of ``size`` rows, except the last."""
    import pyarrow as pa
    held = None
    for rb in batches:
        if held is not None:
            rb = pa.Table.from_batches([held, rb]).combine_chunks().to_batches()[0]
        cut = rb.num_rows - rb.num_rows % size
        if cut:
            yield rb.slice(0, cut)
        held = rb.slice(cut) if cut < rb.num_rows else None
    if held is not None:
        yield held


def _dealt(df: DataFrame, key: str, num_partitions: int | None) -> DataFrame:
    """``num_partitions`` partitions by key where the caller asks for them, else as scanned."""
    return df if num_partitions is None else df.repartition(int(num_partitions), key)


def encode(df: DataFrame, encoder, text_col: str = "text", key: str = "doc_id",
           batch_size: int = 16, dimension: int | None = None, normalize: bool = False,
           out: str = "embedding", carry: list[str] | None = None, max_length: int | None = None,
           num_partitions: int | None = None, peak=None, isolate: bool = False) -> DataFrame:
    """V1: batched encode; returns (key, embedding array<float>, *carry).

    ``carry`` columns (the text itself, a label) pass through the Arrow
    batches untouched, so nothing has to be joined back after encoding. The
    key keeps its type. Only a task's last mini-batch may be short.
    ``max_length`` cuts texts to that many whitespace tokens before any encoder
    sees them. ``num_partitions`` deals the rows out anew (a narrow scan);
    without it there is no shuffle. ``peak`` (``metrics.peak_accumulator``)
    receives the tasks' memory growth during this pass. ``isolate`` (R12): a
    batch the encoder fails on is halved until the bad rows stand alone; they get a
    null vector, the others theirs, and every row ``status`` and ``error``. Without it
    the encoder's error fails the job.
    Empty input gives an empty frame (the reference fails on it).
    """
    if batch_size < 1:
        raise ValueError("batch_size must be >= 1")
    dim = resolve_dimension(dimension, encoder.native_dim)
    native = encoder.native_dim
    carry = list(carry or [])
    extra_schema = "".join(f", {c} {df.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches):
        import pyarrow as pa
        with PeakWatch(peak is not None) as watch:
            model = encoder.load()  # once per task, then reused for every batch
            for rb in _full_batches(batches, batch_size):
                texts = rb.column(1).to_pylist()
                errors: list = []
                if isolate:
                    apart = [encode_apart(model, texts[s:s + batch_size], native) for s in range(0, len(texts), batch_size)]
                    parts, errors = [m for m, _ in apart], [e for _, own in apart for e in own]
                else:
                    parts = [model(texts[s:s + batch_size]) for s in range(0, len(texts), batch_size)]
                if not parts:
                    continue
                mat = np.ascontiguousarray(_postprocess(np.concatenate(parts, axis=0), native, dim, normalize))
                if peak is not None:
                    peak.add(watch.lap())
                n, d = mat.shape
                # the matrix becomes the list column directly: no per-row objects
                bad = np.array([e is not None for e in errors] if isolate else [False] * n)
                offsets = pa.array(np.r_[0, np.cumsum(np.where(bad, 0, d))].astype(np.int64))
                vec = pa.LargeListArray.from_arrays(offsets, pa.array(mat[~bad].ravel(), type=pa.float32()),
                                                    mask=pa.array(bad) if bad.any() else None)
                passed = [rb.column(2 + i) for i in range(len(carry))]
                if isolate:
                    passed += [pa.array(np.where(bad, "failed", "success"), type=pa.string()), pa.array(errors, type=pa.string())]
                yield pa.RecordBatch.from_arrays([rb.column(0), vec.cast(pa.list_(pa.float32())), *passed], names=names)

    names = [key, out, *carry, *(("status", "error") if isolate else ())]
    if isolate:
        if {"status", "error"} & {key, out, *carry}:
            raise ValueError("status and error name the outcome here; rename the columns carried")
        extra_schema += ", status string, error string"
    staged = _dealt(df.select(key, _cut(text_col, max_length).alias("_vl_text"), *carry), key, num_partitions)
    key_type = df.schema[key].dataType.simpleString()
    return staged.mapInArrow(run, f"{key} {key_type}, {out} array<float>{extra_schema}")


def _cut(text_col: str, max_length: int | None):
    """The text, or its first ``max_length`` whitespace tokens joined by spaces."""
    if max_length is None:
        return F.col(text_col)
    return F.array_join(truncate_tokens(whitespace_tokens(text_col), max_length), " ")


def encode_telemetry(df: DataFrame, encoder, text_col: str = "text", key: str = "doc_id",
                     batch_size: int = 16, dimension: int | None = None,
                     normalize: bool = False, num_partitions: int | None = None) -> DataFrame:
    """One row per mini-batch encoded: task, batch number, rows, nanoseconds, peak memory growth in bytes, and when it
    ended (microseconds, this machine's clock).

    The clocks and memory readings are real and therefore not deterministic.
    """
    dim = resolve_dimension(dimension, encoder.native_dim)
    native = encoder.native_dim

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        ctx = TaskContext.get()
        task = ctx.partitionId() if ctx is not None else -1
        with PeakWatch() as watch:
            model = encoder.load()
            batch_no = 0
            for rb in _full_batches(batches, batch_size):
                texts = rb.column(0).to_pylist()
                rows = []
                for s in range(0, len(texts), batch_size):
                    t0 = time.perf_counter_ns()
                    _postprocess(model(texts[s:s + batch_size]), native, dim, normalize)
                    ns = time.perf_counter_ns() - t0
                    rows.append((task, batch_no, len(texts[s:s + batch_size]), ns, watch.lap(),
                                 time.time_ns() // 1000))
                    batch_no += 1
                if rows:
                    cols = [pa.array(c, type=pa.int32() if i == 0 else pa.int64()) for i, c in enumerate(zip(*rows))]
                    yield pa.RecordBatch.from_arrays(cols, names=["task_id", "batch_no", "rows", "elapsed_ns",
                                                                  "rss_growth", "ended_at"])

    schema = "task_id int, batch_no long, rows long, elapsed_ns long, rss_growth long, ended_at long"
    return _dealt(df.select(text_col, key), key, num_partitions).select(text_col).mapInArrow(run, schema)


def signed_counts(lists, d: int) -> np.ndarray:
    """Per list of signed codes (null: none) its ``d`` bucket sums, flat, SCATTER_CODES codes at a time."""
    import pyarrow.compute as pc
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, codes = np.cumsum(sizes), pc.list_flatten(lists).to_numpy(zero_copy_only=False)
    out = np.zeros(len(sizes) * d)
    for a in range(0, len(codes), SCATTER_CODES):
        vals = codes[a:a + SCATTER_CODES].astype(np.int64)
        low, high = np.searchsorted(ends, [a, a + len(vals) - 1], "right")
        held = np.minimum(ends[low:high + 1], a + len(vals)) - np.maximum(ends[low:high + 1] - sizes[low:high + 1], a)
        at = np.repeat(np.arange(high - low + 1) * d, held) + np.abs(vals) - 1
        out[low * d:(high + 1) * d] += np.bincount(at, weights=np.sign(vals), minlength=(high - low + 1) * d)
    return out.astype(np.float32)


def encode_hashed(df: DataFrame, dimension: int = 64, text_col: str = "text", key: str = "doc_id",
                  max_length: int | None = None, out: str = "embedding",
                  carry: list[str] | None = None, num_partitions: int | None = None,
                  peak=None) -> DataFrame:
    """V2: hashed encoding with the hashing in the JVM and a numpy scatter.

    Unnormalised counts (float32): value at bucket b = (+1 tokens) - (-1 tokens).
    ``carry`` columns pass through untouched (e.g. split and label), so a
    labelled corpus is encoded in the same pass, with no join afterwards.
    The key keeps its type; ``num_partitions`` and ``peak`` as in ``encode``.
    """
    d = int(dimension)
    carry = list(carry or [])
    codes = hashed_token_codes(truncate_tokens(whitespace_tokens(text_col), max_length), d)
    narrow = _dealt(df.select(key, text_col, *carry), key, num_partitions)
    staged = narrow.select(key, codes.alias("_codes"), *carry)
    extra_schema = "".join(f", {c} {df.schema[c].dataType.simpleString()}" for c in carry)

    def scatter(batches):
        import pyarrow as pa
        with PeakWatch(peak is not None) as watch:
            for rb in batches:
                for start in range(0, rb.num_rows, SCATTER_ROWS):
                    part = rb.slice(start, SCATTER_ROWS)
                    dense = signed_counts(part.column(1), d)
                    if peak is not None:
                        peak.add(watch.lap())
                    offsets = pa.array(np.arange(0, len(dense) + 1, d, dtype=np.int32))
                    vec = pa.ListArray.from_arrays(offsets, pa.array(dense, type=pa.float32()))
                    passed = [part.column(2 + i) for i in range(len(carry))]
                    yield pa.RecordBatch.from_arrays([part.column(0), vec, *passed], names=[key, out, *carry])

    return staged.mapInArrow(scatter, f"{key} {df.schema[key].dataType.simpleString()}, {out} array<float>{extra_schema}")


def last_token_pool(df: DataFrame, seq_col: str, pos_col: str, mask_col: str, hidden_col: str,
                    out: str = "pooled") -> DataFrame:
    """V3: the hidden state at the last position whose mask is 1, per sequence.

    Right for left- and right-padded batches alike. Deviations: a batch that
    mixes both paddings still gets the right position, and an all-zero mask
    gives null (the reference wraps to the last position).
    """
    live_pos = F.when(F.col(mask_col) == 1, F.col(pos_col))
    return df.groupBy(seq_col).agg(
        F.max_by(F.col(hidden_col), live_pos).alias(out),
        F.max(live_pos).alias("pooled_position"),
    )
