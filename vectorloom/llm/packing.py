"""Packing along a space-filling curve: neighbouring documents share sequences.

1. Each text becomes token ids and a hashed count vector (ids modulo
   ``HASHED``), which a fixed random matrix projects to ``AXES`` coordinates;
   their Hilbert index is the document's key.
2. The tokenised rows are written once under the checkpoint folder (the range
   sort samples its input, and a lost executor must not tokenise again), then
   range-sorted by key, id and row number.
3. Every range partition is one stretch of the curve. Its ids are laid end to
   end and cut every 4,096; the rest of the stretch is cut into powers of two, which
   need no padding.

Defined results: null, empty and white-space texts are the end id alone, with
key 0; equal texts have equal keys; repeated rows are packed as often as they
occur; null doc_ids are carried; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import functools
import zlib
from typing import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.common import few, map_rows, materialize, scan_tasks
from vectorloom.llm.tokens import SEQUENCE, chunk_ids

#: The id that ends a document.
END = 2
HASHED, AXES, BITS = 512, 3, 10


@functools.lru_cache(1)
def _projection() -> np.ndarray:
    return np.random.default_rng(99).normal(0, 1, (HASHED, AXES))


def hilbert_index(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position of integer points (n, axes), each below 2^bits, on the Hilbert curve."""
    x = points.astype(np.int64).T.copy()
    axes = len(x)
    for level in range(bits - 1, 0, -1):
        q = 1 << level
        for i in range(axes):
            set_here = (x[i] & q) != 0
            swap = np.where(set_here, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(set_here, x[0] ^ (q - 1), x[0] ^ swap)
            if i:
                x[i] ^= swap
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[axes - 1] & (1 << level)) != 0, (1 << level) - 1, 0)
    x ^= flip
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(axes):
            out = (out << 1) | ((x[i] >> level) & 1)
    return out


def curve_keys(documents: list[np.ndarray]) -> np.ndarray:
    """Hilbert keys of token-id arrays; 0 for a document without tokens."""
    coordinates = np.zeros((len(documents), AXES))
    empty = np.zeros(len(documents), dtype=bool)
    for i, ids in enumerate(documents):
        empty[i] = not len(ids)
        counts = np.sqrt(np.bincount(ids % HASHED, minlength=HASHED))
        coordinates[i] = counts @ _projection() / max(np.sqrt(len(ids)), 1.0)
    grid = np.clip((0.5 + 0.25 * coordinates) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
    return np.where(empty, 0, hilbert_index(grid))


def curve_rows(docs: DataFrame, path: str | None = None) -> DataFrame:
    """key, doc_id, ids (uint16 bytes, end id included) per document."""
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        cache, end = chunk_ids(path), np.array([END], dtype="<u2").tobytes()
        for b in batches:
            ids = [cache.text_ids(t) for t in b["text"].to_pylist()]
            keys = curve_keys([np.frombuffer(i, dtype="<u2") for i in ids])
            yield {"key": keys, "doc_id": b["doc_id"], "ids": [i + end for i in ids]}

    return map_rows(docs.select("doc_id", "text"), run, "key long, doc_id long, ids binary")


def cut_sizes(rest: int) -> list[int]:
    """The powers of two that sum to ``rest``, largest first."""
    return [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _cut(batches: Iterator[dict]) -> Iterator[dict]:
    """Lay the documents end to end and cut; pieces of the open sequence wait for its end."""
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    number = TaskContext.get().partitionId() << 32
    waiting: list[tuple] = []   # (doc_id, start, ids, doc_tokens) of the open sequence, below SEQUENCE ids
    held = 0

    def rows(pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc_id, start, ids, total in pieces:
            yield doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, number, offset
            offset += len(ids)

    for b in batches:
        done: list[tuple] = []
        for doc_id, raw in zip(b["doc_id"].to_pylist(), b["ids"].to_pylist()):
            ids, start = np.frombuffer(raw, dtype="<u2"), 0
            while start < len(ids):
                n = min(SEQUENCE - held, len(ids) - start)
                waiting.append((doc_id, start, ids[start:start + n], len(ids)))
                start, held = start + n, held + n
                if held == SEQUENCE:
                    done.extend(rows(waiting))
                    waiting, held, number = [], 0, number + 1
        if done:
            yield dict(zip(names, map(list, zip(*done))))
    done = []
    for size in cut_sizes(held):
        taken, room = [], size
        while room:
            doc_id, start, ids, total = waiting.pop(0)
            if len(ids) > room:
                waiting.insert(0, (doc_id, start + room, ids[room:], total))
                ids = ids[:room]
            taken.append((doc_id, start, ids, total))
            room -= len(ids)
        done.extend(rows(taken))
        number += 1
    if done:
        yield dict(zip(names, map(list, zip(*done))))


def pack_along_curve(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = materialize(curve_rows(docs, path), "curve")
    # The row number splits repeated rows over ranges; it is a function of the written table.
    sort = ["key", "doc_id", "row"]
    ordered = (rows.withColumn("row", F.monotonically_increasing_id())
               .repartitionByRange(scan_tasks(docs.sparkSession), *sort).sortWithinPartitions(*sort))
    cut = map_rows(ordered.select("doc_id", "ids"), _cut,
                   "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return few(cut, rows.count())
