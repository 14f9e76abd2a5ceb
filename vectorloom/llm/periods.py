"""Periodic runs of words: string synchronising sets propose periods, exact comparison settles them.

A run is a stretch of consecutive words with smallest period q, of at least ``max(MIN_LENGTH, 2 q)``
words, that no neighbouring word extends. A document is a sequence of 64-bit word codes; the
documents of a block are laid end to end with codes between them that occur once, so no run crosses
one, and the longest lie first, so that every scale works on a shrinking prefix.

1. Periods up to ``DIRECT`` are read off directly: stretches in which every word equals the one
   q further on. These are the highly periodic regions of the lowest scales.
2. Scale t = 4, 8, 16, ... answers for the periods from 3t - 1 to 6t - 2. Every window of t words has a
   hash, doubled from the scale below. Position i is *selected* if the smallest hash of the windows
   i .. i+t stands at i or at i+t, windows of period t/3 or less left out: equal contexts of 2t
   words select alike wherever they stand.
3. Two selected positions with equal contexts and a distance that the scale answers for propose that
   distance as a period; neighbouring proposals of one period that overlap are one. They are extended to
   both sides on the words themselves, never on hashes, and kept if two periods fit.
4. A run without such a pair has one highly periodic period: a run of period t/3 or less holds its first period, a
   second run of the same words all the rest, and the two touch. These regions are known from lower scales; each
   pair of touching ones supplies its periods, with both ends read off the regions' ends.
5. Of all rows for one stretch the smallest period stays.

Documents are independent: no shuffle, and a task holds one block of at most ``BLOCK_WORDS`` words (or one document).

Defined results: null, empty and white-space texts have no words and no run; words are compared as bytes;
repeated rows and null doc_ids are carried; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.common import map_rows, text_bytes

#: Fewest words of a run.
MIN_LENGTH = 12
#: Largest period that is read off directly; scale 4 goes on from there.
DIRECT = 10
BLOCK_WORDS = 1 << 18

_U = np.uint64
_NONE = _U(0xFFFFFFFFFFFFFFFF)
_EMPTY = np.zeros((0, 3), dtype=np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _doubled(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the windows twice as wide."""
    n = len(h) - width
    return _mix(h[:n] * _U(0x9E3779B97F4A7C15) + (h[width:] ^ (h[width:] >> _U(32)))) if n > 0 else h[:0]


def _stretches(yes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 of every maximal stretch of True."""
    at = np.flatnonzero(yes)
    if not len(at):
        return at, at
    breaks = np.flatnonzero(np.diff(at) > 1)
    return at[np.r_[0, breaks + 1]], at[np.r_[breaks, len(at) - 1]] + 1


def _direct(codes: np.ndarray) -> np.ndarray:
    """(start, length, period) of all stretches with a period up to DIRECT that fits twice."""
    found = [_EMPTY]
    for q in range(1, DIRECT + 1):
        a, b = _stretches(codes[q:] == codes[:-q]) if len(codes) > q else (np.zeros(0, dtype=np.int64),) * 2
        fits = b - a >= q
        found.append(np.stack([a[fits], b[fits] - a[fits] + q, np.full(fits.sum(), q)], axis=1))
    return np.concatenate(found)


def _selected(h: np.ndarray, t: int, runs: np.ndarray) -> np.ndarray:
    """Selected positions at scale t; ``h``: hashes of the windows of t words, ``runs``: all of period t/3 or less."""
    usable = h.copy()
    regular = runs[(runs[:, 2] <= t // 3) & (runs[:, 1] >= t)]
    if len(regular):
        change = np.zeros(len(h) + 1, dtype=np.int32)
        np.add.at(change, np.minimum(regular[:, 0], len(h)), 1)
        np.add.at(change, np.minimum(regular[:, 0] + regular[:, 1] - t + 1, len(h)), -1)
        usable[np.cumsum(change[:-1]) > 0] = _NONE
    low, width = usable, 1
    while width < t:                      # smallest of `width` windows, doubled
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    n = len(h) - t
    low = np.minimum(low[:n], usable[t:])
    return np.flatnonzero((low != _NONE) & ((usable[:n] == low) | (usable[t:] == low)))


def _proposals(at: np.ndarray, context: np.ndarray, t: int) -> np.ndarray:
    """(first, last, period) of equal contexts at a distance that scale t answers for; overlapping ones are one."""
    order = np.lexsort((at, context[at]))
    pos, ctx = at[order], context[at][order]
    found, step = [], 1
    alive = np.arange(len(pos))
    while len(alive := alive[alive + step < len(pos)]):
        distance = pos[alive + step] - pos[alive]
        near = (ctx[alive + step] == ctx[alive]) & (distance <= 6 * t - 2)
        alive, distance = alive[near], distance[near]
        far = distance >= 3 * t - 1
        found.append(np.stack([distance[far], pos[alive[far]]], axis=1))
        step += 1
    if not found:
        return _EMPTY
    pairs = np.concatenate(found)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    if not len(pairs):
        return _EMPTY
    new = np.r_[True, (np.diff(pairs[:, 0]) != 0) | (np.diff(pairs[:, 1]) > 2 * t)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:] - 1, len(pairs) - 1]
    return np.stack([pairs[first, 1], pairs[last, 1] + 2 * t, pairs[first, 0]], axis=1)


def _reach(codes: np.ndarray, at: np.ndarray, period: np.ndarray, sign: int) -> np.ndarray:
    """How many words from ``at`` on (sign 1), or before it (-1), equal the word one period further on."""
    n, out, alive, width = len(codes), np.zeros(len(at), dtype=np.int64), np.arange(len(at)), 8
    while len(alive):
        begin = at[alive] + (out[alive] if sign > 0 else -out[alive] - 1)
        x = begin[:, None] + sign * np.arange(width)
        y = x + period[alive, None]
        inside = (x >= 0) & (y < n)
        same = inside & (codes[np.where(inside, x, 0)] == codes[np.where(inside, y, 0)])
        whole = same.all(axis=1)
        out[alive] += np.where(whole, width, np.argmin(same, axis=1))
        alive = alive[whole]
        width = int(min(2 * width, max(8, (1 << 20) // max(len(alive), 1))))
    return out


def _touching(codes: np.ndarray, runs: np.ndarray, t: int) -> np.ndarray:
    """Runs with a period that scale t answers for, across two touching runs of one small period and the same words."""
    long = runs[(runs[:, 2] <= t // 3) & (runs[:, 1] >= 3 * t - 1)]
    long = long[np.lexsort((long[:, 0], long[:, 2]))]
    a, b = long[:-1], long[1:]
    beside = (a[:, 2] == b[:, 2]) & (b[:, 0] <= a[:, 0] + a[:, 1])
    periods, ends = [], []
    for (sa, na, q), (sb, nb, _) in zip(a[beside].tolist(), b[beside].tolist()):
        root, around = codes[sa + na - q:sa + na].tobytes(), codes[sb:sb + 2 * q].tobytes()
        shift = around.find(root)
        while shift % 8 and shift > 0:
            shift = around.find(root, shift + 1)
        if shift < 0:
            continue
        phase = sb + shift // 8 - (sa + na - q)
        least = 3 * t - 1
        p = np.arange(least + (phase - least) % q, min(na, nb, 6 * t - 2) + 1, q)
        periods.append(p)
        ends.append(np.tile([sa, sa + na, sb, sb + nb], (len(p), 1)))
    if not periods:
        return _EMPTY
    p, (sa, ea, sb, eb) = np.concatenate(periods), np.concatenate(ends).T
    left, right = np.maximum(sa, sb - p), np.minimum(ea, eb - p)
    # Where only one region ends its words differ from the other's; where both end, the words decide.
    tie = sa == sb - p
    left[tie] -= _reach(codes, left[tie], p[tie], -1)
    tie = ea == eb - p
    right[tie] += _reach(codes, right[tie], p[tie], 1)
    fits = right - left >= p
    return np.stack([left, right - left + p, p], axis=1)[fits]


def _minimal(runs: np.ndarray) -> np.ndarray:
    """One row per stretch, with its smallest period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    return runs[np.r_[True, (np.diff(runs[:, 0]) != 0) | (np.diff(runs[:, 1]) != 0)]] if len(runs) else runs


def repetitions(codes: np.ndarray, longest: int, prefix=lambda least: None) -> np.ndarray:
    """(start, length, period), by start, of every maximal stretch in which its smallest period fits twice.

    ``longest``: no stretch is longer; ``prefix(least)``: how many codes belong to documents of ``least`` words or more.
    """
    runs = _minimal(_direct(codes))
    h, t = _mix(codes), 1
    while t < 4:
        h, t = _doubled(h, t), 2 * t
    while 2 * (3 * t - 1) <= longest:
        n = prefix(2 * (3 * t - 1))
        codes = codes[:n]
        h = h[:max(len(codes) - t + 1, 0)]
        wide = _doubled(h, t)
        if not len(wide):
            break
        # h[t:] exists for positions up to len(wide): both ends of the choice and the context are inside.
        found = _proposals(_selected(h, t, runs), wide, t)
        known = [runs, _touching(codes, runs, t)]
        if len(found):
            left = found[:, 0] - _reach(codes, found[:, 0], found[:, 2], -1)
            right = found[:, 1] + _reach(codes, found[:, 1], found[:, 2], 1)
            fits = right - left >= found[:, 2]
            period = found[fits, 2]
            known.append(np.stack([left[fits], right[fits] - left[fits] + period, period], axis=1))
        runs = _minimal(np.concatenate(known))
        h, t = wide, 2 * t
    return runs


def word_codes(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64)


def block_runs(documents: list[np.ndarray], least: int = MIN_LENGTH) -> list[np.ndarray]:
    """The runs of every document of a block, as (start, length, period) by start and period."""
    order = sorted(range(len(documents)), key=lambda i: -len(documents[i]))
    parts, begins, at = [], [], 0
    for rank, i in enumerate(order):
        begins.append(at)
        parts += [documents[i], np.array([xxhash.xxh3_64_intdigest(b"\n%d" % rank)], dtype=np.uint64)]
        at += len(documents[i]) + 1
    if not parts:
        return []
    lengths = np.array([len(documents[i]) for i in order])
    ends = np.cumsum(lengths + 1)

    def prefix(size: int) -> int:
        k = int(np.searchsorted(-lengths, -size, "right"))
        return int(ends[k - 1]) if k else 0

    runs = repetitions(np.concatenate(parts), int(lengths[0]), prefix)
    runs = runs[runs[:, 1] >= least]
    out: list[np.ndarray] = [_EMPTY] * len(documents)
    cuts = np.searchsorted(runs[:, 0], begins)
    for i, begin, a, b in zip(order, begins, cuts, [*cuts[1:], len(runs)]):
        own = runs[a:b].copy()
        own[:, 0] -= begin
        out[i] = own[np.lexsort((own[:, 2], own[:, 0]))]
    return out


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Mask of the words that no run holds after its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and the collapsed text (kept words, one space between) per row."""
    def finish(block: list[tuple]) -> dict:
        out: dict = {"doc_id": [], "n_words": [], "runs": [], "collapsed": []}
        for (doc_id, words, _), runs in zip(block, block_runs([b[2] for b in block])):
            if len(runs):
                words = [w for w, keep in zip(words, kept_words(len(words), runs)) if keep]
            out["doc_id"].append(doc_id)
            out["n_words"].append(len(block[len(out["n_words"])][1]))
            out["runs"].append([{"start": s, "length": n, "period": q} for s, n, q in runs.tolist()])
            out["collapsed"].append(b" ".join(words))
        return out | {"runs": pa.array(out["runs"], type=_RUN)}

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        block, held = [], 0
        for b in batches:
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
                words = text.split()      # of bytes: splits at ASCII white space, as wanted
                block.append((doc_id, words, word_codes(words)))
                held += len(words) + 1
                if held >= BLOCK_WORDS:
                    yield finish(block)
                    block, held = [], 0
        if block:
            yield finish(block)

    return map_rows(docs.select("doc_id", text_bytes().alias("text")), run, RUNS)


def planted(doc_id: int | None, text: bytes) -> bytes:
    """Of every tenth document (crc32 of its id), the tail replaced by a repetition of some of its words."""
    h = zlib.crc32(str(doc_id).encode())
    words = text.split()
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return text
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return b" ".join([words[i if i < a else a + (i - a) % p] for i in range(n)])


def plant_repetitions(docs: DataFrame) -> DataFrame:
    """doc_id and text (bytes), with ``planted`` repetitions; documents with a null id are left as they are."""
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            ids = b["doc_id"].to_pylist()
            chosen = [i for i, d in enumerate(ids) if d is not None and zlib.crc32(b"%d" % d) % 10 == 0]
            mask = np.zeros(len(ids), dtype=bool)
            mask[chosen] = True
            new = pa.array([planted(ids[i], b["text"][i].as_py()) for i in chosen], type=b["text"].type)
            yield {"doc_id": b["doc_id"], "text": pc.replace_with_mask(b["text"], pa.array(mask), new).cast(pa.binary())}

    return map_rows(docs.select("doc_id", text_bytes().alias("text")), run, "doc_id long, text binary")


def run_digest(docs: DataFrame) -> DataFrame:
    """Per document with planted repetitions: its runs, the longest of them, and digests of all and of what is kept."""
    found = periodic_runs(plant_repetitions(docs))
    # Longest first, then the smallest start, then the smallest period.
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("order"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))), 1)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        F.when(F.size("runs") > 0, best).alias("best"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).select("doc_id", "n_runs", "best.start", "best.length", "best.period",
             F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
             "runs_sha256", "collapsed_sha256")
