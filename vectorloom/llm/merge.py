"""Distributed merge sort of byte strings: front-coded sorted runs, key-range buckets, LCP loser trees.

A task sorts what it has into a run and stores it in blocks of at most
``BLOCK_ENTRIES`` entries; inside a block each key is stored as the length of
the prefix it shares with the key before it and the rest. Split keys cut the
runs into buckets, a bucket gathers its part of every run, and a loser tree
merges them. The tree keeps, for every waiting key, the prefix it shares with
the last key that went out, so prefixes known to agree are never compared again.

A bucket is streamed: its blocks arrive by first key, some are held, and what lies below
the first key of the next one is merged and goes out. Of any run at most one held block
reaches beyond that key, so a task holds ``HELD_BLOCKS`` blocks and one a run,
however large its bucket is.
"""

from __future__ import annotations

import bisect
import itertools
import math
import struct
from typing import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.common import map_rows, materialize

BLOCK_ENTRIES = 256
#: Target entries of a bucket, and the most buckets (their split keys are broadcast with the task).
BUCKET_ENTRIES, MAX_BUCKETS = 16_384, 20_000
#: First keys of blocks that the driver sees per bucket when it places the split keys.
KEYS_PER_BUCKET = 16

#: Blocks of a bucket that are merged at a time, beside those that reach beyond them.
HELD_BLOCKS = 256

BLOCKS = "first_key binary, run long, seq int, n int, blob binary"
_HEAD = struct.Struct("<III")


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, given that the first ``start`` bytes agree."""
    n, i = min(len(a), len(b)), start
    while i + 32 <= n and a[i:i + 32] == b[i:i + 32]:
        i += 32
    while i < n and a[i] == b[i]:
        i += 1
    return i


def encode(entries: Iterable[tuple[bytes, bytes]]) -> bytes:
    """Front-code sorted (key, payload) pairs."""
    out, last = [], b""
    for key, payload in entries:
        shared = common_prefix(last, key)
        out += (_HEAD.pack(shared, len(key) - shared, len(payload)), key[shared:], payload)
        last = key
    return b"".join(out)


def decode(blob: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """(prefix shared with the key before, key, payload) of a block."""
    at, last = 0, b""
    while at < len(blob):
        shared, rest, size = _HEAD.unpack_from(blob, at)
        at += _HEAD.size
        last = last[:shared] + blob[at:at + rest]
        yield shared, last, blob[at + rest:at + rest + size]
        at += rest + size


def blocks(entries: list[tuple[bytes, bytes]], run: int) -> dict:
    """Column batch of the blocks of one run; sorts ``entries``."""
    entries.sort()
    out = {k: [] for k in ("first_key", "run", "seq", "n", "blob")}
    for seq, i in enumerate(range(0, len(entries), BLOCK_ENTRIES)):
        part = entries[i:i + BLOCK_ENTRIES]
        for k, v in zip(out, (part[0][0], run, seq, len(part), encode(part))):
            out[k].append(v)
    return out


class LoserTree:
    """Merges runs of (shared prefix with the key before, key, payload)."""

    def __init__(self, runs: list[Iterator[tuple[int, bytes, bytes]]]):
        self.runs, self.k = runs, max(1, len(runs))
        self.keys: list[bytes | None] = [None] * self.k
        self.load: list[bytes | None] = [None] * self.k
        self.shared = [0] * self.k     # prefix shared with the key that last went out
        self.losers = [-1] * self.k
        self.compared = 0              # bytes looked at, for the tests
        for r in range(len(runs)):
            self._advance(r)
            self.shared[r] = 0
        self.winner = self._build(1)

    def _advance(self, r: int) -> None:
        self.shared[r], self.keys[r], self.load[r] = next(self.runs[r], (-1, None, None))

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, lose = self._match(a, b)
        self.losers[node] = lose
        return win

    def _match(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's shared prefix becomes the one with the winner."""
        ka, kb = self.keys[a], self.keys[b]
        if ka is None or kb is None:
            return (a, b) if kb is None else (b, a)
        sa, sb = self.shared[a], self.shared[b]
        if sa != sb:
            return (a, b) if sa > sb else (b, a)
        m = common_prefix(ka, kb, sa)
        self.compared += m - sa + 1
        if (ka[m:m + 1], a) < (kb[m:m + 1], b):
            self.shared[b] = m
            return a, b
        self.shared[a] = m
        return b, a

    def __iter__(self) -> Iterator[tuple[int, bytes, bytes]]:
        while True:
            w = self.winner
            if self.keys[w] is None:
                return
            yield self.shared[w], self.keys[w], self.load[w]
            self._advance(w)
            node = (w + self.k) // 2
            while node >= 1:
                w, self.losers[node] = self._match(w, self.losers[node])
                node //= 2
            self.winner = w


def _chained(parts: list[bytes]) -> Iterator[tuple[int, bytes, bytes]]:
    """One run from its blocks in order; a block's first key is compared with the last of the block before."""
    last = b""
    for blob in parts:
        for i, (shared, key, payload) in enumerate(decode(blob)):
            yield (common_prefix(last, key) if i == 0 else shared), key, payload
            last = key


def _split(blob: bytes, cut: bytes, after: bool) -> tuple[bytes, bytes]:
    """The entries of a block below ``cut`` (``after``: or equal to it), and the rest."""
    entries = [(key, payload) for _, key, payload in decode(blob)]
    at = (bisect.bisect_right if after else bisect.bisect_left)(entries, cut, key=lambda e: e[0])
    return encode(entries[:at]), encode(entries[at:])


def streamed(arriving: Iterator[tuple[bytes, int, bytes]], held_blocks: int | None = None,
             seen: Callable[[int], None] | None = None) -> Iterator[tuple[int, bytes, bytes]]:
    """Merge the blocks (first key, run, blob) of one bucket, which arrive by first key, run and place in the run.

    Yields (prefix shared with the key before, key, payload). Equal keys of different runs
    come in an order that follows from the runs alone. ``seen`` gets the number of blocks held.
    """
    limit = held_blocks or HELD_BLOCKS
    held: dict[int, list[bytes]] = {}
    n, last, following = 0, b"", next(arriving, None)
    while held or following:
        pulled = 0
        while following and pulled < limit:
            held.setdefault(following[1], []).append(following[2])
            n, pulled, following = n + 1, pulled + 1, next(arriving, None)
        if seen:
            seen(n)
        parts, rest = held, {}
        if following:
            cut = following[0]
            # One key may fill everything that is held: then it goes out, or nothing ever would.
            least = min(next(decode(blobs[0]))[1] for blobs in held.values())
            parts = {}
            for run, blobs in held.items():
                # All but the last block of a run end at the last one's first key or below, and that is not above the cut.
                done, left = [], []
                for blob in blobs:
                    low, high = _split(blob, cut, after=least == cut)
                    done += [low] if low else []
                    left += [high] if high else []
                if done:
                    parts[run] = done
                if left:
                    rest[run] = left
        for i, (shared, key, payload) in enumerate(LoserTree([_chained(parts[r]) for r in sorted(parts)])):
            yield (common_prefix(last, key) if i == 0 else shared), key, payload
            last = key
        held, n = rest, sum(map(len, rest.values()))


def merged(runs: DataFrame, consume: Callable[[int, Iterator[tuple[int, bytes, bytes]]], Iterator[dict]],
           schema: str) -> DataFrame:
    """Merge the written ``runs`` (``BLOCKS``) bucket by bucket.

    ``consume(bucket, entries)`` gets a bucket's (shared prefix, key, payload)
    in key order and yields output batches. Buckets follow the key order, and
    their number follows the number of entries.
    """
    n = runs.agg(F.sum("n"), F.count("n")).first()
    buckets = min(MAX_BUCKETS, math.ceil((n[0] or 0) / BUCKET_ENTRIES))
    splits: list[bytes] = []
    if buckets > 1:
        share = min(1.0, KEYS_PER_BUCKET * buckets / n[1])
        keys = sorted(bytes(r[0]) for r in runs.select("first_key").sample(share, seed=1).collect())
        splits = sorted({keys[len(keys) * i // buckets] for i in range(1, buckets)}) if keys else []

    def cut(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out = {k: [] for k in ("bucket", "first_key", "run", "seq", "blob")}
            for run, seq, blob in zip(b["run"].to_pylist(), b["seq"].to_pylist(), b["blob"].to_pylist()):
                entries = [(k, p) for _, k, p in decode(blob)]
                at = 0
                while at < len(entries):
                    bucket = bisect.bisect_right(splits, entries[at][0])
                    end = bisect.bisect_left(entries, splits[bucket], at, key=lambda e: e[0]) if bucket < len(splits) else len(entries)
                    part = blob if end - at == len(entries) else encode(entries[at:end])
                    for k, v in zip(out, (bucket, entries[at][0], run, seq, part)):
                        out[k].append(v)
                    at = end
            yield out

    def merge(batches: Iterator[dict]) -> Iterator[dict]:
        def arriving() -> Iterator[tuple[int, bytes, int, bytes]]:
            for b in batches:
                yield from zip(*(b[c].to_pylist() for c in ("bucket", "first_key", "run", "blob")))
        for bucket, parts in itertools.groupby(arriving(), key=lambda part: part[0]):
            yield from consume(bucket, streamed(part[1:] for part in parts))

    dealt = map_rows(runs.select("run", "seq", "blob"), cut, "bucket int, first_key binary, run long, seq int, blob binary")
    ordered = dealt.repartition("bucket").sortWithinPartitions("bucket", "first_key", "run", "seq")
    return map_rows(ordered, merge, schema)


def written_runs(df: DataFrame, name: str) -> DataFrame:
    return materialize(df, name)
