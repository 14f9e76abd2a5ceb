"""Token ids of whole texts with a public word-level BPE, and best-fit-decreasing packing to matrices.

Tokenising: the vocabulary's pre-tokeniser never lets a token span white space,
so a text is cut at spaces and line ends and each chunk's ids are looked up in
a bounded per-worker cache; a miss is tokenised once. The result equals the
tokenizer's own over the whole text.

Packing (``pack_matrices``): per task, documents gather in blocks of at most
``BLOCK_TOKENS`` ids. Documents longer than a sequence give whole sequences and
one rest; pieces go, longest first, into the open sequence with the least room
that still fits, found with a segment tree over remaining capacities. No
shuffle, no driver work; a block bounds the memory, not the corpus.

Defined results: null, empty and white-space texts are the end id alone;
repeated rows are packed as often as they occur; null doc_ids are carried;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from vectorloom.llm.common import map_rows

SEQUENCE = 4096
#: Ids per packing block: bounds a task's memory and the last, partly filled sequence to one per block.
BLOCK_TOKENS = 4 << 20
#: End id of the packed matrices (the vocabulary's end-of-text).
END_OF_TEXT = 49407
#: Bound of a worker's chunk cache; a full cache is dropped, results do not depend on it.
CACHE_CHUNKS = 600_000
LONG_CHUNK = 48
VOCABULARY = "word_bpe_49k.json"

# The vocabulary file's pre-tokeniser pattern (a fixed value).
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def _byte_signs() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest for U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ChunkIds(dict):
    """chunk (no ASCII space or line end inside) -> its ids as little-endian uint16 bytes."""

    def __init__(self, path: str | None = None):
        from tokenizers import Tokenizer
        if path is None:
            import public_tokenizers
            path = public_tokenizers.path(VOCABULARY)
        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.model, self.signs = self.tokenizer.model, str.maketrans(_byte_signs())
        self[""] = b""

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype="<u2").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if "<|" in chunk or not chunk.isprintable() or max(chunk) >= "ɐ":
            ids = self._bytes(self.tokenizer.encode(chunk, add_special_tokens=False).ids)
        else:
            low = chunk.lower()
            pieces = [low] if low.isalpha() else _PIECES.findall(low)
            if pieces == [chunk]:
                signs = chunk if chunk.isascii() else chunk.encode().decode("latin-1").translate(self.signs)
                ids = self._bytes([t.id for t in self.model.tokenize(signs)])
            else:
                ids = b"".join([self[p] for p in pieces])
        if len(chunk) <= LONG_CHUNK:
            if len(self) >= CACHE_CHUNKS:
                self.clear()
                self[""] = b""
            self[chunk] = ids
        return ids

    def text_ids(self, text: str | None) -> bytes:
        """The whole text's ids, as uint16 bytes."""
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" "))) if text else b""


_CACHES: dict[str | None, ChunkIds] = {}


def chunk_ids(path: str | None = None) -> ChunkIds:
    """The worker's cache for a vocabulary file."""
    if path not in _CACHES:
        _CACHES[path] = ChunkIds(path)
    return _CACHES[path]


class CapacityTree:
    """How many open sequences have each remaining capacity; finds the least one that fits."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, by: int) -> None:
        i = capacity + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def least(self, need: int) -> int | None:
        """The smallest capacity >= ``need`` of an open sequence."""
        i = need + self.size
        if self.count[i]:
            return need
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers; every length is between 1 and ``capacity``."""
    tree, open_bins, bins = CapacityTree(capacity), {}, []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        room = tree.least(lengths[item])
        if room is None:
            room, at = capacity, len(bins)
            bins.append([])
        else:
            at = open_bins[room].pop()
            tree.add(room, -1)
        bins[at].append(item)
        left = room - lengths[item]
        if left:
            open_bins.setdefault(left, []).append(at)
            tree.add(left, 1)
    return bins


def pack_block(block: list[tuple], first: int, sequence: int) -> dict:
    """One output batch: ``block`` holds (doc_id, ids)."""
    pieces = [(d, ids, s, min(sequence, len(ids) - s)) for d, ids in block for s in range(0, len(ids), sequence)]
    out = {k: [] for k in ("sequence_id", "n_tokens", "doc_ids", "starts", "cu_seqlens", "ids", "position_ids")}
    for number, items in enumerate(best_fit_decreasing([p[3] for p in pieces], sequence)):
        chosen = [pieces[i] for i in items]
        cu = np.cumsum([0] + [p[3] for p in chosen])
        row, pos = np.zeros(sequence, dtype="<u2"), np.zeros(sequence, dtype="<u2")
        for (_, ids, start, n), at in zip(chosen, cu):
            row[at:at + n] = ids[start:start + n]
            pos[at:at + n] = np.arange(n)
        for k, v in zip(out, (first + number, int(cu[-1]), [p[0] for p in chosen], [p[2] for p in chosen],
                              cu.tolist(), row.tobytes(), pos.tobytes())):
            out[k].append(v)
    return out


def pack_matrices(docs: DataFrame, sequence: int = SEQUENCE, path: str | None = None) -> DataFrame:
    """One row per packed sequence: the padded id row and position row (uint16, resetting at every
    segment), the cumulative segment lengths, and each segment's document and start in it."""
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        cache, end = chunk_ids(path), np.array([END_OF_TEXT], dtype="<u2").tobytes()
        task = TaskContext.get().partitionId() << 32
        block, held, number = [], 0, 0
        for b in batches:
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
                ids = np.frombuffer(cache.text_ids(text) + end, dtype="<u2")
                block.append((doc_id, ids))
                held += len(ids)
                if held >= BLOCK_TOKENS:
                    out = pack_block(block, task + number, sequence)
                    number += len(out["ids"])
                    block, held = [], 0
                    yield from _slices(out)
        if block:
            yield from _slices(pack_block(block, task + number, sequence))

    return map_rows(docs.select("doc_id", "text"), run,
                    "sequence_id long, n_tokens int, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, "
                    "ids binary, position_ids binary")


def _slices(out: dict, rows: int = 256) -> Iterator[dict]:
    for i in range(0, len(out["ids"]), rows):
        yield {k: v[i:i + rows] for k, v in out.items()}


def write_packed(packed: DataFrame, path: str) -> None:
    """Write the packed matrices as Parquet."""
    packed.write.parquet(path)
