import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import public_tokenizers
from tokenizers import Tokenizer
from vectorloom.llm import packing, tokens


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def true_ids(tokenizer, text, end):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [end]


def test_chunk_cache_equals_tokenizer(tokenizer, messy):
    cache = tokens.ChunkIds()
    for _, text in messy[0]:
        assert np.frombuffer(cache.text_ids(text), dtype="<u2").tolist() == true_ids(tokenizer, text, 0)[:-1]


def test_best_fit_decreasing():
    lengths = [7, 3, 5, 5, 2, 8, 1, 1, 10]
    bins = tokens.best_fit_decreasing(lengths, 10)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 10 for b in bins) and len(bins) == 5


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_decreasing_is_the_plain_loop(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 64, 1000])
    lengths = [rng.randrange(1, capacity + 1) if rng.random() < 0.5 else rng.randrange(1, capacity // 4 + 2) for _ in range(400)]
    bins = tokens.best_fit_decreasing(lengths, capacity)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    rooms = []
    for n in sorted(lengths, reverse=True):
        fitting = [k for k, room in enumerate(rooms) if room >= n]
        if fitting:
            rooms[min(fitting, key=rooms.__getitem__)] -= n
        else:
            rooms.append(capacity - n)
    assert sorted(capacity - sum(lengths[i] for i in b) for b in bins) == sorted(rooms)


def test_matrices_hold_every_id_once(messy, tokenizer):
    rows, docs = messy
    got = defaultdict(Counter)
    for r in tokens.pack_matrices(docs).collect():
        ids, pos = np.frombuffer(r["ids"], dtype="<u2"), np.frombuffer(r["position_ids"], dtype="<u2")
        assert len(ids) == len(pos) == 4096 and r["cu_seqlens"][-1] == r["n_tokens"] and not ids[r["n_tokens"]:].any()
        for d, s, a, b in zip(r["doc_ids"], r["starts"], r["cu_seqlens"], r["cu_seqlens"][1:]):
            assert pos[a:b].tolist() == list(range(b - a))
            got[d][(s, tuple(ids[a:b].tolist()))] += 1
    want = defaultdict(Counter)
    for d, t in rows:
        ids = true_ids(tokenizer, t, tokens.END_OF_TEXT)
        want[d].update((s, tuple(ids[s:s + 4096])) for s in range(0, len(ids), 4096))
    assert got == want


def test_curve_packing_is_lossless_and_gapless(messy, tokenizer):
    rows, docs = messy
    once = [(d, t) for d, t in rows if d is not None and sum(x[0] == d for x in rows) == 1]
    pieces = packing.pack_along_curve(docs).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_seq[p["sequence_id"]].append(p)
    for d, t in once:
        ids, at = true_ids(tokenizer, t, packing.END), 0
        for p in sorted(by_doc[d], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            part = np.array(ids[at:at + p["length"]], dtype="<u4")
            assert p["ids_crc32"] == zlib.crc32(part.tobytes())
            at += p["length"]
        assert at == len(ids)
    for seq in by_seq.values():
        at = 0
        for p in sorted(seq, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == 4096 or at & (at - 1) == 0
    assert sum(p["length"] for p in pieces) == sum(len(true_ids(tokenizer, t, 2)) for _, t in rows)


def test_hilbert_index_is_a_curve():
    side = 8
    grid = np.stack(np.meshgrid(*[np.arange(side)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = packing.hilbert_index(grid, 3)
    assert sorted(key.tolist()) == list(range(side ** 3))
    path = grid[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_empty(empty):
    assert tokens.pack_matrices(empty).count() == 0 and packing.pack_along_curve(empty).count() == 0
