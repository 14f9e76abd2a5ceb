import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import public_tokenizers
from tests.llm.conftest import frame
from vectorloom.llm import bestfit, tokens


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(bestfit.VOCABULARY))


def true_ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def test_ids_equal_the_tokenizer(tokenizer, messy):
    own = bestfit.byte_tokens()
    texts = [t for _, t in messy[0]] + ["  two  spaces\t\n\n end ", "<|endoftext|>", "日本語 text", "a" * 5000, " " * 900 + "x",
                                        "it's we'll THEY'RE 12 345", " nbsp ’s — \x85 \x1c"]
    for t in texts:
        assert own.ids(t) == true_ids(tokenizer, t)[:-1]


def test_cut():
    assert bestfit.cut(5, 4) == [(0, 1), (1, 4)] and bestfit.cut(8, 4) == [(0, 4), (4, 4)] and bestfit.cut(3, 4) == [(0, 3)]


def test_meetings_are_last_in_first_out():
    # Partition 2 first empties what 1 left, then turns to 0.
    assert bestfit.meetings([(0, 0, 3), (1, 1, 2), (2, 4, 0), (3, 5, 1)]) == [
        (1, 0, 0, 0, 1), (2, 0, 1, 0, 2), (2, 2, 0, 1, 2)]


SIZES = {"uniform": lambda r: r.integers(1, 1024, 700), "short": lambda r: r.integers(1, 40, 700),
         "thirds": lambda r: r.integers(250, 520, 700), "one length": lambda r: np.full(700, 37),
         "hot": lambda r: np.r_[np.full(300, 512), r.integers(1, 600, 500)], "one": lambda r: np.array([1])}


@pytest.mark.parametrize("kind", SIZES)
def test_close_to_best_fit_decreasing(spark, monkeypatch, kind):
    monkeypatch.setattr(bestfit, "FEW_ROWS", 64)     # several partitions, so that sweeps meet
    sizes = SIZES[kind](np.random.default_rng(3)).tolist()
    items = spark.createDataFrame(list(enumerate(sizes)), "id long, size long").repartition(3)
    placed, opened = bestfit.best_fit(items)
    rows = placed.collect()
    assert sorted((r["id"], r["size"]) for r in rows) == list(enumerate(sizes))
    room = defaultdict(int)
    for r in rows:
        room[r["seq"]] += r["size"]
    assert max(room.values()) <= 1024 and len(room) <= opened
    alone = len(tokens.best_fit_decreasing(sizes, 1024))
    assert len(room) <= alone * 1.03 + 2


def test_pieces_are_whole_and_gapless(messy, tokenizer):
    rows, docs = messy
    got = bestfit.pack_best_fit(docs).collect()
    assert sorted((r["doc_id"] or -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(
        (d or -1, i, s, n, zlib.crc32(np.array(true_ids(tokenizer, t)[s:s + n], dtype="<u4").tobytes()))
        for d, t in rows for i, (s, n) in enumerate(bestfit.cut(len(true_ids(tokenizer, t)), 1024)))
    assert all(zlib.crc32(np.frombuffer(r["ids"], dtype="<u2").astype("<u4").tobytes()) == r["ids_crc32"] for r in got)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    rests = [n for _, t in rows for _, n in bestfit.cut(len(true_ids(tokenizer, t)), 1024)]
    assert len(sequences) <= len(tokens.best_fit_decreasing(rests, 1024)) + 2


def test_empty(empty):
    assert bestfit.pack_best_fit(empty).count() == 0
