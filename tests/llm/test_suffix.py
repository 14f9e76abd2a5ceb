import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.conftest import frame
from vectorloom.llm import merge, suffix


def brute(rows):
    starts = defaultdict(int)
    texts = [(d, (t or "").encode()) for d, t in rows]
    for _, t in texts:
        for i in range(len(t) - 199):
            starts[t[i:i + 200]] += 1
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if starts[t[i:i + 200]] > 1:
                gone[i:i + 200] = b"\x01" * 200
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return Counter(out)


def planted(seed):
    rng = random.Random(seed)
    noise = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passages = [noise(n) for n in (150, 199, 200, 201, 260, 700)]
    rows = [(i, noise(rng.randrange(1, 500)) + rng.choice(passages) + noise(rng.randrange(0, 300))) for i in range(60)]
    base = noise(900)
    rows += [(100 + i, base[:i * 31] + "#" + base[i * 31 + 1:]) for i in range(25)]      # near copies: edits that move
    rows += [(200 + i, base[i * 17:i * 17 + 220 + i]) for i in range(20)]                # overlapping slices
    rows += [(300, "ab" * 400), (301, "x" * 199), (302, "x" * 200), (303, "x" * 201), (304, passages[5] * 3)]
    return rows


@pytest.mark.parametrize("paired, bucket", [(suffix.PAIRED, merge.BUCKET_ENTRIES), (3, 40)])
def test_matches_brute_force(spark, messy, monkeypatch, paired, bucket):
    rows = planted(paired) + [(d, t) for d, t in messy[0] if len(t or "") < 20_000]
    monkeypatch.setattr(merge, "BUCKET_ENTRIES", bucket)
    monkeypatch.setattr(merge, "BLOCK_ENTRIES", 16)
    monkeypatch.setattr(suffix, "PAIRED", paired)
    got = Counter(map(tuple, suffix.suffix_digest(frame(spark, rows, 5)).collect()))
    assert got == brute(rows)


def test_chunks_do_not_change_anchors(monkeypatch):
    text = np.random.default_rng(3).integers(97, 101, 20_000, dtype=np.uint8).tobytes()
    whole = suffix.anchors(text)
    monkeypatch.setattr(suffix, "CHUNK", 1000)
    assert suffix.anchors(text) == whole
    covered = [i for _, _, a, b in whole for i in range(a, b + 1)]
    assert covered == list(range(len(text) - 199))
    assert all(a <= p and p + suffix.GRAM <= b + 200 and p >= b for _, p, a, b in whole)


def test_loser_tree_merges_and_never_recompares():
    rng = random.Random(5)
    keys = [b"common/prefix/" * 10 + bytes(rng.choices(b"abc", k=rng.randrange(0, 12))) for _ in range(500)]
    runs = [sorted(keys[i::7]) for i in range(7)] + [[]]
    tree = merge.LoserTree([merge.decode(merge.encode((k, b"") for k in r)) for r in runs])
    out = list(tree)
    assert [k for _, k, _ in out] == sorted(keys)
    for (_, a, _), (shared, b, _) in zip(out, out[1:]):
        assert shared == merge.common_prefix(a, b)
    assert tree.compared < 8 * 140 + 500 * 40     # the long prefix is looked at once per run, not once per match


def test_hot_gram(spark):
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    hot = noise(260)
    rows = [(i, noise(40) + hot + noise(40)) for i in range(400)]
    assert Counter(map(tuple, suffix.suffix_digest(frame(spark, rows, 6)).collect())) == brute(rows)


def test_empty(empty):
    assert suffix.suffix_digest(empty).count() == 0
