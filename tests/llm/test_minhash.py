import random
import re
from collections import Counter

import numpy as np

from tests.llm.conftest import frame, words
from vectorloom.llm import minhash


def shingle_set(text, size=4):
    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(ws[i:i + size]) for i in range(max(1, len(ws) - size + 1))} if ws else set()


def brute(rows, size=4):
    """doc_id -> root over rows with ids; rows of one id are one document."""
    rows = [(d, s) for d, t in rows if d is not None and (s := shingle_set(t, size))]
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(rows):
        for b, t in rows[:i]:
            if 100 * len(s & t) >= 80 * len(s | t) and find(a) != find(b):
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    return {d: find(d) for d in parent}


def check(spark, rows):
    want = brute(rows)
    got = minhash.near_duplicates(frame(spark, rows), size=4).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        elif r["n_shingles"]:
            assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (want[r["doc_id"]] == r["doc_id"])
    assert sorted(r["n_shingles"] for r in got) == sorted(len(shingle_set(t)) for _, t in rows)


def near_copies(seed):
    rng = random.Random(seed)
    rows, base = [], words(rng, 200, 4000).split()
    for i in range(160):     # similarities to the base and to each other lie on both sides of 0.8
        w = list(base)
        for _ in range(rng.randrange(2, 9)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10 ** 6)}"
        rows.append((1000 + i, " ".join(w)))
    chain = list(base[:100])
    for i in range(30):      # a chain: neighbours are similar, ends are not
        chain = chain[2:] + [f"c{i}a", f"c{i}b"]
        rows.append((3000 - i, " ".join(chain)))
    return rows


def test_links_match_brute_force(spark, messy):
    check(spark, messy[0] + near_copies(2))


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 7)
    check(spark, near_copies(3))


def test_sketch_fills_every_coordinate_and_estimates():
    rng = np.random.default_rng(1)
    for size in (1, 2, 50, 1000):
        items = np.unique(rng.integers(0, 2 ** 63, size).astype(np.uint64))
        assert (minhash.sketch(items) != 0).all()
    a = np.unique(rng.integers(0, 2 ** 63, 900).astype(np.uint64))
    errors = []
    for _ in range(20):
        b = np.unique(np.r_[a[rng.permutation(len(a))[:800]], rng.integers(0, 2 ** 63, 100).astype(np.uint64)])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        errors.append(np.mean(minhash.sketch(a) == minhash.sketch(b)) - true)
    assert abs(np.mean(errors)) < 0.03 and max(map(abs, errors)) < 0.2


def test_filter_keeps_one_of_each(spark, messy, empty):
    rows, docs = messy
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    want = brute(rows, minhash.SHINGLE)
    ids = {r["doc_id"] for r in kept.collect()}
    assert {d for d in ids if d in want} == {d for d in want if want[d] == d}
    assert {d for d, t in rows if d and not shingle_set(t)} <= ids
    assert minhash.near_duplicates(empty).count() == 0 and minhash.keep_one(empty).count() == 0


def test_repeated_and_null_ids(spark):
    rng = random.Random(9)
    one, other = words(rng, 40), words(rng, 40)
    rows = [(None, one), (None, one), (3, other), (3, other), (3, words(rng, 40)), (9, one), (9, one)]
    kept = [r["doc_id"] for r in minhash.keep_one(frame(spark, rows)).collect()]
    assert Counter(kept) == {None: 2, 3: 1, 9: 1}


def test_judged_on_texts_as_they_came(spark):
    rng = random.Random(8)
    a, b = words(rng, 80), words(rng, 80)
    came = frame(spark, [(1, a), (2, a + " tail"), (3, b), (4, b)])
    cut = frame(spark, [(1, a), (2, "tail"), (3, b), (7, "not among them " + words(rng, 20))])
    assert {r["doc_id"] for r in minhash.keep_one(cut, came).collect()} == {1, 3, 7}


def test_no_links_at_all(spark):
    rng = random.Random(4)
    rows = [(i, words(rng, 30, 10 ** 6)) for i in range(20)]
    assert all(r["kept"] for r in minhash.near_duplicates(frame(spark, rows)).collect())
