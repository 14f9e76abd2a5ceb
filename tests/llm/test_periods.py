import hashlib
import zlib

import numpy as np
import pytest

from tests.llm.conftest import frame, messy_rows
from vectorloom.llm import periods


def brute(words, least=12):
    """Every (start, length, period) by the definition, by start and period."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def sequences(rng):
    """Random words of few kinds; repeated bases with one change; nested periods; Fibonacci, Thue-Morse; shifted regions."""
    n = int(rng.integers(0, 300))
    yield rng.integers(0, int(rng.integers(1, 4)), n)
    x = np.resize(rng.integers(0, int(rng.integers(1, 50)), int(rng.integers(1, 70))), n)
    if n > 20:
        x[rng.integers(0, n)] = 99
    yield x
    inner = np.resize(rng.integers(0, 5, int(rng.integers(1, 6))), int(rng.integers(1, 60)))
    base = np.r_[inner, rng.integers(0, 9, int(rng.integers(0, 20)))]
    yield np.r_[rng.integers(0, 9, int(rng.integers(0, 20))), np.resize(base, n), np.resize(base, int(rng.integers(0, 200)))]
    a, b = [0], [0, 1]
    while len(b) < n + 2:
        a, b = b, b + a
    yield np.array(b[:n], dtype=int)
    x = [0]
    while len(x) < n + 1:
        x = x + [1 - v for v in x]
    yield np.array(x[:n], dtype=int)
    root = rng.integers(0, 4, int(rng.integers(2, 5)))
    yield np.concatenate([np.resize(np.roll(root, int(rng.integers(0, 4))), int(rng.integers(20, 120))) for _ in range(3)])


def test_blocks_equal_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(25):
        docs = [d.tolist() for d in sequences(rng)]
        docs += docs[:2]
        found = periods.block_runs([periods.word_codes([b"%d" % w for w in d]) for d in docs])
        assert [[tuple(r) for r in f.tolist()] for f in found] == [brute(d) for d in docs]


def digest(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        a, g = (h // 10) % n, h // 10
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()),
            sha(b" ".join(w for i, w in enumerate(words) if i not in dropped)))


def some_rows():
    rows = [(d, t if t is None or len(t) < 6000 else t[:6000]) for d, t in messy_rows()]
    rows += [(1000 + i, " ".join(f"v{(i * j * j) % (3 + i % 40)}" for j in range(20 + 3 * i))) for i in range(60)]
    return rows + [(7000, "x " * 3000), (7001, "a b\tc\n" * 900 + "d")]


@pytest.mark.parametrize("block", [40, 1 << 18])
def test_digest_equals_brute_force(spark, monkeypatch, block):
    rows = some_rows()
    monkeypatch.setattr(periods, "BLOCK_WORDS", block)
    got = sorted(map(tuple, periods.run_digest(frame(spark, rows)).collect()), key=repr)
    want = sorted((digest(*r) for r in rows), key=repr)
    assert got == want
    assert sum(r[1] > 0 for r in want) > 20


def test_operator_returns_runs_and_text(spark):
    rows = [(1, "to be " * 8 + "or not"), (2, "plain words only"), (3, None)]
    got = {r["doc_id"]: r for r in periods.periodic_runs(frame(spark, rows)).collect()}
    assert [tuple(r) for r in got[1]["runs"]] == [(0, 16, 2)] and bytes(got[1]["collapsed"]) == b"to be or not"
    assert got[2]["runs"] == [] and bytes(got[2]["collapsed"]) == b"plain words only"
    assert got[3]["n_words"] == 0 and bytes(got[3]["collapsed"]) == b""


def test_no_shuffle_and_empty(spark, empty):
    plan = periods.run_digest(empty)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert periods.run_digest(empty).count() == 0
