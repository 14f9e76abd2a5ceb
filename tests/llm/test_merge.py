import random

import pytest

from vectorloom.llm import merge


def arriving(runs, size):
    """The blocks of ``runs`` as a bucket's task gets them: by first key, run and place in the run."""
    found = []
    for run, entries in enumerate(runs):
        entries = sorted(entries)
        for seq, i in enumerate(range(0, len(entries), size)):
            part = entries[i:i + size]
            found.append((part[0][0], run, seq, merge.encode(part)))
    return iter([(key, run, blob) for key, run, seq, blob in sorted(found)])


def shared(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("held", [1, 3, 1000])
def test_streamed_bucket(seed, held):
    rng = random.Random(seed)
    letters = b"a" if seed % 4 == 0 else b"ab" if seed % 4 < 3 else bytes(range(256))
    runs = [[(bytes(rng.choice(letters) for _ in range(rng.randint(0, 12))), b"%d.%d" % (r, i)) for i in range(rng.randint(0, 60))]
            for r in range(rng.randint(0, 9))]
    got = list(merge.streamed(arriving(runs, 4), held))
    assert [k for _, k, _ in got] == sorted(k for run in runs for k, _ in run)
    assert sorted((k, p) for _, k, p in got) == sorted(e for run in runs for e in run)
    last = b""
    for n, key, _ in got:
        assert n == shared(last, key)
        last = key


def test_a_large_bucket_holds_few_blocks():
    rng = random.Random(5)
    runs = [[(rng.randbytes(6), b"") for _ in range(2000)] for _ in range(10)]
    most = []
    assert sum(1 for _ in merge.streamed(arriving(runs, 5), 20, most.append)) == 20_000
    assert max(most) <= 20 + 10        # of 4,000 blocks
    same = [[(b"k", b"%d" % i) for i in range(2000)] for _ in range(10)]     # one key fills the bucket
    most.clear()
    assert sum(1 for _ in merge.streamed(arriving(same, 5), 20, most.append)) == 20_000
    assert max(most) <= 20 + 10
