import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from vectorloom.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, row long, position int, entry string, part string, code string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, 2, "x", "y", "z") for r in rows], SCHEMA).repartition(parts)


def brute(rows, parts=16, entries=64, rounds=2):
    """(vec_id, code, error, label_error, sha) by the definition, one member at a time."""
    kept = [(v, [math.floor(256 * float(np.float32(x))) for x in e], label) for v, e, label in rows
            if e and len(e) % parts == 0 and all(x is not None and math.isfinite(x) for x in e)]
    if not kept:
        return []
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    wide = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == wide]
    w = wide // parts
    cut = lambda x, p: x[p * w:(p + 1) * w]
    books = [[cut(r[1], p) for r in kept[:entries]] for p in range(parts)]

    def near(x, p):
        return min((sum((a - b) ** 2 for a, b in zip(x, y)), i) for i, y in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for r in kept:
                members[near(cut(r[1], p), p)[1]].append(cut(r[1], p))
            books[p] = [[sum(c) // len(members[i]) for c in zip(*members[i])] if members[i] else y for i, y in enumerate(books[p])]
    out, by_label = [], defaultdict(int)
    for v, x, label in kept:
        found = [near(cut(x, p), p) for p in range(parts)]
        error = sum(d for d, _ in found)
        by_label[label] += error
        out.append((v, "".join(f"{i:02x}" for _, i in found), error, label))
    sha = hashlib.sha256(",".join(str(c) for b in books for y in b for c in y).encode()).hexdigest()
    return sorted([(v, c, e, by_label[label], sha) for v, c, e, label in out], key=repr)


def vectors(n, width=32, seed=2):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(width)] for _ in range(5)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        rows.append((i * 7 % 997, [x + rng.gauss(0, 0.2) for x in c], rng.choice([1, 2, 3, None])))
    return rows


def messy():
    rows = vectors(150)
    good = rows[3][1]
    return rows + [(5000, None, 1), (5001, [], 1), (5002, [None] + good[1:], 1), (5003, [float("nan")] + good[1:], 2),
                   (5004, [float("-inf")] + good[1:], 2), (5005, good[:16], 2), (5006, good[:31], 3), (None, good, 3), (None, good, None),
                   (7, rows[10][1], 2), (7, rows[10][1], 2), (5007, [0.0] * 32, 1)] + [(6000 + i, good, 2) for i in range(90)]


def test_digest_equals_brute_force(spark):
    rows = messy()
    got = sorted(map(tuple, codes.code_digest(frame(spark, rows)).collect()), key=repr)
    assert got == brute(rows)


@pytest.mark.parametrize("parts,entries,rounds", [(4, 8, 5), (1, 3, 1), (2, 200, 3), (8, 5, 0)])
def test_other_shapes(spark, parts, entries, rounds):
    rows = vectors(120, 16, parts)
    found, books = codes.vector_codes(frame(spark, rows), parts, entries, rounds)
    got = sorted((r["vec_id"], r["code"], r["error"]) for r in found.collect())
    want = brute(rows, parts, entries, rounds)
    assert got == sorted(w[:3] for w in want) and codes.books_digest(books) == want[0][4]


def test_only_migrants_are_shuffled(spark, monkeypatch):
    """Each state holds every member once; a shuffle after the first takes those that changed entry only."""
    dealt = []
    monkeypatch.setattr(codes, "by_owner", lambda df, deal=codes.by_owner: dealt.append(df.count()) or deal(df))
    rows = codes.scaled_rows(frame(spark, vectors(200)), 16).cache()
    books = np.array(codes.first_rows(rows, 8), dtype=np.int64).reshape(-1, 16, 2).swapaxes(0, 1)
    members, _, _ = codes.lloyd(rows, books, 4)
    assert members.count() == 200 * 16 == dealt[0] and members.select("row", "position").distinct().count() == 200 * 16
    assert len(dealt) == 4 and 0 < sum(dealt[1:]) < 200 * 16 and dealt[3] < dealt[1]


def test_hot_entry_is_salted(spark):
    """Equal vectors all choose one entry; its members still spread over several owners."""
    rows = codes.scaled_rows(frame(spark, [(i, [0.5] * 32, 1) for i in range(400)]), 16)
    books = np.array(codes.first_rows(rows, 4), dtype=np.int64).reshape(-1, 16, 2).swapaxes(0, 1)
    owners = codes.placed(rows, books, 5).groupBy("position", "entry", "salt").count().collect()
    assert {r["entry"] for r in owners} == {0} and len(owners) == 16 * 5 and max(r["count"] for r in owners) < 140


def test_large_components_and_empty(spark):
    rows = [(1, [3e38] * 16, 1), (2, [-3e38] * 16, 1), (3, [0.25] * 16, None)]
    assert {r["error"] for r in codes.code_digest(frame(spark, rows)).collect()} == {0}
    assert codes.code_digest(frame(spark, [])).count() == 0
    assert codes.code_digest(frame(spark, [(1, None, 1)])).count() == 0
