import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import frame
from tests.llm.test_winnow_chars import printed as printed_chars, selected as selected_chars
from vectorloom.llm import winnow
from vectorloom.llm.winnow import K, PRIME, W


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def selected(text):
    """(hash, position) pairs, windows taken one by one."""
    h = [xxhash.xxh64_intdigest(w.encode(), 42) & PRIME for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    if not h:
        return []
    if len(h) >= K:
        grams = []
        for i in range(len(h) - K + 1):
            total = h[i + K - 1]
            for j in range(K - 1):
                total += h[i + j] * winnow.POWERS[j]
            grams.append(total % PRIME)
    else:
        g = 0
        for x in h:
            g = (g * 8191 + x) % PRIME
        grams = [g]
    out = []
    for i in range(max(1, len(grams) - W + 1)):
        window = list(enumerate(grams[i:i + W], i))
        pos, g = min(window, key=lambda p: (p[1], -p[0]))
        if (g, pos) not in out:
            out.append((g, pos))
    return out


def like(a, b):
    a, b = {g for g, _ in a}, {g for g, _ in b}
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def printed(sel):
    return " ".join(f"{g << 31 | PRIME - p:X}" for g, p in sel)


@pytest.mark.parametrize("bucket_docs", [1024, 5])
def test_query_matches_brute_force(spark, messy, monkeypatch, bucket_docs):
    monkeypatch.setattr(winnow, "BUCKET_DOCS", bucket_docs)
    rows = list(dict.fromkeys(messy[0]))   # rows repeated in full are interchangeable neighbours
    keys = {(r["doc_id"], r["text"]): r["k"] for r in frame(spark, rows).select(
        "doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("k")).collect()}
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, keys[r]), reverse=True)
    want = []
    for i, (d, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        a, b = selected_chars(t), selected_chars(edited)
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), printed_chars(a), printed_chars(b),
                     round(like(a, b), 9), round(like(a, selected_chars(nxt)), 9)))
    got = [(*r[:5], round(r[5], 9), round(r[6], 9)) for r in winnow.edited_fingerprints(frame(spark, rows)).collect()]
    order = lambda r: (r[0] is None, r)
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and order


def test_words_match_brute_force(spark, messy):
    rows = [(i, t) for i, (_, t) in enumerate(messy[0])]
    got = {r["doc_id"]: r["fingerprint"] for r in winnow.fingerprints(frame(spark, rows)).collect()}
    assert got == {d: printed(selected(t)) for d, t in rows}


@pytest.mark.parametrize("hot", [None, 7])
def test_null_and_repeated_ids_spread(spark, monkeypatch, hot):
    """Rows of one id with different texts fall into many window groups, whose numbers rise with the id."""
    monkeypatch.setattr(winnow, "BUCKET_DOCS", 20)
    rows = [(hot, f"text number {i} of one id") for i in range(300)] + [(i, f"other text {i}") for i in range(200)]
    docs = frame(spark, rows).withColumn("tkey", F.xxhash64("text"))
    found = docs.select("doc_id", "tkey", winnow._bucket(docs, F.col("doc_id"), F.col("tkey")).alias("b")).collect()
    groups = {}
    for r in found:
        groups.setdefault(r["b"], []).append(r)
    assert max(map(len, groups.values())) <= 60 and len({r["b"] for r in found if r["doc_id"] == hot}) > 8
    ordered = sorted(found, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["tkey"]))
    assert [r["b"] for r in ordered] == sorted(r["b"] for r in found)
    out = winnow.edited_fingerprints(docs).collect()
    assert len(out) == 500


def test_shared_passage_is_found(spark):
    passage = " ".join(f"p{i}" for i in range(K + W - 1))
    docs = frame(spark, [(1, "a b c " + passage + " d e"), (2, "x " + passage + " y z q")])
    prints = [set(int(x, 16) >> 31 for x in r["fingerprint"].split()) for r in winnow.fingerprints(docs).collect()]
    assert prints[0] & prints[1]


def test_repeated_rows_empty_and_native(spark, messy, empty):
    _, docs = messy
    out = winnow.edited_fingerprints(docs)
    assert out.count() == docs.count()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert winnow.edited_fingerprints(empty).count() == 0
    one = winnow.edited_fingerprints(frame(spark, [(5, "only one text here")])).first()
    assert one["near_next"] == 1.0
