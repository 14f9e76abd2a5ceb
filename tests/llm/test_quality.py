import zlib

import numpy as np

from tests.llm.conftest import frame
from vectorloom.llm import quality
from vectorloom.sources.tables import read_table

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    got = {r["doc_id"]: r for r in quality.score(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    known = [(got[r["doc_id"]], r["quality"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    accuracy = np.mean([r["predicted"] == q for r, q in known])
    good = np.mean([r["predicted"] for r, q in known if q == 1])
    bad = np.mean([r["predicted"] for r, q in known if q == 0])
    assert accuracy >= 0.97 and good >= 0.99 and bad <= 0.1, (accuracy, good, bad)


def test_word_vectors_match_a_loop():
    index = quality.index_vectors()
    ids = quality.word_ids("alpha Beta gamma!! alpha 12 beta")
    want = np.zeros((quality.BUCKETS, quality.DIM))
    for i in range(len(ids)):
        for j in range(max(0, i - quality.WINDOW), min(len(ids), i + quality.WINDOW + 1)):
            if i != j:
                for b in ids[i]:
                    want[b] += index[ids[j][0]] + index[ids[j][1]]
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    assert np.allclose(quality.word_vectors([ids], index), want, atol=1e-5)


def test_messy_rows_get_one_score_each(spark, messy, empty):
    rows, docs = messy
    labels = spark.createDataFrame([(r[0], i % 2, None) for i, r in enumerate(rows) if r[0]] + [(None, 1, 1), (9999, 0, 0), (1, None, 0), (4, 5, 0)],
                                   "doc_id long, quality int, toxic int")
    got = quality.score(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    blank = {r["score"] for r in got if r["doc_id"] in (1, 4)}
    assert len(blank) == 1
    assert quality.keep_quality(docs, labels).columns == docs.columns
    assert quality.score(empty, labels).count() == 0
    none = spark.createDataFrame([], labels.schema)
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.keep_quality(frame(spark, rows[:3]), none).count() == 3
