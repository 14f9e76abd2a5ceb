"""The pipeline against its stages done by brute force, one after the other."""

import random
from collections import Counter

import corpus_pipeline
import numpy as np

from tests.llm import test_decontam, test_lines, test_minhash
from tests.llm.conftest import frame, messy_rows, words
from vectorloom.llm import decontam, lines, minhash, packing, quality, tokens
from vectorloom.llm.common import materialize
from vectorloom.sources.tables import read_table

SF = "/root/testdata/sf0.001"


def test_stages_and_result(spark):
    docs, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    items = [tuple(r) for r in read_table(spark, SF, "benchmark").collect()]
    vectors, network = quality.fit(docs, labels)
    index = quality.index_vectors()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    score = lambda t: network.score(quality.pooled(quality.word_ids(t), vectors, index)[None].astype(np.float64))[0]
    rows = [(d, t) for d, t in rows if score(t) >= quality.THRESHOLD]
    assert 100 < len(rows) < 200
    roots = test_minhash.brute(rows, 5)       # copies are judged on the texts as they came in
    rows = [(d, kept) for d, *_, dropped, _, kept in test_lines.brute(rows) if not dropped or kept.strip(" \t\n\x0b\x0c\r")]
    rows = [(d, t) for d, t in rows if roots.get(d, d) == d]
    copies = {d for d in roots if roots[d] != d}
    assert copies
    bad = {d for d, *_ in test_decontam.brute(rows, items)}
    rows = [(d, t) for d, t in rows if d not in bad]
    assert bad

    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns
        if name == "near_dedup":
            left = {r["doc_id"]: r["text"] for r in kept.collect()}
            assert not copies & left.keys() and all((t or "").strip() for t in left.values())
    assert {(r["doc_id"], r["text"]) for r in kept.collect()} == set(rows)

    cache, sizes = tokens.ChunkIds(), {}
    for p in corpus_pipeline.run(spark, SF).collect():
        sizes[p["doc_id"]] = sizes.get(p["doc_id"], 0) + p["length"]
    assert sizes == {d: len(cache.text_ids(t)) // 2 + 1 for d, t in rows}
    assert packing.END == 2


def test_line_dedup_and_near_dedup_both_tell(spark, tmp_path):
    """Texts that become near copies once their shared lines are gone, and near copies that line dedup takes apart."""
    rng = random.Random(4)
    one, two, three = ("\n".join(words(rng, 12) for _ in range(6)) for _ in range(3))
    body, part = words(rng, 100), words(rng, 40)
    edited = body.replace(body.split()[50], "changed", 1)
    rows = [(1, one), (2, two), (3, f"{one}\n{body}"), (4, f"{two}\n{edited}"), (5, f"{three}\n{part}"), (6, f"{three}\n{part} end"),
            (None, f"{two}\n{edited} none")]
    docs = frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = read_table(spark, str(tmp_path), "documents")

    def ids(df):
        return sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=lambda x: x or 0)

    cut = corpus_pipeline.line_dedup(spark, docs, str(tmp_path))
    assert ids(cut) == ids(docs) == [None, 1, 2, 3, 4, 5, 6]
    assert ids(corpus_pipeline.near_dedup(spark, docs, str(tmp_path))) == [None, 1, 2, 3, 4, 5]
    assert ids(corpus_pipeline.near_dedup(spark, cut, str(tmp_path))) == [None, 1, 2, 3, 5]
    assert ids(minhash.keep_one(cut)) == [None, 1, 2, 3, 5, 6]
    assert ids(minhash.keep_one(cut.limit(0), docs)) == [] and ids(minhash.keep_one(cut, docs.limit(0))) == [None, 1, 2, 3, 5, 6]


def test_few_rows_fill_few_files(spark, monkeypatch):
    """Many shuffle partitions and few rows: no table and no stage's result has a file for each partition."""
    rng = random.Random(5)
    base, shared = words(rng, 60), words(rng, 12)
    rows = [(i, f"{shared}\n{base} e{i}") for i in range(40)] + [(100 + i, f"{shared}\n{words(rng, 40)}") for i in range(60)]
    docs = frame(spark, rows, 8).select("doc_id", "text", "lang", "source", "n_chars")
    benchmark = spark.createDataFrame([(i, words(rng, 30)) for i in range(50)], "item_id long, text string")
    files = {}

    def noted(df, name):
        out = materialize(df, name)
        files[name] = max(files.get(name, 0), len(out.inputFiles()))
        return out

    for module in (lines, minhash, decontam, packing):
        monkeypatch.setattr(module, "materialize", noted)
    put = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in put}
    try:
        for k, v in put.items():
            spark.conf.set(k, v)
        cut = noted(lines.dedup_lines(docs, drop_emptied=True), "line_dedup")
        kept = noted(minhash.keep_one(cut, docs), "near_dedup")
        clean = noted(decontam.decontaminate(kept, benchmark), "decontamination")
        pieces = noted(packing.pack_along_curve(clean), "packing")
        assert kept.count() == clean.count() == 61
        got = pieces.collect()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    # more-links: one task for each block pair that has links.
    assert {k: n for k, n in files.items() if n > 1 and k not in ("more-links", "curve")} == {}
    assert len(files) > 15
    ends = Counter()
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):    # ranges share no sequence
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert len({i >> 32 for i in ends}) > 1 and all(n & (n - 1) == 0 for n in ends.values())
    assert sum(ends.values()) == sum(r["doc_tokens"] for r in got if r["start"] == 0)


def test_messy_rows_pass_every_stage(spark, empty):
    docs = frame(spark, messy_rows())
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert stage(spark, empty, SF).count() == 0, name
        if name != "packing":
            assert out.columns == docs.columns and 0 < out.count() <= docs.count()
