"""Sizes, permutation, partition independence, padding."""

import pytest
from pyspark.sql import functions as F

from vectorloom.operators import sampling as S
from vectorloom.operators import text as X
from vectorloom.sources.tables import read_table


def _docs(spark, sf_dir):
    return read_table(spark, sf_dir, "documents")


def test_seeded_order_is_a_permutation(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    n = docs.count()
    pos = S.seeded_order(docs.select("doc_id"), "doc_id").select("position")
    r = pos.agg(F.min("position"), F.max("position"), F.countDistinct("position")).first()
    assert (r[0], r[1], r[2]) == (0, n - 1, n)


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_partition_independence(spark, sf_dir, parts):
    docs = _docs(spark, sf_dir).select("doc_id")
    base = {r["doc_id"]: r["position"] for r in S.seeded_order(docs, "doc_id").collect()}
    other = {r["doc_id"]: r["position"] for r in S.seeded_order(docs.repartition(parts), "doc_id").collect()}
    assert base == other
    a = [r["doc_id"] for r in S.sample_n(docs, 37, "doc_id").orderBy("position").collect()]
    b = [r["doc_id"] for r in S.sample_n(docs.repartition(parts), 37, "doc_id").orderBy("position").collect()]
    assert a == b


def test_bucket_positions_equal_range_sort_positions(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id")
    fast = {r["doc_id"]: r["position"] for r in S.seeded_position(docs, "doc_id", 7).collect()}
    keyed = docs.withColumn("sort_key", S.seeded_key("doc_id", 7))
    slow = {r["doc_id"]: r["position"] for r in S.global_position(keyed, ["sort_key", "doc_id"]).collect()}
    assert fast == slow


def test_global_position_with_a_hot_repeated_key(spark):
    # a third of the rows repeat one whole sort key; positions stay a permutation
    rows = [("a", i) for i in range(300)] + [("h", 0)] * 300 + [("z", i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, r long")
    got = S.global_position(df, ["k", "r"]).collect()
    assert sorted(x["position"] for x in got) == list(range(900))
    by_pos = sorted(got, key=lambda x: x["position"])
    assert [x["k"] for x in by_pos] == ["a"] * 300 + ["h"] * 300 + ["z"] * 300
    assert [x["r"] for x in by_pos[:300]] == list(range(300))


def test_repeated_ids_get_the_same_positions_on_any_partitioning(spark):
    # one id repeated as often as all others together
    rows = [(i, f"x{i}") for i in range(400)] + [(7, f"copy {i}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = df.withColumn("sort_key", S.seeded_key("doc_id", 42))
    want = [r["doc_id"] for r in keyed.orderBy("sort_key", "doc_id").collect()]
    seen, samples, general = set(), set(), set()
    for parts in (1, 5, 16):
        some = df.repartition(parts)
        got = sorted((r["position"], r["doc_id"], r["text"]) for r in S.seeded_position(some, "doc_id").collect())
        assert [g[1] for g in got] == want and [g[0] for g in got] == list(range(800))
        seen.add(tuple(got))
        for with_position in (True, False):
            taken = S.sample_n(some, 500, "doc_id", with_position=with_position).collect()
            samples.add(tuple(sorted((r["doc_id"], r["text"]) for r in taken)))
        general.add(tuple(sorted((r["position"], r["doc_id"], r["text"])
                                 for r in S.global_position(some, ["doc_id"]).collect())))
    assert len(seen) == len(samples) == len(general) == 1


def test_large_n_cut_without_positions_keeps_the_same_rows(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id")
    n = docs.count() // 2 + 1
    ranked = {r["doc_id"] for r in S.sample_n(docs, n, "doc_id").collect()}
    cut = {r["doc_id"] for r in S.sample_n(docs, n, "doc_id", with_position=False).collect()}
    assert ranked == cut and len(cut) == n


def test_sample_is_clamped_and_reports_shortfall(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id")
    n = docs.count()
    assert S.sample_n(docs, n + 50, "doc_id").count() == n
    r = S.sample_shortfall(docs, n + 50, "doc_id").first()
    assert r["shortfall"] and r["taken"] == n
    assert not S.sample_shortfall(docs, 3, "doc_id").first()["shortfall"]


def test_sample_ships_no_text_to_one_task(spark, sf_dir):
    for n in (50, S.SAMPLE_STATE + 1):
        plan = S.sample_n(_docs(spark, sf_dir), n, "doc_id")._jdf.queryExecution().executedPlan().toString()
        taken = [line for line in plan.splitlines() if "TakeOrdered" in line]
        assert all("output=[_vl_id" in line and "text" not in line for line in taken) and len(taken) == (n == 50)


def test_label_vocab_dense(spark):
    c = spark.createDataFrame([(1, "train", "fr"), (2, "train", "en"), (3, "test", "zz"), (4, "train", None)],
                              "doc_id long, split string, lang string")
    got = [(r["label"], r["label_name"]) for r in S.label_vocab(c).orderBy("label").collect()]
    assert got == [(0, "en"), (1, "fr")]


def test_truncation_and_batches(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    toks = X.tokens_truncated(docs, max_length=256)
    assert toks.agg(F.max("n_kept")).first()[0] <= 256
    batches = X.batch_assign(docs.select("doc_id"), 16).groupBy("batch_id").count().orderBy("batch_id").collect()
    sizes = [r["count"] for r in batches]
    assert all(s == 16 for s in sizes[:-1]) and 1 <= sizes[-1] <= 16


def test_left_padding_golden(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "d")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in X.left_padded(df, 2).collect()}
    assert rows[1]["input_tokens"] == ["a", "b", "c"] and rows[1]["attention_mask"] == [1, 1, 1]
    assert rows[2]["input_tokens"] == ["<pad>", "<pad>", "d"] and rows[2]["attention_mask"] == [0, 0, 1]
    w = X.padding_waste(df, 2).first()
    assert (w["rows"], w["batch_len"], w["real_tokens"], w["padded_tokens"]) == (2, 3, 4, 6)
    assert w["waste"] == pytest.approx(1 / 3)


def test_vocabulary_lookup_literal_and_join_agree(spark):
    from vectorloom.sources.corpus import attach_label, vocab_mapping
    c = spark.createDataFrame([(1, "train", "fr"), (2, "train", "en"), (3, "test", "zz"), (4, "test", None)],
                              "doc_id long, split string, lang string")
    vocab = S.label_vocab(c)
    k, mapping = vocab_mapping(vocab)
    assert k == 2 and mapping is not None
    k_big, none = vocab_mapping(vocab, max_classes=1)
    assert k_big == 2 and none is None
    lit = {r["doc_id"]: r["label"] for r in attach_label(c, vocab, mapping).collect()}
    joined = {r["doc_id"]: r["label"] for r in attach_label(c, vocab, None).collect()}
    assert lit == joined == {1: 1, 2: 0, 3: None, 4: None}


def test_repeated_ids_get_the_same_positions_under_any_input_order(spark):
    rows = [(i % 7, f"p{i}") for i in range(70)]
    df = spark.createDataFrame(rows, "doc_id long, payload string")

    def positions(frame):
        return {(r["doc_id"], r["payload"]): r["position"] for r in S.seeded_position(frame, "doc_id").collect()}

    base = positions(df.coalesce(1))
    assert sorted(base.values()) == list(range(70))
    assert positions(df.repartition(5)) == base
    assert positions(df.orderBy(F.col("payload").desc()).coalesce(1)) == base
    top = {(r["doc_id"], r["payload"]): r["position"] for r in S.sample_n(df.repartition(3), 20, "doc_id").collect()}
    assert top == {k: v for k, v in base.items() if v < 20}


def test_left_padded_keeps_one_row_per_repeated_id(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a"), (1, "a b"), (2, "x y")], "doc_id long, text string")
    rows = X.left_padded(df, 2).collect()
    assert len(rows) == 4 and all(len(r["input_tokens"]) == r["batch_len"] for r in rows)
