import gzip
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from vectorloom.llm import merge, warc


def brute(rows):
    top, size = {}, {}
    for p, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000:
            top.setdefault(b, []).append(p)
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        same = top.get(b, [])
        best = max((x for x in same if x is not None), default=None)
        refers = len(same) > 1 and best is not None and p != best
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if refers else "response", best if refers else None))
    return sorted(out, key=repr)


def rows_of(seed):
    rng = random.Random(seed)
    page = lambda n: "<p>" + "".join(rng.choice("abcé <>\r\n") for _ in range(n)) + "WARC/1.1\r\n\r\n\r\n\r\n</p>"
    shared = [page(n) for n in (400, 1200, 5000)]
    rows = [(i, f"http://h{i % 5}.example.org/a b/{i % 7}?q={i}#f", rng.choice(shared + [page(1500)])) for i in range(60)]
    return rows + [(100, None, None), (101, "", ""), (102, "no scheme\r\nX: y", shared[1]), (None, "http://a.b/", shared[2]),
                   (-5, "https://www.Ex.com:80/", "é" * 500), (7, "http://h0.example.org/", rows[7][2]), (103, "http://big", page(60_000))]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(4)


def test_round_trip_and_order(spark, monkeypatch):
    rows = rows_of(1)
    monkeypatch.setattr(merge, "BUCKET_ENTRIES", 10)
    monkeypatch.setattr(merge, "BLOCK_ENTRIES", 3)
    monkeypatch.setattr(warc, "RUN_ENTRIES", 9)
    got = warc.capture_history(frame(spark, rows)).collect()
    facts = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=repr)
    assert facts == brute(rows)
    ordered = sorted(got, key=lambda r: (r["bucket"], r["position"]))
    keys = [(r["url_key"], r["capture"], r["page_id"] or 0) for r in ordered]
    assert keys == sorted(keys)


@pytest.mark.parametrize("heavy", [1, 10_000])
def test_places_and_both_lookups(spark, monkeypatch, heavy):
    rows = rows_of(2)
    monkeypatch.setattr(merge, "BUCKET_ENTRIES", 10)
    monkeypatch.setattr(merge, "HELD_BLOCKS", 2)
    monkeypatch.setattr(warc, "RUN_ENTRIES", 9)
    monkeypatch.setattr(warc, "HEAVY_DIGESTS", heavy)      # 1: all repeated payloads take the shuffled join
    got = warc.ordered_history(frame(spark, rows)).collect()
    facts = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=repr)
    assert facts == brute(rows)
    want = sorted(range(len(rows)), key=lambda i: (warc.url_key(warc.clean_url(rows[i][1])), warc.capture_time(rows[i][0]), rows[i][0] or 0))
    assert [r["page_id"] for r in sorted(got, key=lambda r: r["place"])] == [rows[i][0] for i in want]
    assert sorted(r["place"] for r in got) == list(range(len(rows)))


def test_hot_payload_spreads(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "x" * 2000 if i % 3 else None) for i in range(300)], "page_id long, url string, html string")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        per_task = [r["count"] for r in warc.stored_once(pages).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(per_task) == 300 and max(per_task) < 100


def test_seek_reads_one_capture(spark, tmp_path):
    rows = rows_of(3)
    path = f"{tmp_path}/archives"
    for r in warc.capture_history(frame(spark, rows), path).collect():
        with open(os.path.join(path, r["archive"]), "rb") as f:
            f.seek(r["offset"])
            data = gzip.decompress(f.read(r["length"]))
        (start, length, headers, block), = warc.parse(data)
        assert (start, length) == (0, len(data)) and warc.page_of(headers["warc-record-id"]) == r["page_id"]
        assert headers["warc-type"] == r["record_type"]
        if r["record_type"] == "response":
            assert hashlib.sha1(block.partition(b"\r\n\r\n")[2]).hexdigest() == r["payload_digest"]


def test_members_of_any_size():
    rng = random.Random(5)
    parts = [b"a", rng.randbytes(70_000), b"x" * (1 << 24), b"tail", b"y" * ((1 << 24) + 7)]
    archive = b"".join(map(warc.member, parts))
    assert archive[-1] == 0 and [d for _, _, d in warc.members(archive)] == parts
    assert [gzip.decompress(archive[o:o + n]) for o, n, _ in warc.members(archive)] == parts
    with pytest.raises(ValueError):
        list(warc.members(archive[:-30]))


def test_record_ids_and_keys():
    for p in (0, 5, -1, 2 ** 63 - 1, -2 ** 63, None):
        assert warc.page_of(warc.record_id(p)) == p
    assert warc.url_key("https://www.Ex.com:80/A/?q#f") == "com,ex)/a/?q"
    assert warc.url_key(warc.clean_url(None)) == "urn:missing"


def test_empty(spark):
    assert warc.capture_history(frame(spark, [])).count() == 0
