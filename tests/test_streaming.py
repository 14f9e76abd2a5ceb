"""The stateless vector operators over a file stream equal the batch result."""

import os
import shutil

from vectorloom.operators.encode import encode_hashed
from vectorloom.operators.vectors import truncate_normalize
from vectorloom.session import local_dir_of, scratch_path
from vectorloom.sources.tables import SCHEMAS, table_path
from vectorloom.streaming import vectors as SV


def test_stream_normalize_matches_batch_and_resumes(spark, sf_dir):
    src = local_dir_of(scratch_path(spark, "stream-src"))
    os.makedirs(src)
    shutil.copy(table_path(sf_dir, "embeddings"), os.path.join(src, "part-0.parquet"))
    sink = scratch_path(spark, "stream-sink")
    stream = SV.read_stream(spark, src, SCHEMAS["embeddings"])
    ckpt = SV.run_available(SV.normalized_vectors(stream, 16), sink)
    got = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(sink).collect()}
    batch = truncate_normalize(spark.read.parquet(table_path(sf_dir, "embeddings")), 16)
    want = {r["vec_id"]: r["embedding"] for r in batch.collect()}
    assert got == want
    # a second run over the same checkpoint adds only the new file
    shutil.copy(table_path(sf_dir, "embeddings"), os.path.join(src, "part-1.parquet"))
    stream = SV.read_stream(spark, src, SCHEMAS["embeddings"])
    SV.run_available(SV.normalized_vectors(stream, 16), sink, ckpt)
    assert spark.read.parquet(sink).count() == 2 * len(want)


def test_stream_hashed_encode(spark, sf_dir):
    src = local_dir_of(scratch_path(spark, "stream-docs"))
    os.makedirs(src)
    shutil.copy(table_path(sf_dir, "documents"), os.path.join(src, "part-0.parquet"))
    sink = scratch_path(spark, "stream-enc")
    SV.run_available(SV.hashed_vectors(SV.read_stream(spark, src, SCHEMAS["documents"]), 16), sink)
    got = {r["doc_id"]: r["embedding"] for r in spark.read.parquet(sink).collect()}
    want = {r["doc_id"]: r["embedding"] for r in
            encode_hashed(spark.read.parquet(table_path(sf_dir, "documents")), 16).collect()}
    assert got == want


def test_stream_pluggable_encoder(spark, sf_dir):
    from vectorloom.operators.encode import HashedEncoder, encode
    src = local_dir_of(scratch_path(spark, "stream-v1"))
    os.makedirs(src)
    shutil.copy(table_path(sf_dir, "documents"), os.path.join(src, "part-0.parquet"))
    sink = scratch_path(spark, "stream-v1-out")
    stream = SV.read_stream(spark, src, SCHEMAS["documents"])
    SV.run_available(SV.encoded_vectors(stream, HashedEncoder(16), dimension=8), sink)
    got = {r["doc_id"]: r["embedding"] for r in spark.read.parquet(sink).collect()}
    docs = spark.read.parquet(table_path(sf_dir, "documents"))
    want = {r["doc_id"]: r["embedding"] for r in encode(docs, HashedEncoder(16), dimension=8,
                                                         normalize=True).collect()}
    assert got == want
