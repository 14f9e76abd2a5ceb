"""Line dedup: keep each repeated line only in the smallest document that holds it.

Range-partitioned line hashes, secondary sort by document and position, first
occurrences streamed; the result that travels back to the texts is one
compressed keep bitmap per document, never text.

1. Every line of at least ``MIN_CODEPOINTS`` normalised code points becomes
   ``(128-bit key hash, doc_id, text hash, position, line count)``.
2. The rows are range-partitioned on hash, document and position and sorted
   within partitions. The composite range splits a line that fills a third of
   the corpus over many partitions.
3. One streaming pass per partition holds a single run's first document. A run
   that begins inside a partition has its first document there, so its lines
   are decided at once. Only the run a partition starts with may have begun next
   door; its rows are decided against the smallest document of the key over
   all partitions' first and last runs (at most two keys per partition).
4. The dropped positions are gathered per document into a zlib-compressed
   bitmap (bit 1: keep).

Defined results: null or empty text is one empty line; lines shorter than the
minimum, and empty documents, are never dropped; a null doc_id counts as larger than
every id; rows that repeat a doc_id are the same document for the
"two documents" test, each row judged line by line; extra columns are carried
unchanged; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from typing import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.common import ASCII_SPACE, few, free_name, map_rows, materialize, scan_tasks, signed, text_bytes

#: Shortest key, in code points, that is deduplicated.
MIN_CODEPOINTS = 10

_TWO64 = (1 << 64) - 1


def line_key(line: bytes) -> bytes:
    """Strip ASCII white space at both ends and lower-case A-Z."""
    return line.strip(ASCII_SPACE).lower()


def long_enough(key: bytes) -> bool:
    n = len(key)
    return n >= MIN_CODEPOINTS and (n >= 4 * MIN_CODEPOINTS or len(key.decode("utf-8", "replace")) >= MIN_CODEPOINTS)


def line_hashes(docs: DataFrame) -> DataFrame:
    """(hi, lo, null_id, doc_id, tkey, pos, n_lines) per line that takes part."""
    def explode(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            hi, lo, null_id, ids, tkeys, pos, n_lines = [], [], [], [], [], [], []
            for doc_id, tkey, text in zip(b["doc_id"].to_pylist(), b["tkey"].to_pylist(), b["text"].to_pylist()):
                lines = text.split(b"\n")
                for p, line in enumerate(lines):
                    key = line_key(line)
                    if long_enough(key):
                        h = xxhash.xxh3_128_intdigest(key)
                        hi.append(signed(h >> 64))
                        lo.append(signed(h & _TWO64))
                        null_id.append(doc_id is None)
                        ids.append(doc_id)
                        tkeys.append(tkey)
                        pos.append(p)
                        n_lines.append(len(lines))
            yield {"hi": hi, "lo": lo, "null_id": null_id, "doc_id": ids, "tkey": tkeys, "pos": pos, "n_lines": n_lines}

    rows = docs.select("doc_id", F.xxhash64("text").alias("tkey"), text_bytes().alias("text"))
    return map_rows(rows, explode, "hi long, lo long, null_id boolean, doc_id long, tkey long, pos int, n_lines int")


#: What a streamed row stands for: a line to drop; a row of the run a partition starts with,
#: which may have begun next door; the first row of the run a partition ends with.
DROP, HEAD, TAIL = 0, 1, 2


def _stream(batches: Iterator[dict]) -> Iterator[dict]:
    """Dropped lines, the rows of the partition's first run, and the first row of its last run."""
    names = ("hi", "lo", "null_id", "doc_id", "tkey", "pos", "n_lines")
    key = first = None
    runs = 0
    for b in batches:
        done: list[tuple] = []
        for row in zip(*(b[n].to_pylist() for n in names)):
            if row[:2] != key:
                key, first = row[:2], row
                runs += 1
            if runs == 1:
                done.append((*row, HEAD))
            elif row[2:4] != first[2:4]:
                done.append((*row, DROP))
        if done:
            yield dict(zip((*names, "kind"), map(list, zip(*done))))
    if runs > 1:
        yield {n: [v] for n, v in zip((*names, "kind"), (*first, TAIL))}


def keep_bitmaps(docs: DataFrame) -> DataFrame:
    """(doc_id, tkey, n_dropped, bitmap) per document that loses a line; ``bitmap`` is
    zlib-compressed, one bit per line in little-endian bit order, 1 = keep."""
    n = scan_tasks(docs.sparkSession)
    names = ["hi", "lo", "null_id", "doc_id", "tkey", "pos"]
    hashes = line_hashes(docs)
    runs = hashes.repartitionByRange(n, *names).sortWithinPartitions(*names)
    judged = materialize(few(map_rows(runs, _stream, hashes.schema.simpleString()[7:-1].replace(":", " ") + ", kind int"),
                             docs.count()), "line-runs")
    # At most two keys per range partition, pre-aggregated per task: small enough to broadcast at any size.
    firsts = (judged.filter(F.col("kind") != DROP).groupBy("hi", "lo")
              .agg(F.min(F.struct("null_id", "doc_id")).alias("first")))
    heads = (judged.filter(F.col("kind") == HEAD).join(F.broadcast(firsts), ["hi", "lo"])
             .filter(~(F.struct("null_id", "doc_id").eqNullSafe(F.col("first")))))
    columns = ["doc_id", "tkey", "pos", "n_lines"]
    dropped = judged.filter(F.col("kind") == DROP).select(columns).unionByName(heads.select(columns))
    per_doc = (dropped.groupBy("doc_id", "tkey")
               .agg(F.collect_set("pos").alias("pos"), F.max("n_lines").alias("n_lines")))

    @F.pandas_udf("binary")
    def pack(pos: pd.Series, n_lines: pd.Series) -> pd.Series:
        def one(p, size):
            bits = np.ones(size, dtype=np.uint8)
            bits[np.asarray(p, dtype=np.int64)] = 0
            return zlib.compress(np.packbits(bits, bitorder="little").tobytes())
        return pd.Series([one(p, s) for p, s in zip(pos, n_lines)], dtype=object)

    return per_doc.select("doc_id", "tkey", F.size("pos").cast("long").alias("n_dropped"),
                          pack("pos", "n_lines").alias("bitmap"))


def _with_bitmaps(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with its keep bitmap (null: keep everything) and dropped count, and these columns' names."""
    doc, key, dropped, bitmap = (free_name(docs.columns, f"keep_{n}") for n in ("doc", "tkey", "dropped", "bitmap"))
    small = keep_bitmaps(docs.select("doc_id", "text")).select(
        F.col("doc_id").alias(doc), F.col("tkey").alias(key), F.col("n_dropped").alias(dropped), F.col("bitmap").alias(bitmap))
    on = docs["doc_id"].eqNullSafe(small[doc]) & (F.xxhash64(docs["text"]) == small[key])
    return docs.join(small.hint("shuffle_hash"), on, "left").drop(doc, key), bitmap, dropped


def kept_text(text: bytes, bitmap: bytes | None) -> bytes:
    if bitmap is None:
        return text
    lines = text.split(b"\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8), bitorder="little")
    return b"\n".join(line for line, bit in zip(lines, bits) if bit)


def dedup_lines(docs: DataFrame, drop_emptied: bool = False) -> DataFrame:
    """``docs`` with the dropped lines gone from ``text`` (and ``n_chars`` renewed, if present).

    ``drop_emptied``: documents that lose lines and keep nothing but white space go.
    """
    @F.pandas_udf("string")
    def rewrite(text: pd.Series, bitmap: pd.Series) -> pd.Series:
        return pd.Series([kept_text(bytes(t), b).decode("utf-8", "replace") for t, b in zip(text, bitmap)], dtype=object)

    joined, bitmap, _ = _with_bitmaps(docs)
    whole = F.col(bitmap).isNull()
    out = joined.withColumn("text", F.when(whole, F.col("text")).otherwise(rewrite(text_bytes(), F.col(bitmap))))
    if drop_emptied:
        out = out.filter(whole | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(whole, F.col("n_chars"))
                             .otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return few(out.select(*docs.columns), docs.count())


def line_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines (before), n_dropped, kept_sha256 per document."""
    def digest(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            n_lines, sha = [], []
            for text, bitmap in zip(b["text"].to_pylist(), b["bitmap"].to_pylist()):
                n_lines.append(text.count(b"\n") + 1)
                sha.append(hashlib.sha256(kept_text(text, bitmap)).hexdigest())
            yield {"doc_id": b["doc_id"], "n_lines": n_lines, "n_dropped": b["n_dropped"], "kept_sha256": sha}

    joined, bitmap, dropped = _with_bitmaps(docs.select("doc_id", "text"))
    rows = joined.select("doc_id", text_bytes().alias("text"), F.coalesce(dropped, F.lit(0)).cast("long").alias("n_dropped"),
                         F.col(bitmap).alias("bitmap"))
    return map_rows(rows, digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


__all__ = ["dedup_lines", "keep_bitmaps", "line_digest", "line_hashes", "line_key"]
