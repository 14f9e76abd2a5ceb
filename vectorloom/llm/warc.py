"""WARC archives of captured pages and an external merge of their index.

Pages whose payloads (at least ``REVISIT_BYTES``) are equal are stored once:
the largest page_id is the response, the others are revisit records that refer to
it. The archives are written with Spark's own text writer, so any file system
the cluster has will do: each row is a segment, each file one
segment. A segment holds one gzip member per record, so a reader that seeks to a capture's offset inflates that
record alone. The archives are read back as files, member by member, and parsed by Content-Length.

The index is an external merge sort. A task sorts the captures of its archives
by URL key and timestamp into front-coded runs; runs meet in key-range
buckets, where LCP loser trees merge them (``merge``). Buckets follow one
another in key order, so the capture history is globally ordered, and the
split keys carry the page id, so one hot URL spans buckets.

Defined results: null html is an empty payload (a response); a null url is
stored as ``urn:missing``; rows that repeat a page_id and a payload are the same
capture, so each is a response if its id is the largest; null ids count as smallest, and
are never referred to by a number; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import struct
import uuid
import zlib
from datetime import datetime, timedelta, timezone
from typing import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.llm.common import map_rows, materialize, text_bytes
from vectorloom.llm.merge import BLOCKS, blocks, merged
from vectorloom.session import scratch_path

#: Payloads from this size on are stored once.
REVISIT_BYTES = 1000
#: Compressed bytes from which an archive file is full; a longer record has a file of its own.
SEGMENT_BYTES = 16 << 20
#: Compressed bytes inflated at a time, so that what follows a member is copied once and in small pieces.
INFLATE_BYTES = 16 << 10
#: Digests that hold more than one in this many of the repeated captures are broadcast; fewer than this many can.
HEAVY_DIGESTS = 10_000
#: Captures sorted into one run.
RUN_ENTRIES = 50_000
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
NULL_ID = 1 << 64

_CRLF = b"\r\n"


def record_id(page_id: int | None) -> str:
    """A URN that carries the page id, null included."""
    return f"<urn:uuid:{uuid.UUID(int=(0x76ec << 112) | (NULL_ID if page_id is None else page_id & (NULL_ID - 1)))}>"


def page_of(record: str) -> int | None:
    value = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int & ((1 << 112) - 1)
    if value >= NULL_ID:
        return None
    return value - (1 << 64) if value >> 63 else value


def capture_time(page_id: int | None) -> str:
    """The capture's WARC-Date; the pages have none, so it follows from the id."""
    return (EPOCH + timedelta(seconds=(page_id or 0) % (10 ** 8))).strftime("%Y-%m-%dT%H:%M:%SZ")


def clean_url(url: str | None) -> str:
    """The url as one header value: control characters and spaces percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:missing"


def url_key(url: str) -> str:
    """Sort-friendly key: host labels reversed, then path and query, lower-cased, without fragment and ``www``."""
    scheme, sep, rest = url.partition("://")
    if not sep:
        return url.lower()
    rest = rest.partition("#")[0]
    m = re.match(r"([^/?]*)(.*)", rest, re.S)
    host = m[1].rpartition("@")[2].partition(":")[0].lower().removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (m[2].lower().rstrip("/") or "/")


def record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers: bool, to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit carries the HTTP header only."""
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload))
    block = http if refers else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: {record_id(page_id)}",
            f"WARC-Target-URI: {clean_url(url)}", f"WARC-Date: {capture_time(page_id)}",
            f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}"]
    if refers:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {record_id(to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(archive: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of every record of an uncompressed archive."""
    at = 0
    while at < len(archive):
        end = archive.index(b"\r\n\r\n", at)
        lines = archive[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
        size = int(headers["content-length"])
        stop = end + 4 + size
        if archive[stop:stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end where its length says")
        yield at, stop + 4 - at, headers, archive[end + 4:stop]
        at = stop + 4


def member(data: bytes) -> bytes:
    """One gzip member that ends with a zero byte, the line separator of the text writer.

    A member ends with the high byte of its length, which is zero below 16 MiB; a longer
    one is followed by an empty member.
    """
    out = gzip.compress(data, 6, mtime=0)
    return out if out[-1] == 0 else out + gzip.compress(b"", mtime=0)


def members(archive: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, inflated bytes) of every gzip member, empty ones left out."""
    view, at = memoryview(archive), 0
    while at < len(view):
        inflate, parts, stop = zlib.decompressobj(wbits=31), [], at
        while not inflate.eof:
            piece = view[stop:stop + INFLATE_BYTES]
            if not piece:
                raise ValueError(f"the member at byte {at} is cut off")
            parts.append(inflate.decompress(piece))
            stop += len(piece) - len(inflate.unused_data)
        if data := b"".join(parts):
            yield at, stop - at, data
        at = stop


def stored_once(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, refers, to: which captures revisit which.

    Payloads under the limit join nothing. A digest that holds more than one in ``HEAVY_DIGESTS``
    of all repeated captures is looked up in a broadcast table, which by its definition has fewer
    rows than that; so no key of the shuffled join holds more. Captures that have
    nothing to look up there are spread by their own hash.
    """
    rows = pages.select("page_id", "url", text_bytes("html").alias("payload")).withColumn("digest", F.sha1("payload"))
    long_enough = F.octet_length("payload") >= REVISIT_BYTES
    first = materialize(rows.filter(long_enough).groupBy("digest").agg(F.max("page_id").alias("to"), F.count(F.lit(1)).alias("n"))
                        .filter("n > 1"), "warc-repeats")
    total = first.agg(F.sum("n")).first()[0] or 0
    heavy = F.col("n") * HEAVY_DIGESTS > F.lit(total)
    often = first.filter(heavy).select(F.col("digest").alias("often_digest"), F.col("to").alias("often_to"), F.lit(True).alias("often"))
    seldom = first.filter(~heavy).select(F.col("digest").alias("key"), F.col("to").alias("seldom_to"))
    known = rows.join(F.broadcast(often), F.when(long_enough, F.col("digest")) == F.col("often_digest"), "left")
    own = F.concat(F.lit("#"), F.xxhash64("page_id", "url", "digest").cast("string"))
    joined = known.withColumn("key", F.when(long_enough & F.col("often").isNull(), F.col("digest")).otherwise(own)).join(seldom, "key", "left")
    to = F.coalesce("often_to", "seldom_to")
    refers = to.isNotNull() & ~F.col("page_id").eqNullSafe(to)
    return joined.select("page_id", "url", "payload", refers.alias("refers"), F.when(refers, to).alias("to"))


def write_archives(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write the captures as files of gzip members, one per record.

    The text writer writes the bytes it is given and names the files ``*.txt``.
    """
    def segments(batches: Iterator[dict]) -> Iterator[dict]:
        held, size = [], 0
        for b in batches:
            for page_id, url, payload, refers, to in zip(*(b[c].to_pylist() for c in ("page_id", "url", "payload", "refers", "to"))):
                held.append(member(record(page_id, url, payload, hashlib.sha1(payload).digest(), refers, to)))
                size += len(held[-1])
                if size >= segment_bytes:
                    yield {"value": [b"".join(held)[:-1]]}   # the writer ends the row with the last zero byte
                    held, size = [], 0
        if held:
            yield {"value": [b"".join(held)[:-1]]}

    rows = map_rows(stored_once(pages), segments, "value binary")
    (rows.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("compression", "none")
     .option("maxRecordsPerFile", 1).text(path))


_FACTS = struct.Struct("<?qq?q20sqq")


def _pack(page: int | None, full: int, revisit: bool, to: int | None, digest: bytes, offset: int, length: int, file: str) -> bytes:
    return _FACTS.pack(page is None, page or 0, full, revisit, to or 0, digest, offset, length) + file.encode()


def capture_runs(spark, path: str) -> DataFrame:
    """Read the archives back: sorted runs of (url key, timestamp, page id) with each capture's facts."""
    def read(batches: Iterator[dict]) -> Iterator[dict]:
        number = TaskContext.get().partitionId() << 32
        entries: list[tuple[bytes, bytes]] = []
        for b in batches:
            for file, content in zip(b["path"].to_pylist(), b["content"].to_pylist()):
                for offset, length, headers, block in ((o, n, *r[2:]) for o, n, data in members(content) for r in parse(data)):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    full = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:"))
                    revisit = headers["warc-type"] == "revisit"
                    if not revisit and (len(payload) != full or hashlib.sha1(payload).digest() != digest):
                        raise ValueError(f"{file}, byte {offset}: the payload is not the one recorded")
                    page, to = page_of(headers["warc-record-id"]), None
                    if revisit:
                        to = page_of(headers["warc-refers-to"])
                    date = re.sub(r"\D", "", headers["warc-date"])
                    key = f"{url_key(headers['warc-target-uri'])} {date} ".encode() + struct.pack(">Q", (page or 0) + (1 << 63))
                    entries.append((key, _pack(page, full, revisit, to, digest, offset, length, file.rpartition("/")[2])))
            if len(entries) >= RUN_ENTRIES:
                yield blocks(entries, number)
                entries, number = [], number + 1
        if entries:
            yield blocks(entries, number)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return materialize(map_rows(files, read, BLOCKS), "capture-runs")


HISTORY = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
           "url_key string, capture string, bucket int, position long, archive string, offset long, length long")


def _history(bucket: int, entries: Iterator[tuple[int, bytes, bytes]]) -> Iterator[dict]:
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture",
             "bucket", "position", "archive", "offset", "length")
    rows: list[tuple] = []
    for position, (_, key, payload) in enumerate(entries):
        no_id, page, full, revisit, to, digest, offset, length = _FACTS.unpack_from(payload)
        url, _, stamp = key[:-9].decode().rpartition(" ")
        rows.append((None if no_id else page, full, digest.hex(), "revisit" if revisit else "response",
                     to if revisit else None, url, stamp, bucket, position, payload[_FACTS.size:].decode(), offset, length))
        if len(rows) >= 4096:
            yield dict(zip(names, map(list, zip(*rows))))
            rows = []
    if rows:
        yield dict(zip(names, map(list, zip(*rows))))


def capture_history(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the pages' archives to ``path``, read them back, and merge their index.

    One row per capture; (bucket, position) is its place in the global order by
    URL key, timestamp and page id. ``offset`` and ``length`` are those of the capture's gzip
    member in its ``archive`` file.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "llm-warc")
    write_archives(pages, path)
    return merged(capture_runs(spark, path), _history, HISTORY)


def ordered_history(pages: DataFrame, path: str | None = None) -> DataFrame:
    """``capture_history`` with ``place``, the capture's number in the whole history, from 0.

    The history is written once; the rows before a bucket come from the counts of the
    buckets, of which there are at most ``merge.MAX_BUCKETS``.
    """
    history = materialize(capture_history(pages, path), "warc-history")
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (history.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
               .select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier")))
    return (history.join(F.broadcast(offsets), "bucket")
            .withColumn("place", (F.col("earlier") + F.col("position")).cast("long")).drop("earlier"))
