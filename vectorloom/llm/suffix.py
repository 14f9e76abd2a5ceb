"""Suffix-array dedup: drop every byte covered by a 200-byte string that also starts elsewhere.

Sorting every suffix of a corpus is out of proportion, so the suffixes that
can matter are found first, exactly:

1. Anchors. Among the ``GRAM``-byte grams inside any 200-byte string, the one
   with the smallest hash (rightmost among equals) is its anchor. The choice
   depends on the string alone, so two equal strings have equal anchors at
   equal offsets. An anchor serves a stretch of consecutive string starts;
   the bytes of those strings are its context.
2. Anchors are range-sorted by gram hash and context hash. A gram that occurs once is
   done: nothing repeats there. Contexts that occur whole more than once are repeats
   from end to end. Grams with several different contexts need their suffixes compared.
3. Those suffixes (200 bytes from the anchor, with the bytes left of it as payload) become
   front-coded sorted runs, exchanged by key range and merged with LCP loser
   trees (``merge``). Around each suffix, the merge's shared-prefix lengths give its
   longest match to the right with every other suffix of the gram; the match to the left
   is read off the payloads. A pair whose two matches sum to 200 bytes or more repeats.
4. Grams with more than ``PAIRED`` contexts, and grams at the edge of a merge bucket (they may
   continue next door), are not paired. Each suffix is compared with the one before it in the merged
   order; strings the two share are repeats, the other 200-byte strings are hashed (128 bits) and
   counted, which is linear in their number.
5. The found byte ranges go back to the texts.

Defined results: null text is empty; texts under 200 bytes lose nothing; a
string repeated inside one document counts, overlaps included; rows repeated in full
repeat each other; null doc_ids are carried; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import struct
from typing import Iterator

import numpy as np
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.common import map_rows, materialize, scan_tasks, signed, text_bytes
from vectorloom.llm.merge import BLOCKS, blocks, common_prefix, merged

LENGTH = 200
GRAM = 48
#: Grams in a 200-byte string.
SPAN = LENGTH - GRAM + 1
#: Contexts of one gram compared pair by pair; more are hashed and counted.
PAIRED = 48
#: Suffixes sorted into one run.
RUN_ENTRIES = 32_768
#: Positions handled at once, so a long text needs bounded memory.
CHUNK = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_META = struct.Struct("<qiHH")   # rid, anchor position, bytes before it of the first and of the last string


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n - 1, base, dtype=np.uint64)])


_UP = _powers(_BASE, CHUNK + 2 * LENGTH)
_DOWN = _powers(_INVERSE, CHUNK + 2 * LENGTH)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Mixed rolling hash of every ``size``-byte gram of at most CHUNK + 2 * LENGTH bytes."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[:n], out=sums[1:])
    return _mix((sums[size:] - sums[:-size]) * _DOWN[:n - size + 1])


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    done, out = 1, values
    while done * 2 <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    return np.minimum(out[:len(values) - width + 1], out[width - done:][:len(values) - width + 1]) if done < width else out


def anchors(text: bytes) -> list[tuple[int, int, int, int]]:
    """(gram hash, anchor, first start, last start) of every stretch of string starts with one anchor."""
    data = np.frombuffer(text, dtype=np.uint8)
    n = len(data) - LENGTH + 1
    where, starts, hashes = [], [], []
    for c in range(0, max(n, 0), CHUNK):
        m = min(CHUNK, n - c)
        h = gram_hashes(data[c:c + m + LENGTH - 1], GRAM)
        low = np.uint64(0xFFFFFF)
        # 40 bits of hash, then the position counted from the right: the least is the rightmost smallest.
        packed = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
        least = (low - (_smallest(packed, SPAN) & low)).astype(np.int64)
        new = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        where.append(least[new] + c)
        starts.append(new + c)
        hashes.append(h[least[new]])
    if not where:
        return []
    where, starts, hashes = map(np.concatenate, (where, starts, hashes))
    same = np.r_[False, where[1:] == where[:-1]]     # a stretch cut by a chunk
    where, starts, hashes = where[~same], starts[~same], hashes[~same]
    ends = np.r_[starts[1:], n] - 1
    return list(zip(hashes.view(np.int64).tolist(), where.tolist(), starts.tolist(), ends.tolist()))


def with_rid(docs: DataFrame) -> DataFrame:
    """doc_id, rid (hash of id and text, the row's name in all exchanges), text as bytes."""
    return docs.select("doc_id", F.xxhash64("doc_id", "text", F.lit("row")).alias("rid"), text_bytes().alias("text"))


ANCHORS = "gram long, context long, rid long, anchor int, before int, after int"


def anchor_rows(rows: DataFrame) -> DataFrame:
    """One row per anchor; ``before``/``after``: bytes from its first/last string start to the anchor."""
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out = {k: [] for k in ("gram", "context", "rid", "anchor", "before", "after")}
            for rid, text in zip(b["rid"].to_pylist(), b["text"].to_pylist()):
                for h, at, first, last in anchors(text):
                    out["gram"].append(h)
                    out["context"].append(signed(xxhash.xxh3_64_intdigest(text[first:last + LENGTH]) ^ (at - first)))
                    out["rid"].append(rid)
                    out["anchor"].append(at)
                    out["before"].append(at - first)
                    out["after"].append(at - last)
            yield out

    return map_rows(rows.select("rid", "text"), run, ANCHORS)


#: A streamed anchor: its whole context repeats; its suffix is to be compared.
WHOLE, COMPARE = 0, 1


def _judge(batches: Iterator[dict]) -> Iterator[dict]:
    """Stream anchors sorted by gram and context; see the module text, step 2.

    A partition's first and last gram may have rows next door, so all their
    contexts are compared as suffixes.
    """
    names = ("gram", "context", "rid", "anchor", "before", "after")
    gram = context = None
    grams = 0
    held = None              # first row of the current context, not yet sent to COMPARE
    waiting = None           # first context's row of a gram that has one context so far
    single = True            # the current context has one row so far
    for b in batches:
        done: list[tuple] = []
        for row in zip(*(b[n].to_pylist() for n in names)):
            if row[0] != gram:
                gram, context, grams = row[0], row[1], grams + 1
                held, single = row, True
                if grams == 1:
                    done.append((*row[2:], COMPARE))
                    waiting = None
                else:
                    waiting = row
            elif row[1] != context:
                context, held, single = row[1], row, True
                if waiting is not None:
                    done.append((*waiting[2:], COMPARE))
                    waiting = None
                done.append((*row[2:], COMPARE))
            else:
                if single:
                    done.append((*held[2:], WHOLE))
                    single = False
                done.append((*row[2:], WHOLE))
        if done:
            yield dict(zip((*names[2:], "kind"), map(list, zip(*done))))
    if waiting is not None:
        yield {n: [v] for n, v in zip((*names[2:], "kind"), (*waiting[2:], COMPARE))}


def judged_anchors(rows: DataFrame) -> DataFrame:
    order = ["gram", "context", "rid", "anchor"]
    dealt = (anchor_rows(rows).repartitionByRange(scan_tasks(rows.sparkSession), *order).sortWithinPartitions(*order))
    return materialize(map_rows(dealt, _judge, "rid long, anchor int, before int, after int, kind int"), "anchors")


def suffix_runs(rows: DataFrame, compare: DataFrame) -> DataFrame:
    """Front-coded sorted runs of the suffixes at ``compare``'s anchors.

    Key: up to 200 bytes from the anchor, then the row's name and the anchor's position, so that
    equal suffixes can be split over buckets. Payload: name, position, the
    strings it serves, the key's text length, and the bytes left of the anchor.
    """
    wanted = compare.groupBy("rid").agg(F.collect_set(F.struct("anchor", "before", "after")).alias("at"))
    joined = rows.select("rid", "text").join(wanted.hint("shuffle_hash"), "rid")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        number = TaskContext.get().partitionId() << 32
        entries: list[tuple[bytes, bytes]] = []
        for b in batches:
            for rid, text, ats in zip(b["rid"].to_pylist(), b["text"].to_pylist(), b["at"].to_pylist()):
                for a in ats:
                    p = a["anchor"]
                    right, left = text[p:p + LENGTH], text[p - a["before"]:p]
                    entries.append((right + struct.pack(">qI", rid, p), _pack(rid, p, a["before"], a["after"], right, left)))
            if len(entries) >= RUN_ENTRIES:
                yield blocks(entries, number)
                entries, number = [], number + 1
        if entries:
            yield blocks(entries, number)

    return materialize(map_rows(joined, run, BLOCKS), "suffix-runs")


def _pack(rid: int, p: int, before: int, after: int, right: bytes, left: bytes) -> bytes:
    return _META.pack(rid, p, before, after) + bytes([len(right)]) + left


def _unpack(payload: bytes) -> tuple[int, int, int, int, int, bytes]:
    rid, p, before, after = _META.unpack_from(payload)
    return rid, p, before, after, payload[_META.size], payload[_META.size + 1:]


def _common_suffix(a: bytes, b: bytes) -> int:
    return common_prefix(a[::-1], b[::-1])


def _pairs(group: list[tuple]) -> Iterator[tuple]:
    """(rid, from, to) of the repeats of one gram; ``group``: (shared with the one before, suffix, meta)."""
    reach: dict[int, tuple[int, int]] = {}
    for i in range(len(group)):
        shared = LENGTH
        for j in range(i + 1, len(group)):
            shared = min(shared, group[j][0])
            a, b = group[i][2], group[j][2]
            right = min(shared, a[4], b[4])
            left = _common_suffix(a[5], b[5])
            if left + right >= LENGTH:
                for k in (i, j):
                    l0, r0 = reach.get(k, (0, 0))
                    reach[k] = max(l0, left), max(r0, right)
    for i, (left, right) in reach.items():
        rid, p = group[i][2][:2]
        yield rid, p - left, p + right, None, None


def _against(before: tuple | None, entry: tuple) -> Iterator[tuple]:
    """A suffix of a gram that is not paired: its match with the suffix before it, and its other strings, hashed.

    A string that the suffix before has as well is a repeat of both and is not hashed again: its first
    holder in this order was, so every distinct string stands for itself at least once.
    """
    rid, p, first, last, length, left = entry[2]
    low = high = None
    if before is not None:
        other = before[2]
        right, back = min(entry[0], length, other[4]), _common_suffix(left, other[5])
        if back + right >= LENGTH:
            low, high = p - back, p + right - LENGTH
            yield rid, low, high + LENGTH, None, None
            yield other[0], other[1] - back, other[1] + right, None, None
    text = left + entry[1][:length]
    for start in range(p - first, p - last + 1):
        if low is None or not low <= start <= high:
            at = start - p + first
            h = xxhash.xxh3_128_intdigest(text[at:at + LENGTH])
            yield rid, start, start + LENGTH, signed(h >> 64), signed(h & _MASK)


def _repeats(bucket: int, entries: Iterator[tuple[int, bytes, bytes]]) -> Iterator[dict]:
    """Repeats of a merge bucket; a gram's suffixes follow one another in it.

    Only the first and the last gram of a bucket may reach into another one.
    """
    out: list[tuple] = []
    group: list[tuple] = []      # the gram's suffixes while they may still be paired
    before, wide = None, True    # the suffix before, and whether the gram is not paired

    def batch() -> dict:
        rows = list(out)
        out.clear()
        return dict(zip(("rid", "from", "to", "hi", "lo"), map(list, zip(*rows))))

    def in_order(suffixes: list[tuple]) -> None:
        nonlocal before
        for e in suffixes:
            out.extend(_against(before, e))
            before = e

    for shared, key, payload in entries:
        if shared < GRAM and (group or before):
            out.extend(_pairs(group))
            group, before, wide = [], None, False
        group.append((shared, key, _unpack(payload)))
        if wide or len(group) > PAIRED:
            wide = True
            in_order(group)
            group = []
        if len(out) >= 4096:
            yield batch()
    in_order(group)
    if out:
        yield batch()


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """rid, from, to: byte ranges, maybe overlapping, whose bytes are all to go."""
    rows = with_rid(docs)
    judged = judged_anchors(rows)
    whole = (judged.filter(F.col("kind") == WHOLE)
             .select("rid", (F.col("anchor") - F.col("before")).alias("from"),
                     (F.col("anchor") - F.col("after") + LENGTH).alias("to")))
    runs = suffix_runs(rows, judged.filter(F.col("kind") == COMPARE))
    found = materialize(merged(runs, _repeats, "rid long, `from` int, `to` int, hi long, lo long"), "repeats")
    ranges = found.filter("hi is null").select("rid", "from", "to")
    strings = found.filter("hi is not null")
    # Copies of a string inside a task are pre-counted; only keys that repeat go on.
    twice = strings.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hi", "lo")
    counted = strings.join(twice, ["hi", "lo"]).select("rid", "from", "to")
    return whole.unionByName(ranges).unionByName(counted)


def covered(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union; ranges that touch make one run."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in spans:
        parts.append(text[at:a])
        at = b
    return b"".join([*parts, text[at:]])


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, spans (array of from/to), kept (bytes), n_bytes per document."""
    spans = repeated_ranges(docs).groupBy("rid").agg(F.collect_set(F.struct("from", "to")).alias("ranges"))
    joined = with_rid(docs).join(spans.hint("shuffle_hash"), "rid", "left").select("doc_id", "text", "ranges")

    def apply(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out = {k: [] for k in ("n_bytes", "spans", "kept")}
            for text, ranges in zip(b["text"].to_pylist(), b["ranges"].to_pylist()):
                found = covered([(r["from"], r["to"]) for r in ranges or ()])
                for k, v in zip(out, (len(text), [{"from": a, "to": e} for a, e in found], kept_bytes(text, found))):
                    out[k].append(v)
            yield {"doc_id": b["doc_id"], **out}

    return map_rows(joined, apply, "doc_id long, n_bytes long, spans array<struct<`from`:int,`to`:int>>, kept binary")


def suffix_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    out = suffix_dedup(docs)
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


__all__ = ["anchors", "covered", "repeated_ranges", "suffix_dedup", "suffix_digest"]
