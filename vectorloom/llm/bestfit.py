"""Best-fit packing in bulk-synchronous rounds: sorted documents and gaps, distributed successor sweeps.

1. Documents become token ids, cut into pieces of at most ``SEQUENCE`` ids: whole sequences from the end, the
   rest in front. The pieces, ids included, are written once; a piece that fills a sequence is one. Only
   (piece number, length) of the rests takes part in what follows.
2. A round sorts the open gaps and the unplaced pieces together by range, longest first, a gap before
   the pieces of its own length. Going down, the gap nearest above a piece is the last one passed: each range
   partition sweeps with a stack, so a piece takes the smallest gap that is left for it. A gap of at least twice
   the longest unplaced piece offers several places at once.
3. What a partition could not settle are pieces that came before any of its gaps, and gaps that none took.
   Their counts, one row per partition, give by the same stack which ranks of left pieces meet which ranks of
   left gaps; left rows of both kinds are joined on (partition, rank). No two pieces get one place.
4. Gaps shrink by what they took, and the next round begins. Pieces longer than every gap can only go to new
   sequences: ``OPENING`` of the number that their total calls for (and one for each piece above half a
   sequence) joins the gaps of the next round, empty; the last few hundredths are opened at once.
5. In the end a window over each sequence (at most ``SEQUENCE`` rows) gives the offsets.

A round's state is one written table: open gaps, unplaced pieces, and what the round placed. The driver holds
counts by length (at most ``SEQUENCE`` per kind) and by partition.

Defined results: null, empty and white-space texts are what the tokenizer makes of them and the end id; repeated
rows are packed as often as they occur; null doc_ids are carried; extra columns are ignored; pieces of one length are
told apart by their number; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import math
import re
import zlib
from typing import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vectorloom.llm.common import map_rows, materialize, remove_scratch, scan_tasks, written

SEQUENCE = 1024
#: The id that ends a document.
END = 2
#: Share of the sequences that unplaceable pieces call for that a round opens; all at once below SMALL of those open.
OPENING, SMALL = 0.67, 0.02
#: Rows of a sweep's partition: at most, and at least where there are several.
MOST_ROWS, FEW_ROWS = 1 << 20, 1 << 12
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"

GAP, PIECE, PLACED = 0, 1, 2

# Letters, digits and spaces of these blocks are classed alike by every library.
_ODD = re.compile(r"[^\x00-ɏ‐-‧]")
#: Runs from twice these lengths on, of other characters and of white space, go to the tokenizer itself.
LONG_RUN, LONG_SPACE = 1000, 100


def unusual(text: str) -> bool:
    """Whether the text holds a character outside the blocks or a very long run."""
    return bool(_ODD.search(text)) \
        or any(text.find(" ", i, i + LONG_RUN) < 0 and text.find("\n", i, i + LONG_RUN) < 0 for i in range(0, len(text) - LONG_RUN, LONG_RUN)) \
        or any(text[i:i + LONG_SPACE].isspace() for i in range(0, len(text) - LONG_SPACE, LONG_SPACE))


class ByteTokens:
    """Ids of whole texts: the tokenizer's own, by way of its vocabulary as merge ranks where both agree."""

    def __init__(self, path: str | None = None, ranks: str | None = None):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.fast = None
        if path is None or ranks:
            with open(ranks or public_tokenizers.path(RANKS), "rb") as f:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    def ids(self, text: str | None) -> list[int]:
        text = text or ""
        if self.fast is None or unusual(text) or any(s in text for s in self.special):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


_LOADED: dict[tuple, ByteTokens] = {}


def byte_tokens(path: str | None = None, ranks: str | None = None) -> ByteTokens:
    if (path, ranks) not in _LOADED:
        _LOADED[path, ranks] = ByteTokens(path, ranks)
    return _LOADED[path, ranks]


def cut(n: int, sequence: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids; only the first may be short."""
    first = n % sequence or min(n, sequence)
    return [(0, first)] + [(s, sequence) for s in range(first, n, sequence)]


def pieces(docs: DataFrame, sequence: int = SEQUENCE, path: str | None = None) -> DataFrame:
    """number, doc_id, piece, start, length, ids_crc32, ids (uint16 bytes) per piece, written once."""
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        tokens = byte_tokens(path)
        number = TaskContext.get().partitionId() << 33
        for b in batches:
            out = {k: [] for k in ("number", "doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
                ids = np.array([*tokens.ids(text), END], dtype="<u4")
                for piece, (start, length) in enumerate(cut(len(ids), sequence)):
                    own = ids[start:start + length]
                    for k, v in zip(out, (number, doc_id, piece, start, length, zlib.crc32(own), own.astype("<u2").tobytes())):
                        out[k].append(v)
                    number += 1
            yield out

    return materialize(map_rows(docs.select("doc_id", "text"), run, "number long, doc_id long, piece int, start long, "
                                "length long, ids_crc32 long, ids binary"), "pieces")


class Counts:
    """What the driver knows of a round: gaps and unplaced pieces, counted by length."""

    def __init__(self, items: DataFrame):
        found = items.filter(F.col("kind") != PLACED).groupBy("kind", "size").agg(F.count(F.lit(1)).alias("n")).collect()
        self.gaps = {r["size"]: r["n"] for r in found if r["kind"] == GAP}
        self.pieces = {r["size"]: r["n"] for r in found if r["kind"] == PIECE}
        self.rows = sum(self.gaps.values()) + sum(self.pieces.values())
        self.longest, self.shortest = max(self.pieces, default=0), min(self.pieces, default=0)

    def to_open(self, sequence: int, opened: int, opening: float) -> int:
        """New sequences for the pieces that no gap can take."""
        widest = max(self.gaps, default=0)
        stuck = {s: n for s, n in self.pieces.items() if s > widest}
        need = -(-sum(s * n for s, n in stuck.items()) // sequence)
        some = need if need <= SMALL * opened else math.ceil(need * opening)
        return max(some, sum(n for s, n in stuck.items() if s > sequence // 2))


def _sweep(longest: int):
    """One range partition: pieces take the last gap passed; the rest comes out with its rank."""
    names = ("kind", "id", "size", "seq", "part", "rank")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        part = TaskContext.get().partitionId()
        stack: list[list[int]] = []     # [sequence, gap, places left]
        waiting = 0
        for b in batches:
            out: list[tuple] = []
            for kind, ident, size in zip(b["kind"].to_pylist(), b["id"].to_pylist(), b["size"].to_pylist()):
                if kind == GAP:
                    stack.append([ident, size, max(1, size // longest)])
                    out.append((GAP, ident, size, None, part, None))
                elif stack:
                    top = stack[-1]
                    out.append((PLACED, ident, size, top[0], part, None))
                    top[2] -= 1
                    if not top[2]:
                        stack.pop()
                else:
                    out.append((PIECE, ident, size, None, part, waiting))
                    waiting += 1
            if out:
                yield dict(zip(names, map(list, zip(*out))))
        rank, out = 0, []
        while stack:                    # places that none took, the smallest gap first
            ident, _, places = stack.pop()
            out.append((LEFT, ident, places, ident, part, rank))
            rank += places
            if len(out) == FEW_ROWS or not stack:
                yield dict(zip(names, map(list, zip(*out))))
                out = []

    return run


#: A gap with places left: ``size`` is their number, ``rank`` the first one's.
LEFT = 3


def meetings(left: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(piece partition, first rank, gap partition, first rank, how many) from (partition, left pieces, left places)."""
    stack: list[list[int]] = []         # [partition, first free rank, free]
    found = []
    for part, waiting, places in sorted(left):
        rank = 0
        while rank < waiting and stack:
            top = stack[-1]
            n = min(waiting - rank, top[2])
            found.append((part, rank, top[0], top[1], n))
            rank, top[1], top[2] = rank + n, top[1] + n, top[2] - n
            if not top[2]:
                stack.pop()
        if places:
            stack.append([part, 0, places])
    return found


def one_round(spark: SparkSession, items: DataFrame, counts: Counts, first_new: int, new: int, sequence: int) -> tuple[DataFrame, str]:
    """The next state: (kind, id, size, seq) with gaps, unplaced pieces, and the pieces placed in this round."""
    fresh = spark.range(first_new, first_new + new).select(F.lit(GAP).alias("kind"), "id", F.lit(sequence).cast("long").alias("size"))
    open_items = items.filter((F.col("kind") == PIECE) | ((F.col("kind") == GAP) & (F.col("size") >= counts.shortest)))
    rows = counts.rows + new
    tasks = max(-(-rows // MOST_ROWS), min(scan_tasks(spark), -(-rows // FEW_ROWS)))
    # Ties of length, however many, spread over partitions by kind and number.
    order = [F.col("size").desc(), F.col("kind"), F.col("id")]
    together = (open_items.select("kind", "id", "size").unionByName(fresh)
                .repartitionByRange(tasks, *order).sortWithinPartitions(*order))
    swept, path = written(map_rows(together, _sweep(counts.longest), "kind int, id long, size long, seq long, part int, rank long", FEW_ROWS), "sweep")
    summed = swept.filter(F.col("kind").isin(PIECE, LEFT)).groupBy("part").agg(
        F.sum(F.when(F.col("kind") == PIECE, 1).otherwise(0)).alias("pieces"),
        F.sum(F.when(F.col("kind") == LEFT, F.col("size")).otherwise(0)).alias("places")).collect()
    met = meetings([tuple(r) for r in summed])
    settled = swept.filter(F.col("kind") == PLACED).select("id", "size", "seq")
    waiting = swept.filter(F.col("kind") == PIECE).select("id", "size", "part", "rank")
    if met:
        # At most two rows per range partition.
        table = F.broadcast(spark.createDataFrame(met, "part int, low long, gap_part int, gap_low long, n long"))
        taken = (waiting.join(table, "part").filter("rank >= low and rank < low + n")
                 .select("id", "size", "gap_part", (F.col("rank") - F.col("low") + F.col("gap_low")).alias("place")))
        places = (swept.filter(F.col("kind") == LEFT).select("seq", F.col("part").alias("gap_part"), "rank", F.col("size").alias("places"))
                  .join(F.broadcast(table.groupBy("gap_part").agg(F.max(F.col("gap_low") + F.col("n")).alias("used"))), "gap_part")
                  .filter("rank < used")
                  .select("seq", "gap_part", F.explode(F.expr("sequence(rank, least(rank + places, used) - 1)")).alias("place")))
        settled = settled.unionByName(taken.join(places, ["gap_part", "place"]).select("id", "size", "seq"))
        done = table.groupBy("part").agg(F.max(F.col("low") + F.col("n")).alias("done"))
        waiting = waiting.join(F.broadcast(done), "part", "left").filter("done is null or rank >= done")
    gaps = (swept.filter(F.col("kind") == GAP).select(F.col("id").alias("seq"), "size")
            .unionByName(settled.select("seq", (-F.col("size")).alias("size")))
            .groupBy("seq").agg(F.sum("size").alias("size")).filter("size > 0"))
    none = F.lit(None).cast("long").alias("seq")
    state = (gaps.select(F.lit(GAP).alias("kind"), F.col("seq").alias("id"), "size", none)
             .unionByName(waiting.select(F.lit(PIECE).alias("kind"), "id", "size", none))
             .unionByName(settled.select(F.lit(PLACED).alias("kind"), "id", "size", "seq")))
    out = written(state, "round")
    remove_scratch(spark, path)
    return out


def best_fit(items: DataFrame, sequence: int = SEQUENCE, opening: float = OPENING) -> tuple[DataFrame, int]:
    """(id, size, seq) for every item (id, size below ``sequence``), and the number of sequences opened."""
    spark = items.sparkSession
    none = F.lit(None).cast("long").alias("seq")
    state = items.select(F.lit(PIECE).alias("kind"), "id", F.col("size").cast("long").alias("size"), none)
    placed, opened = [], 0
    while (counts := Counts(state)).pieces:
        new = counts.to_open(sequence, opened, opening)
        state, _ = one_round(spark, state, counts, opened, new, sequence)
        placed.append(state.filter(F.col("kind") == PLACED).select("id", "size", "seq"))
        opened += new
    if not placed:
        return items.select("id", F.col("size").cast("long").alias("size"), none).limit(0), 0
    every = placed[0]
    for p in placed[1:]:
        every = every.unionByName(p)
    return every, opened


def pack_best_fit(docs: DataFrame, sequence: int = SEQUENCE, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset."""
    found = pieces(docs, sequence, path)
    rests = found.filter(F.col("length") < sequence)
    placed, _ = best_fit(rests.select(F.col("number").alias("id"), F.col("length").alias("size")), sequence)
    # Longest first within a sequence, which holds at most ``sequence`` pieces.
    before = W.partitionBy("seq").orderBy(F.col("size").desc(), "id").rowsBetween(W.unboundedPreceding, -1)
    offsets = placed.select(F.col("id").alias("number"), F.col("seq").alias("sequence_id"),
                            F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long").alias("offset"))
    whole = found.filter(F.col("length") == sequence).select(
        "*", (-1 - F.col("number")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return whole.unionByName(rests.join(offsets, "number")).drop("number")
