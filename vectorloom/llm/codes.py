"""Vector code compression: product codes from Lloyd's rounds whose members stay where they live.

Vectors become integers (``floor(SCALE * x)``) and are cut into ``parts`` equal parts; every part position
has a codebook of ``entries`` vectors, all arithmetic is in whole numbers.

1. The kept rows get a row number and are written. The codebooks start as the parts of the smallest ids.
2. Every part is a member of its nearest entry. The first shuffle lays members out by (position, entry,
   salt), a table written once; the salt splits an entry that most parts choose over several owners.
3. An owner adds up its resident members, so a sum per (position, entry) leaves each task; the driver
   divides at most ``parts * entries`` of them and sends the new codebooks along with the next pass.
4. That pass reads the residents in place and names the nearest entry anew. Who stays is not moved; only
   the parts that change entry go through a shuffle, to their new owner. The sums follow from the
   migrants alone: what left is subtracted, what arrived is added. Each state replaces the one before, which is deleted.
5. After the last round the residents are assigned once more and their (position, entry, error) are gathered
   by row number: the code, and the squared error summed over the parts.

Driver and closures hold the codebooks only (``entries`` times the vector's width), at no time vectors or members.

Defined results: rows with a null vector, or with a null or non-finite component, go, and so do vectors whose width
``parts`` does not divide or that differs from the width of the row with the smallest id. A null id is larger than
every id; equal ids and repeated rows are rows of their own. Ties between entries go to the lower index, also
where the start holds equal entries. With fewer rows than ``entries`` the codebooks have as many entries as there are rows.
Components beyond +-2^19 count as +-2^27 after scaling, so that errors fit 64 bits (a sum over a label that
does not is null). Null labels are one label; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.common import int64, map_rows, materialize, remove_scratch, scan_tasks, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Bound of a scaled component.
LARGEST = 1 << 27
#: Members per Arrow batch; they are narrow.
MEMBERS = 1 << 14


def scaled_rows(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """row, vec_id, label, ints per usable vector, written once."""
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(LARGEST))),
                                                                  F.lit(float(-LARGEST)))).cast("int"))
    kept = (vectors.select("vec_id", "label", "embedding")
            .filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & (F.size("embedding") % parts == 0) & usable))
    return materialize(kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", whole.alias("ints")), "vectors")


def first_rows(rows: DataFrame, n: int) -> list[list[int]]:
    """The vectors of the ``n`` smallest ids; of equal ids the smaller vector first."""
    return [r["ints"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(n).select("ints").collect()]


def nearest(x: np.ndarray, book: np.ndarray, chunk: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (ties: the lower) and the squared distance to it, in 64-bit integers."""
    entry, error = np.empty(len(x), dtype=np.int32), np.empty(len(x), dtype=np.int64)
    for i in range(0, len(x), chunk):
        part = x[i:i + chunk]
        d = np.zeros((len(part), len(book)), dtype=np.int64)
        for j in range(x.shape[1]):
            diff = part[:, j, None] - book[None, :, j]
            d += diff * diff
        at = d.argmin(axis=1)
        entry[i:i + chunk] = at
        error[i:i + chunk] = d[np.arange(len(part)), at]
    return entry, error


def _matrix(lists: pa.Array) -> np.ndarray:
    """A list column of one width as an (n, width) matrix of 64-bit integers."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(lists), -1)


def _lists(x: np.ndarray) -> pa.Array:
    offsets = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(np.int32).ravel()))


def by_owner(members: DataFrame) -> DataFrame:
    """Deal members to their owners: (position, entry, salt)."""
    return members.repartition("position", "entry", "salt")


def placed(rows: DataFrame, books: np.ndarray, salts: int) -> DataFrame:
    """One member per part: row, position, entry, part, and the salt of its owner."""
    parts, _, width = books.shape

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            x, row = _matrix(b["ints"]), b["row"].to_numpy()
            entry = np.concatenate([nearest(x[:, p * width:(p + 1) * width], books[p])[0] for p in range(parts)])
            yield {"row": int64(np.tile(row, parts)), "position": pa.array(np.repeat(np.arange(parts, dtype=np.int32), len(row))),
                   "entry": pa.array(entry),
                   "part": _lists(x.reshape(len(row), parts, width).swapaxes(0, 1).reshape(-1, width))}

    out = map_rows(rows.select("row", "ints"), run, "row long, position int, entry int, part array<int>")
    return out.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))


def reassigned(members: DataFrame, books: np.ndarray) -> DataFrame:
    """The members where they are, with the entry now nearest, the one before (``was``) and the squared error."""
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            x, position = _matrix(b["part"]), b["position"].to_numpy()
            entry, error = np.empty(len(x), dtype=np.int32), np.empty(len(x), dtype=np.int64)
            for p in np.unique(position):
                here = position == p
                entry[here], error[here] = nearest(x[here], books[p])
            yield {"row": b["row"], "position": b["position"], "entry": pa.array(entry), "part": b["part"],
                   "salt": b["salt"], "was": b["entry"], "error": pa.array(error)}

    return map_rows(members.select("row", "position", "entry", "part", "salt"), run,
                    "row long, position int, entry int, part array<int>, salt int, was int, error long", MEMBERS)


def entry_sums(members: DataFrame, width: int, sign: str = "1") -> np.ndarray | list:
    """(position, entry, count, sums) of signed members, added up where they live; at most one row per entry."""
    totals = [F.sum(F.expr(f"{sign} * cast(part[{j}] as long)")).alias(f"s{j}") for j in range(width)]
    return members.groupBy("position", "entry").agg(F.sum(F.expr(f"cast({sign} as long)")).alias("n"), *totals).collect()


class Totals:
    """Count and component sums of every entry."""

    def __init__(self, shape: tuple[int, int, int]):
        self.n, self.sums = np.zeros(shape[:2], dtype=np.int64), np.zeros(shape, dtype=np.int64)

    def add(self, collected: list) -> None:
        for position, entry, n, *sums in collected:
            self.n[position, entry] += n
            self.sums[position, entry] += sums

    def books(self, before: np.ndarray) -> np.ndarray:
        """Componentwise floor of the means; an entry without members stays."""
        return np.where(self.n[..., None] > 0, self.sums // np.maximum(self.n, 1)[..., None], before)


def lloyd(rows: DataFrame, books: np.ndarray, rounds: int) -> tuple[DataFrame, np.ndarray, str]:
    """The members after ``rounds`` rounds, the final codebooks, and the path of the members' table."""
    parts, _, width = books.shape
    spark = rows.sparkSession
    # As many salts as let any entry of a position spread over its share of the tasks.
    salts = 2 * -(-scan_tasks(spark) // parts)
    members, path = written(by_owner(placed(rows, books, salts)), "members")
    totals = Totals(books.shape)
    if rounds:
        totals.add(entry_sums(members, width))
    for r in range(rounds):
        books = totals.books(books)
        if r == rounds - 1:
            break
        now, now_path = written(reassigned(members, books), "members")
        migrants = materialize(by_owner(now.filter("entry <> was")), "migrants")
        both = migrants.select("position", "entry", "part", F.lit(1).alias("sign")).unionByName(
            migrants.select("position", F.col("was").alias("entry"), "part", F.lit(-1).alias("sign")))
        totals.add(entry_sums(both, width, "sign"))
        members = now.filter("entry = was").unionByName(migrants)
        remove_scratch(spark, path)
        path = now_path
    return members, books, path


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(row, vec_id, label, code, error) per usable vector, and the codebooks (parts, entries, width)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    rows = scaled_rows(vectors, parts)
    start = first_rows(rows, 1)
    if not start:
        return rows.select("row", "vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), \
            np.zeros((parts, 0, 0), dtype=np.int64)
    wide = len(start[0])
    rows = rows.filter(F.size("ints") == wide)
    books = np.array(first_rows(rows, entries), dtype=np.int64).reshape(-1, parts, wide // parts).swapaxes(0, 1)
    members, books, _ = lloyd(rows, books, rounds)
    found = reassigned(members, books).select("row", F.struct("position", "entry").alias("at"), "error")
    named = rows.select("row", "vec_id", "label")
    gathered = (found.unionByName(named, allowMissingColumns=True).groupBy("row")
                .agg(F.max("vec_id").alias("vec_id"), F.first("label", ignorenulls=True).alias("label"),
                     F.array_sort(F.collect_list("at")).alias("at"), F.sum("error").alias("error")))
    code = F.array_join(F.transform("at", lambda a: F.lower(F.lpad(F.hex(a["entry"]), 2, "0"))), "")
    return gathered.select("row", "vec_id", "label", code.alias("code"), "error"), books


def code_digest(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 per usable vector."""
    found, books = vector_codes(vectors)
    found = materialize(found, "codes")
    sums = materialize(found.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("sum"))
                       .select("label", F.expr("try_cast(sum as long)").alias("label_error")), "label-errors")
    both = found.join(sums, found["label"].eqNullSafe(sums["label"]))
    return both.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
