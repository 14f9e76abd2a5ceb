"""MinHash near-dedup: fast similarity sketching, banding, exact verification.

1. A document's set is its distinct shingles of ``SHINGLE`` words or as many as the caller says (64-bit hashes). Equal sets collapse to one
   class, named by its smallest doc_id, before anything is compared.
2. The sketch throws the set into ``COORDINATES`` bins in rounds: round i hashes every element to a bin
   and a value and fills bins that are still empty with the smallest value; from round
   ``COORDINATES`` on, round i sends every element to bin i - COORDINATES, so every coordinate fills.
3. ``BANDS`` bands of ``ROWS`` coordinates are hashed. Two sets with similarity 0.8 share no band with
   probability (1 - 0.8^4)^32 < 5e-8.
4. In each band bucket every member is paired with one pseudo-random hub, not with each other; pairs are
   verified on the full sets. Connected buckets make a family: any two documents that share a
   bucket are in one family.
5. Families that verification left in several components are finished exactly: every document outside
   the family's largest component is compared with all others of the family, in blocks of
   ``BLOCK_DOCS`` x ``BLOCK_DOCS`` spread over tasks; a block emits only links that join components.
6. Components: large-star and small-star steps on edge tables, each written before the next.

No table of links, components or sketches reaches the driver; only row counts do.

Defined results: null, empty and white-space texts have the empty set, are linked with nothing and kept;
fewer words than a shingle has are one shingle; rows with a null doc_id cannot be named, so they are kept,
with a null component; rows that share a doc_id are one document (their sets count as linked);
extra columns are ignored by the links and kept by the filter; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from typing import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.common import PAIR_ROWS, few, free_name, map_rows, materialize, signed, temporary, text_bytes
from vectorloom.session import scratch_path

#: Words per shingle.
SHINGLE = 5
COORDINATES, BANDS, ROWS = 128, 32, 4
#: Linked if 100 * intersection >= PERCENT * union.
PERCENT = 80
BLOCK_DOCS = 512
#: Parts that a family's documents are dealt into where the family's key is joined.
SALTS = 64

_U = np.uint64
_GOLD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes; ``bytes.lower`` and ``bytes.split`` are ASCII only, as wanted."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64)
    if len(h) < size:
        h = np.r_[h, np.full(size - len(h), 1, dtype=np.uint64)]
    out = np.zeros(len(h) - size + 1, dtype=np.uint64)
    for j in range(size):
        out = _mix(out + h[j:len(out) + j])
    return np.unique(out)


def sketch(items: np.ndarray) -> np.ndarray:
    """COORDINATES values of a non-empty set."""
    t = COORDINATES
    out, empty = np.zeros(t, dtype=np.uint64), np.ones(t, dtype=bool)
    for i in range(2 * t):
        x = _mix(items ^ _U((i + 1) * _GOLD & _MASK))
        bins = (x >> _U(57)).astype(np.int64) if i < t else np.full(len(x), i - t)
        low = np.full(t, _MASK, dtype=np.uint64)
        np.minimum.at(low, bins, x)
        hit = np.zeros(t, dtype=bool)
        hit[bins] = True
        new = hit & empty
        out[new] = low[new] + _U(i)
        empty &= ~hit
        if not empty.any():
            break
    return out


def bands(values: np.ndarray) -> np.ndarray:
    """BANDS hashes, the band's number included."""
    rows = values.reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * _U(_GOLD)
    for r in range(ROWS):
        out = _mix(out + rows[:, r])
    return out.view(np.int64)


def profiles(docs: DataFrame, rows: int, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, hi, lo (hash of the set), bands for each of about ``rows`` rows; bands are null for the empty set."""
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out = {k: [] for k in ("n_shingles", "hi", "lo", "bands")}
            for text in b["text"].to_pylist():
                s = shingles(text, size)
                h = xxhash.xxh3_128_intdigest(s.tobytes())
                for k, v in zip(out, (len(s), signed(h >> 64), signed(h & _MASK),
                                      bands(sketch(s)).tolist() if len(s) else None)):
                    out[k].append(v)
            yield {"doc_id": b["doc_id"], **out}

    return materialize(few(map_rows(docs.select("doc_id", text_bytes().alias("text")), run,
                                    "doc_id long, n_shingles long, hi long, lo long, bands array<long>"), rows), "profiles")


def components(edges: DataFrame, name: str, rows: int) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v), about ``rows`` rows; the root is the component's smallest node.

    Alternates large-star and small-star steps until the edge table no longer changes.
    """
    current = materialize(few(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                              .filter("u <> v").distinct(), rows, PAIR_ROWS), f"{name}-edges")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    def star(df: DataFrame, large: bool) -> DataFrame:
        if large:
            both = df.unionByName(df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            both = df
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        joined = both.join(low, "u")
        if large:   # every larger neighbour points to the smallest neighbour (or to u itself)
            out = joined.filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        else:       # the node and its smaller neighbours point to the smallest of them
            out = (joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
                   .unionByName(low.select("u", F.col("m").alias("v"))))
        return materialize(few(out.filter("u <> v").distinct(), seen[0], PAIR_ROWS), f"{name}-star")

    seen = state(current)
    while True:
        current = star(star(current, True), False)
        now = state(current)
        if now == seen:
            break
        seen = now
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def similar(a: int, b: int, both: int) -> bool:
    return 100 * both >= PERCENT * (a + b - both)


def hub_pairs(reps: DataFrame, rows: int) -> DataFrame:
    """Distinct (u, v): each band bucket's members beside its pseudo-random hub, of about ``rows`` documents."""
    members = reps.select("id", F.explode("bands").alias("h"))
    hub = F.min(F.struct(F.xxhash64("id", "h").alias("order"), "id"))
    hubs = members.groupBy("h").agg(hub.alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    pairs = (members.join(hubs.select("h", F.col("hub.id").alias("hub")), "h").filter("id <> hub")
             .select(F.col("hub").alias("u"), F.col("id").alias("v")))
    return materialize(few(materialize(few(pairs, rows), "bucket-pairs").distinct(), rows), "hub-pairs")


def verified(pairs: DataFrame, texts: DataFrame, rows: int, size: int = SHINGLE) -> DataFrame:
    """The (u, v) whose full sets are similar, of ``rows`` pairs."""
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        last, of_last = None, None
        for b in batches:
            out = {"u": [], "v": []}
            for u, v, tu, tv in zip(*(b[c].to_pylist() for c in ("u", "v", "tu", "tv"))):
                if u != last or tu != of_last[0]:
                    last, of_last = u, (tu, shingles(tu, size))
                a, c = of_last[1], shingles(tv, size)
                if similar(len(a), len(c), len(np.intersect1d(a, c, assume_unique=True))):
                    out["u"].append(u)
                    out["v"].append(v)
            yield out

    beside = (pairs.join(texts.select(F.col("id").alias("v"), F.col("text").alias("tv")), "v")
              .join(texts.select(F.col("id").alias("u"), F.col("text").alias("tu")), "u"))
    return materialize(few(map_rows(beside.select("u", "v", "tu", "tv"), run, "u long, v long"), rows), "links")


def _finish(batches: Iterator[dict], size: int) -> Iterator[dict]:
    """Compare the movers of each block pair with its members; emit links that join components."""
    def close(rows: list[tuple]) -> list[tuple[int, int]]:
        roots: dict[int, int] = {}

        def find(x: int) -> int:
            while roots.setdefault(x, x) != x:
                roots[x] = roots[roots[x]]
                x = roots[x]
            return x

        movers = [(i, c, shingles(t, size)) for i, c, m, t in rows if m]
        members = [(i, c, shingles(t, size)) for i, c, m, t in rows if not m]
        if not movers or not members:
            return []
        sizes = np.array([len(s) for _, _, s in members])
        owner = np.repeat(np.arange(len(members)), sizes)
        every = np.concatenate([s for _, _, s in members])
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        out = []
        for i, c, s in movers:
            low, high = np.searchsorted(every, s, "left"), np.searchsorted(every, s, "right")
            at = np.concatenate([np.arange(a, b) for a, b in zip(low, high) if b > a] or [np.zeros(0, dtype=np.int64)])
            both = np.bincount(owner[at], minlength=len(members))
            for k in np.flatnonzero(100 * both >= PERCENT * (sizes + len(s) - both)):
                j, d, _ = members[k]
                if find(c) != find(d):
                    roots[find(c)] = find(d)
                    out.append((i, j))
        return out

    key, rows = None, []
    for b in batches:
        found: list[tuple[int, int]] = []
        for family, i, j, doc, comp, mover, text in zip(*(b[c].to_pylist() for c in ("family", "i", "j", "id", "comp", "mover", "text"))):
            if (family, i, j) != key:
                found.extend(close(rows))
                key, rows = (family, i, j), []
            rows.append((doc, comp, mover, text))
        if found:
            yield {"u": [u for u, _ in found], "v": [v for _, v in found]}
    found = close(rows)
    if found:
        yield {"u": [u for u, _ in found], "v": [v for _, v in found]}


def remaining_links(families: DataFrame, comps: DataFrame, texts: DataFrame, rows: int, size: int = SHINGLE) -> DataFrame:
    """Links between the components that verification left inside a family, of about ``rows`` documents in all.

    A family may hold a large part of all rows, so its block counts are joined on (family, salt): each
    family has at most ``SALTS`` such keys, made from its own rows, and no task reads it whole.
    """
    named = materialize(few(families.select(F.col("node").alias("id"), F.col("root").alias("family"))
                            .join(comps.select(F.col("node").alias("id"), F.col("root").alias("comp")), "id", "left")
                            .withColumn("comp", F.coalesce("comp", "id"))
                            .withColumn("salt", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(SALTS))), rows), "families")
    sizes = named.groupBy("family", "comp").agg(F.count(F.lit(1)).alias("n"))
    split = (sizes.groupBy("family").agg(F.count(F.lit(1)).alias("comps"), F.sum("n").alias("docs"),
                                         F.max(F.struct("n", "comp")).alias("base"))
             .filter("comps > 1")
             .select("family", F.col("base.comp").alias("base"),
                     F.ceil(F.col("docs") / BLOCK_DOCS).alias("nj"),
                     F.ceil((F.col("docs") - F.col("base.n")) / BLOCK_DOCS).alias("ni")))
    dealt = named.select("family", "salt").distinct().join(split, "family")
    held = (named.join(dealt, ["family", "salt"]).drop("salt").join(texts, "id")
            .withColumn("bj", F.pmod(F.xxhash64("id"), F.col("nj"))).withColumn("bi", F.pmod(F.xxhash64("id", F.lit(1)), F.col("ni"))))
    members = held.select("family", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ni") - 1)).alias("i"),
                          F.col("bj").alias("j"), "id", "comp", F.lit(False).alias("mover"), "text")
    movers = held.filter("comp <> base").select("family", F.col("bi").alias("i"),
                                                F.explode(F.sequence(F.lit(0).cast("long"), F.col("nj") - 1)).alias("j"),
                                                "id", "comp", F.lit(True).alias("mover"), "text")
    blocks = (members.unionByName(movers).repartition("family", "i", "j").sortWithinPartitions("family", "i", "j"))
    return materialize(map_rows(blocks, functools.partial(_finish, size=size), "u long, v long"), "more-links")


def same_document(profile: DataFrame, classes: DataFrame) -> DataFrame:
    """(u, v) between the classes that hold rows of one doc_id."""
    repeated = profile.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    held = (profile.select("doc_id", "hi", "lo").join(repeated, "doc_id").distinct()
            .join(classes.select("hi", "lo", "id"), ["hi", "lo"]))
    least = held.groupBy("doc_id").agg(F.min("id").alias("u"))
    return held.join(least, "doc_id").select("u", F.col("id").alias("v")).filter("u <> v")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, without: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """Shingles of ``size`` words: doc_id, n_shingles, component_id, kept per row of ``docs``.

    ``without``: ids (doc_id) whose rows take no part, left out where the rows are narrow, so no text is copied.
    ``rows``: about how many rows ``docs`` has, where the caller knows; only the number of files goes by it.
    """
    if rows is None:
        rows = docs.count()
    profile = profiles(docs, rows, size)
    if without is not None:
        profile = profile.join(without.hint("shuffle_hash"), "doc_id", "left_anti")
    classes = materialize(
        few(profile.filter("bands is not null and doc_id is not null").groupBy("hi", "lo")
            .agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands")), rows), "classes")
    pairs = hub_pairs(classes, rows)
    n_pairs = pairs.count()
    families = materialize(few(components(pairs, "families", n_pairs), rows, PAIR_ROWS), "family-of")
    wanted = families.select(F.col("node").alias("id"))
    text = (docs.select(F.col("doc_id").alias("id"), text_bytes().alias("text"))
            .join(wanted.hint("shuffle_hash"), "id"))
    texts = materialize(few(text.distinct(), rows), "candidate-texts")
    links = verified(pairs, texts, n_pairs, size)
    shared = same_document(profile, classes)
    comps = components(links, "first", n_pairs)
    more = remaining_links(families, comps, texts, rows, size)
    every = materialize(few(components(links.unionByName(more).unionByName(shared), "all", n_pairs + rows), rows, PAIR_ROWS),
                        "components")
    found = (profile.join(classes.select("hi", "lo", "id"), ["hi", "lo"], "left")
             .join(every.withColumnRenamed("node", "id"), "id", "left"))
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(
        F.coalesce("root", "id"))
    return (found.withColumn("component_id", own.cast("long"))
            .select("doc_id", "n_shingles", "component_id",
                    (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).alias("kept")))


def _copies(docs: DataFrame, rows: int, without: DataFrame | None = None) -> DataFrame:
    """The ids (doc_id) that near-dedup drops; ``without`` and ``rows`` as in ``near_duplicates``."""
    return few(near_duplicates(docs, without=without, rows=rows).filter(~F.col("kept")).select("doc_id").distinct(), rows, PAIR_ROWS)


def keep_one(docs: DataFrame, came: DataFrame | None = None) -> DataFrame:
    """``docs`` with one row per component, all columns kept.

    ``came``: (doc_id, text) as the documents came in, before other steps cut their texts; copies are
    judged by these, and by ``docs`` itself for ids that ``came`` does not hold. What is left is judged once more,
    by the texts of ``docs``: documents whose texts became near copies only by what was cut are copies, too.
    Rows with a null doc_id stay; of rows that share a doc_id one stays, the one with the smallest hash of its text.
    """
    judged = docs.select("doc_id", "text")
    rows = docs.count()
    gone, low, tkey = (free_name(docs.columns, n) for n in ("gone_id", "low_tkey", "own_tkey"))
    if came is None:
        dropped = _copies(judged, rows).withColumnRenamed("doc_id", gone)
    else:
        spark = docs.sparkSession
        ids = judged.select("doc_id").distinct()
        known = came.select("doc_id", "text").join(ids.hint("shuffle_hash"), "doc_id", "left_semi")
        before = known.unionByName(judged.join(came.select("doc_id").distinct().hint("shuffle_hash"), "doc_id", "left_anti"))
        at = scratch_path(spark, "llm-copies")
        with temporary(spark):      # each round's tables go before the next writes its own
            _copies(before, rows).write.parquet(f"{at}/round=1")
        dropped = spark.read.schema("doc_id long").parquet(f"{at}/round=1")
        with temporary(spark):
            _copies(judged, rows, dropped).write.parquet(f"{at}/round=2")
        dropped = spark.read.schema("doc_id long").parquet(at).select(F.col("doc_id").alias(gone))
    rest = docs.join(dropped.hint("shuffle_hash"), docs["doc_id"] == F.col(gone), "left_anti")
    repeated = (docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.xxhash64("text")).alias(low))
                .filter("n > 1").select(F.col("doc_id").alias(gone), low))
    # Few ids repeat, so this join and the one below move next to nothing.
    single = rest.join(repeated.hint("shuffle_hash"), rest["doc_id"] == F.col(gone), "left_anti")
    first = (rest.join(repeated, rest["doc_id"] == F.col(gone)).withColumn(tkey, F.xxhash64("text"))
             .filter(F.col(tkey) == F.col(low)).dropDuplicates(["doc_id"]))
    return few(single.unionByName(first.select(*docs.columns)), rows)
