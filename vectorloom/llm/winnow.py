"""Document fingerprints by winnowing, in column expressions only.

A text's grams are its runs of ``CHAR_K`` code points, each hashed from its UTF-32 bytes. Every window of
``CHAR_W`` consecutive grams selects its smallest hash, the rightmost one among equals, and the selected
positions are kept. Any ``CHAR_K + CHAR_W - 1`` code points in a row that two texts share give them a common
hash, whatever their spaces: short texts and scripts without spaces are covered like any other.

``fingerprints`` also winnows over words (rolling polynomial hashes of ``K`` words, windows of ``W``), a much
shorter print with a guarantee for passages of ``K + W - 1`` words.

The edited text needs the next document in descending id order. Ids are cut
into buckets at approximate quantiles (at most ``MAX_BUCKETS`` split points,
the only thing the driver sees); an id that fills several quantiles, and the null id, get buckets of their
own, cut further by ranges of the text hash. Each bucket is one window group, and the first
document of the following bucket joins it as a guest, so ``lead`` never needs a
window over the whole table and texts are shuffled once. The windows inside the kept and the added half are
those of the two documents, whose selections are reused; only the few across the joint are computed anew.

Defined results: null text is empty; an empty text has the empty
fingerprint and no positions, two empty fingerprints are alike (1.0), an empty
and a non-empty one are not (0.0); a text shorter than a gram is one gram, fewer grams
than a window one window; rows with equal ids are ordered by a hash of their
text (rows repeated in full are interchangeable; their window spools to disk); null ids come last; a single document is
its own next document; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words per gram and grams per window.
K, W = 5, 16
#: Code points per gram and grams per window; ``CHAR_W`` is a power of two.
CHAR_K, CHAR_W = 5, 8
PRIME = (1 << 31) - 1
#: Powers of the polynomial's base, highest first; below 2^28, so a sum of K products stays below 2^62.
BASE = 16777619
POWERS = [pow(BASE, K - 1 - j, 268435399) for j in range(K)]

#: Documents per bucket, and the most split points the driver collects; with more
#: documents than their product, buckets grow (and spill), nothing is dropped.
BUCKET_DOCS, MAX_BUCKETS = 1024, 10_000


def _let(value: Column, body) -> Column:
    """Bind ``value`` once for ``body``."""
    return F.transform(F.array(value), body)[0]


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != F.lit(""))
    return F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(F.lit(PRIME)))


def gram_hashes(h: Column) -> Column:
    """Hash of every run of K words; one gram of all words when there are fewer."""
    def gram(i: Column) -> Column:
        total = F.get(h, i + (K - 1))
        for j in range(K - 1):
            total = total + F.get(h, i + j) * POWERS[j]
        return total % PRIME

    whole = F.aggregate(h, F.lit(0).cast("long"), lambda a, x: (a * 8191 + x) % PRIME)
    return (F.when(F.size(h) >= K, F.transform(F.sequence(F.lit(0), F.size(h) - K), gram))
            .when(F.size(h) > 0, F.array(whole))
            .otherwise(F.array().cast("array<bigint>")))


def window_minima(g: Column) -> Column:
    """Selected grams as ``hash * 2^31 + (2^31 - 1 - position)``, so the least value is the
    smallest hash and, among equals, the rightmost."""
    v = F.transform(g, lambda x, i: x * (1 << 31) + (PRIME - i))
    return _let(v, lambda v: F.array_distinct(
        F.when(F.size(v) > W, F.transform(F.sequence(F.lit(1), F.size(v) - W + 1),
                                          lambda i: F.array_min(F.slice(v, i, F.lit(W)))))
        .when(F.size(v) > 0, F.array(F.array_min(v)))
        .otherwise(F.array().cast("array<bigint>"))))


def winnow(text: Column) -> Column:
    """array<long> of selected (hash, position) pairs in text order; see ``window_minima``."""
    return _let(word_hashes(F.coalesce(text, F.lit(""))), lambda h: _let(gram_hashes(h), window_minima))


def char_minima(text: Column) -> Column:
    """The selected gram of every window over code points, window by window; one gram of the whole text when it has
    fewer than ``CHAR_K`` code points, one window when it has fewer grams.

    As ``hash * 2^31 + (2^31 - 1 - byte)``, ``byte`` the gram's place in UTF-32, from 1: the least arithmetic per
    gram.
    """
    def grams(b: Column) -> Column:
        n = F.octet_length(b)
        size = F.lit(4 * CHAR_K)
        return (F.when(n > 0, F.transform(
            F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1)), F.lit(4)),
            lambda p: F.xxhash64(F.substring(b, p, size)).bitwiseAND(F.lit(PRIME << 31)).bitwiseOR(F.lit(PRIME) - p)))
            .otherwise(F.array().cast("array<bigint>")))

    def lower(v: Column, step: int) -> Column:
        # A text's end has fewer grams than a window: ``least`` skips the nulls there.
        return _let(v, lambda m: F.transform(m, lambda x, i: F.least(x, F.get(m, i + step))))

    def minima(v: Column) -> Column:
        out, step = v, 1
        while step < CHAR_W:
            out, step = lower(out, step), 2 * step
        return _let(out, lambda m: F.slice(m, F.lit(1), F.greatest(F.size(m) - (CHAR_W - 1), F.lit(1))))

    return _let(F.encode(F.coalesce(text, F.lit("")), "UTF-32"), lambda b: _let(grams(b), minima))


def winnow_chars(text: Column) -> Column:
    """Selected grams over code points in text order, in ``char_minima``'s form."""
    return F.array_distinct(char_minima(text))


#: Windows that touch both sides of a joint between two texts, and the code points they need of either side.
JOINT = CHAR_K + CHAR_W - 2


def _moved(sel: Column, by: Column) -> Column:
    """Grams ``by`` code points further on."""
    return _let(by * 4, lambda n: F.transform(sel, lambda x: x - n))


def _begun(sel: Column, part: Column, n: Column) -> Column:
    """What the windows inside ``part`` (``n`` code points, at least ``JOINT``) select, ``sel`` being the selection of
    a text that begins with ``part``: selected places never go back, so it is ``sel`` up to the last window's gram."""
    last = _moved(char_minima(F.substring(part, n - JOINT, F.lit(JOINT + 1))), n - (JOINT + 1))[0]
    return F.when(n > JOINT, F.slice(sel, F.lit(1), F.array_position(sel, last).cast("int"))).otherwise(
        F.array().cast("array<bigint>"))


def joined_selection(kept: Column, a: Column, sel: Column, added: Column, b: Column, next_sel: Column) -> Column:
    """The selected grams of ``kept`` (``a`` code points) followed by ``added`` (``b``), from the selections of the
    texts that they begin.

    Windows inside either part select what they select in that text; only the ``JOINT`` windows across the
    joint are new. Both parts have at least ``JOINT`` code points.
    """
    across = char_minima(F.concat(F.substring(kept, a - JOINT + 1, F.lit(JOINT)), F.substring(added, F.lit(1), F.lit(JOINT))))
    return F.array_distinct(F.concat(_begun(sel, kept, a), _moved(across, a - JOINT), _moved(_begun(next_sel, added, b), a)))


def selected_hashes(sel: Column) -> Column:
    return F.array_distinct(F.transform(sel, lambda x: F.shiftright(x, 31)))


def positions(sel: Column, chars: bool = False) -> Column:
    """Places of the selected grams, from 0: words, or code points."""
    def at(x: Column) -> Column:
        low = F.lit(PRIME) - x.bitwiseAND(F.lit(PRIME))
        return F.shiftright(low, 2) if chars else low

    return F.transform(sel, at)


def fingerprint(sel: Column) -> Column:
    """The selected grams, hash and place in one hexadecimal number each, joined by spaces."""
    return F.array_join(F.transform(sel, lambda x: F.hex(x)), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two sets of selected hashes; 1 when both are empty. Either argument is evaluated once."""
    def of(a: Column, b: Column, both: Column) -> Column:
        return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(
            both.cast("double") / (F.size(a) + F.size(b) - both))

    return _let(a, lambda x: _let(b, lambda y: _let(F.size(F.array_intersect(x, y)), lambda n: of(x, y, n))))


def _bucket(docs: DataFrame, column: Column, tkey: Column) -> Column:
    """Number of the row's bucket, rising with (id, text hash), the null id below all others."""
    count = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("doc_id").isNull().cast("long")).alias("nulls")).first()
    n = min(MAX_BUCKETS, math.ceil(count["n"] / BUCKET_DOCS))
    if n < 2:
        return F.lit(0)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * MAX_BUCKETS)).first()[0] or []
    share = Counter(cuts)                     # an id that stands at several cuts holds that many buckets' rows
    hot = {c: k for c, k in share.items() if k > 1}
    starts = sorted(share.keys() | {c + 1 for c in hot})
    # (first id, number of its first bucket, buckets); ids below all cuts come first, the null id before them.
    nulls = max(1, math.ceil(count["nulls"] / BUCKET_DOCS))
    table, number = [], nulls + 1
    for c in starts:
        table.append((c, number, hot.get(c, 1)))
        number += hot.get(c, 1)
    # The text hash's upper half, as a number from 0 to 2^32 - 1, cut into equal ranges.
    place = lambda parts: F.shiftright((F.shiftright(tkey, 32) + (1 << 31)) * parts, 32)
    if not table:
        return F.when(column.isNull(), place(F.lit(nulls))).otherwise(F.lit(nulls)).cast("int")
    # Two levels of at most sqrt(n) comparisons each.
    step = math.isqrt(len(table)) + 1
    groups = [table[i:i + step] for i in range(0, len(table), step)]
    lists = lambda k: F.array(*[F.array(*[F.lit(r[k]) for r in g]) for g in groups])
    at = F.size(F.filter(F.array(*[F.lit(g[0][0]) for g in groups]), lambda c: c <= column)) - 1

    def within(g: Column) -> Column:
        return _let(F.size(F.filter(F.get(lists(0), g), lambda c: c <= column)) - 1,
                    lambda i: F.get(F.get(lists(1), g), i) + place(F.get(F.get(lists(2), g), i)))

    return (F.when(column.isNull(), place(F.lit(nulls)))
            .otherwise(_let(at, lambda g: F.when(g < 0, F.lit(nulls)).otherwise(within(g))))).cast("int")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, sel (selected grams), next_text, next_sel: each document beside the next in descending id."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tkey", F.xxhash64("text")).withColumn("bucket", _bucket(rows, F.col("doc_id"), F.col("tkey")))
    # One row per bucket: its first document in descending order. The buckets number at most MAX_BUCKETS.
    first = rows.groupBy("bucket").agg(F.max(F.struct("doc_id", "tkey")).alias("first")).collect()
    first = sorted(((r["bucket"], r["first"]["doc_id"], r["first"]["tkey"]) for r in first), reverse=True)
    hosts = [(first[(i - 1) % len(first)][0], d, t) for i, (_, d, t) in enumerate(first)]
    guests = spark.createDataFrame(hosts, "host int, g_doc long, g_tkey long")
    on = rows["doc_id"].eqNullSafe(guests["g_doc"]) & (rows["tkey"] == guests["g_tkey"])
    visiting = rows.join(F.broadcast(guests), on).select("doc_id", "text", "tkey", F.col("host").alias("bucket"),
                                                         F.lit(1).alias("guest"))
    dealt = rows.withColumn("guest", F.lit(0)).unionByName(visiting).repartition("bucket")
    w = Window.partitionBy("bucket").orderBy(F.col("guest"), F.col("doc_id").desc(), F.col("tkey").desc())
    dealt = dealt.withColumn("sel", winnow_chars(F.col("text")))
    return dealt.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in ("text", "sel")]).filter("guest = 0")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, positions, char_fingerprint, char_positions per document (the general operator)."""
    sel = docs.select("doc_id", winnow(F.col("text")).alias("sel"), winnow_chars(F.col("text")).alias("chars"))
    return sel.select("doc_id", fingerprint(F.col("sel")).alias("fingerprint"),
                      positions(F.col("sel")).alias("positions"),
                      fingerprint(F.col("chars")).alias("char_fingerprint"),
                      positions(F.col("chars"), True).alias("char_positions"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document, all over code points."""
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("added", F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("a", (F.col("n_chars") - half).cast("int")).withColumn("b", F.length("added"))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("a")), F.col("added")))
    a, b = F.col("a"), F.col("b")
    rows = rows.withColumn("edited_sel", F.when(
        (a >= JOINT) & (b >= JOINT), joined_selection(F.substring("edited", F.lit(1), a), a, F.col("sel"), F.col("added"), b, F.col("next_sel")))
        .otherwise(winnow_chars(F.col("edited"))))
    rows = rows.withColumn("own", selected_hashes(F.col("sel")))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("sel")).alias("fingerprint"), fingerprint(F.col("edited_sel")).alias("edited_fingerprint"),
        likeness(F.col("own"), selected_hashes(F.col("edited_sel"))).alias("near_edited"),
        likeness(F.col("own"), selected_hashes(F.col("next_sel"))).alias("near_next"))
