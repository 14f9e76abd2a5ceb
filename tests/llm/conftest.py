"""Small fixtures: nulls in any column, empty and long texts, repeated rows, ties, clashing extra columns."""

import random

import pytest

#: Extra columns named like the operators' own.
CLASH = ["tkey", "bucket", "ids", "key", "hi", "pos", "bitmap", "sel", "row", "guest", "first", "words", "item_id",
         "keep_doc", "keep_tkey", "keep_dropped", "keep_bitmap", "__keep_bitmap", "__keep_dropped", "__tkey", "__gone", "gone_id", "low_tkey",
         "own_tkey", "n", "number", "seq", "size", "kind", "sequence_id", "runs", "collapsed"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def messy_rows(seed=1):
    rng = random.Random(seed)
    base = words(rng, 120)
    edited = base.replace(base.split()[60], "changed", 1)
    shared = "\n  The shared line of many documents.  \n"
    texts = [None, "", "   \t", "one", "two words", "three little words", "exactly four words here", base, base, base, edited,
             base.upper(), "line\n" + shared + "tail " + words(rng, 30), shared.upper() + words(rng, 30) + shared,
             "short\nshort\n", "Ünïcode Straße ΑΣ it's they're 12a3!!' <|endoftext|> x y\u0085z ﬁ é",
             words(rng, 9000), "a" * 3000, "\n\n\n", "It. " * 500]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)] + [(400 + i, words(rng, rng.randrange(1, 90))) for i in range(30)]
    rows += [(None, "null id " + words(rng, 20)), (None, None), (7, base[:50]), (22, base), (22, base), (500, words(rng, 60) + shared)]
    rows += [(600 + i, f"{shared}{words(rng, 12)}") for i in range(12)]
    return rows


def frame(spark, rows, parts=3):
    data = [(d, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else "src", None if t is None else len(t),
             *["z"] * len(CLASH)) for i, (d, t) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA).repartition(parts) if data else spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def messy(spark):
    rows = messy_rows()
    return rows, frame(spark, rows).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
