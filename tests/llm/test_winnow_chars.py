"""Winnowing over code points: short texts and texts without spaces."""

import random

import xxhash

from tests.llm.conftest import frame
from vectorloom.llm import winnow
from vectorloom.llm.winnow import CHAR_K, CHAR_W, PRIME


def selected(text):
    """(hash, position) pairs, windows taken one by one."""
    grams = [xxhash.xxh64_intdigest(text[i:i + CHAR_K].encode("utf-32-be"), 42) >> 31 & PRIME
             for i in range(max(1, len(text) - CHAR_K + 1))] if text else []
    out = []
    for i in range(max(1, len(grams) - CHAR_W + 1) if grams else 0):
        pos, g = min(enumerate(grams[i:i + CHAR_W], i), key=lambda p: (p[1], -p[0]))
        if (g, pos) not in out:
            out.append((g, pos))
    return out


def printed(sel):
    """The place is the gram's first byte in UTF-32, counted from 1."""
    return " ".join(f"{g << 31 | PRIME - (4 * p + 1):X}" for g, p in sel)


def test_code_points_match_brute_force(spark, messy):
    rows = [(i, t) for i, (_, t) in enumerate(messy[0]) if len(t or "") < 9000] + [(900, "😀𝒳漢字かな交じり文"), (901, "abcd"), (902, "abcdefg")]
    got = {r["doc_id"]: (r["char_fingerprint"], r["char_positions"]) for r in winnow.fingerprints(frame(spark, rows)).collect()}
    assert got == {d: (printed(selected(t or "")), [p for _, p in selected(t or "")]) for d, t in rows}


def test_half_kept_short_and_unspaced_texts_are_near(spark):
    texts = ["only four short words", "three little words", "some nine words of a text that is short",
             "小明有五个苹果小红给他三个他一共有几个苹果呢", "x" * 40 + "".join(chr(97 + i * 7 % 26) for i in range(400))]
    out = winnow.edited_fingerprints(frame(spark, list(enumerate(texts)))).collect()
    assert len(out) == len(texts) and all(r["near_edited"] > 0 for r in out)


def test_every_half_kept_text_of_eight_words_is_near(spark):
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(rng.randrange(8, 61))) for _ in range(150)]
    texts += ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(rng.randrange(24, 90))) for _ in range(50)]
    out = winnow.edited_fingerprints(frame(spark, list(enumerate(texts)))).collect()
    assert min(r["near_edited"] for r in out) > 0 and sum(r["near_next"] for r in out) / len(out) < 0.02
