import random

from vectorloom.llm import chat


def brute(rows):
    convs = {}
    for c, t, r, x in set(rows):
        convs.setdefault(c, []).append((t is not None, t or 0, r is not None, r or "", x is not None, x or ""))
    seqs = {c: tuple((m[2:]) for m in sorted(ms)) for c, ms in convs.items()}
    order = lambda c: (c is None, c or 0)
    out = {}
    for c, s in seqs.items():
        if any(len(o) > len(s) and o[:len(s)] == s or o == s and order(d) < order(c) for d, o in seqs.items()):
            continue
        out[c] = (len(s), "".join(f"<|im_start|>{r if has else 'unknown'}\n{x}<|im_end|>\n" for has, r, _, x in s))
    return out


def rows_of(seed):
    rng = random.Random(seed)
    rows = []
    for c in range(40):
        n = rng.randrange(1, 9)
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"m{t}" if rng.random() < 0.8 else f"m{t}b") for t in range(n)]
    long = [(t, "user", f"say {t}") for t in range(700)]
    rows += [(100, *m) for m in long] + [(101, *m) for m in long[:600]] + [(102, *m) for m in long[:256]] + [(99, *m) for m in long]
    rows += [(103, t + 5, r, x) for t, r, x in long[:300]]                     # other turn numbers, same turns
    rows += [(None, 0, "user", "m0"), (None, None, None, None), (104, 0, None, ""), (105, 0, None, None), (106, 0, "", None),
             (107, 3, "user", "tie a"), (107, 3, "user", "tie b"), (107, 3, "user", "tie a"), (108, None, "user", "m0")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, k int").repartition(5)


def test_matches_brute_force(spark):
    rows = rows_of(1)
    parts = {}
    for r in chat.collapse_and_render(frame(spark, rows)).collect():
        parts.setdefault(r["conv_id"], []).append((r["part"], r["n_turns"], r["text"]))
    got = {c: (p[0][1], "".join(t for _, _, t in sorted(p))) for c, p in parts.items()}
    assert got == brute(rows)
    assert [p[0] for p in sorted(parts[99])] == [1, 2, 3]


def test_hot_turn_values_stay_in_bounded_parts(spark):
    """20,000 rows without a conv_id whose turns are 0 to 3, and a conversation with one turn value only."""
    rows = [(None, i % 4, "user", f"said {i:05d}") for i in range(20_000)] + [(1, None, "user", f"x{i:04d}") for i in range(1000)]
    parts = {}
    for r in chat.collapse_and_render(frame(spark, rows)).collect():
        assert r["text"].count("<|im_start|>") <= chat.BLOCK
        parts.setdefault(r["conv_id"], []).append((r["part"], r["n_turns"], r["text"]))
    assert [p[0] for p in sorted(parts[None])] == list(range(1, 80)) and len(parts[1]) == 4
    got = {c: (p[0][1], "".join(t for _, _, t in sorted(p))) for c, p in parts.items()}
    assert got == brute(rows)


def test_native_and_empty(spark):
    out = chat.collapse_and_render(frame(spark, rows_of(2)))
    out.count()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    assert chat.collapse_and_render(frame(spark, [])).count() == 0
