import random

from tests.llm.conftest import frame, words
from vectorloom.llm import decontam

ITEM = ("A train leaves Boston at 60 km per hour and meets the train that left Chicago 45 minutes later . "
        "How many km had Alice counted when both trains met near the old bridge of stone ?")


def bench(spark, items):
    return spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, pos string")


def brute(rows, items):
    """Every document window against every item window, by comparison of the windows themselves."""
    def split(text):
        t = decontam.template(text or "")
        tokens, kinds = [t.token(i) for i in range(len(t.at))], t.kinds
        out = []
        for i in range(len(tokens) - decontam.WINDOW + 1):
            here = [(int(kinds[j]), tokens[j]) for j in range(i, i + decontam.WINDOW)]
            slots = [x for x in here if x[0]]
            out.append((i, tuple(v for _, v in here), []))
            if slots and decontam.WINDOW - len(slots) >= decontam.LITERALS:
                out.append((i, tuple(k or v for k, v in here), slots))
        return out, len(tokens) - decontam.WINDOW + 1
    docs = []
    for d, t in rows:
        index = {}
        for _, key, slots in split(t)[0]:
            index.setdefault((key, bool(slots)), set()).add(tuple(slots))
        docs.append((d, index))
    found = set()
    for item, text in dict.fromkeys(items):
        mine, n = split(text)
        for d, index in docs:
            matches = sorted({(i, tuple(a), b) for i, key, a in mine for b in index.get((key, bool(a)), ())})
            good, changed = decontam.consistent(matches)
            if n > 0 and len(good) >= decontam.CONTAINMENT * n:
                found.add((d, item, n, len(good), changed))
    return found


def test_matches_brute_force(spark, messy, empty):
    rng = random.Random(8)
    rows, _ = messy
    other = ITEM.replace("Boston", "Dallas").replace("60", "75").replace("Alice", "Bob").replace("45", "30")
    rows = [r for r in rows if len(r[1] or "") < 5000] + [
        (901, words(rng, 40) + ". " + ITEM + " " + words(rng, 40)), (902, "Start. " + other + " end"),
        (903, ITEM.upper()), (904, words(rng, 10) + " " + ITEM), (905, ITEM[:60]),
        (906, ITEM.replace("train", "ship")), (907, other.replace("Chicago", "Dallas"))]
    items = [(1, ITEM), (1, ITEM), (2, None), (3, ""), (4, "too short item"), (5, words(rng, 30)), (None, words(rng, 12)), (6, rows[7][1])]
    got = {(r["doc_id"], r["item_id"], r["n_windows"], r["n_matched"], r["reparameterised"])
           for r in decontam.contaminated(frame(spark, rows), bench(spark, items)).collect()}
    assert got == brute(rows, items)
    by_doc = {g[0]: g for g in got if g[1] == 1}
    assert {901, 902, 903, 904} <= set(by_doc) and not {905, 906} & set(by_doc)
    assert by_doc[902][4] and not by_doc[901][4]
    clean = decontam.decontaminate(frame(spark, rows), bench(spark, items))
    bad = {g[0] for g in got}
    assert clean.columns == frame(spark, rows).columns
    assert clean.count() == sum(d not in bad for d, _ in rows)
    assert decontam.contaminated(empty, bench(spark, items)).count() == 0
    assert decontam.contaminated(frame(spark, rows), bench(spark, [])).count() == 0


def test_slot_consistency():
    same = [(0, [(1, "3")], [(1, "9")]), (1, [(1, "3")], [(1, "9")]), (2, [(1, "3")], [(1, "4")])]
    assert decontam.consistent(same) == ({0, 1}, True)
    merged = [(0, [(1, "3")], [(1, "9")]), (1, [(1, "5")], [(1, "9")])]
    assert decontam.consistent(merged)[0] == {0}


def test_exact_passages_are_all_found(spark):
    from vectorloom.sources.tables import read_table
    sf = "/root/testdata/sf0.1"
    docs, items = read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark").collect()
    want = {(d["doc_id"], i["item_id"]) for d in docs.collect() for i in items if i["text"] in d["text"]}
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, read_table(spark, sf, "benchmark")).collect()}
    assert want and want <= got and len(got - want) <= 0.02 * len(want)
