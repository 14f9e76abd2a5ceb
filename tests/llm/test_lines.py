import hashlib
import re
from collections import Counter, defaultdict

from tests.llm.conftest import frame
from vectorloom.llm import lines


def brute(rows):
    def key(line):
        k = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line)
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in k)
    rank = lambda d: (d is None, d or 0)
    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(rank(d))
    out = []
    for d, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if len(holders[key(x)]) < 2 or min(holders[key(x)]) == rank(d)]
        out.append((d, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept)))
    return out


def test_digest_and_rewrite_match_brute_force(messy):
    rows, docs = messy
    want = brute(rows)
    got = Counter(map(tuple, lines.line_digest(docs).collect()))
    assert got == Counter(w[:4] for w in want) and sum(w[2] for w in want) > 10
    out = lines.dedup_lines(docs)
    assert out.columns == docs.columns
    texts = Counter((r["doc_id"], r["text"] or "") for r in out.collect())
    assert texts == Counter((w[0], w[4]) for w in want)


def test_one_hot_line_over_many_partitions(spark):
    rows = [(i, f"the hot line of them all\nown line of document {i}") for i in range(1500)]
    docs = frame(spark, rows, 7)
    got = {tuple(r) for r in lines.line_digest(docs).collect()}
    assert got == {w[:4] for w in brute(rows)}


def test_emptied_documents_can_go(spark):
    rows = [(1, "a line that repeats\nand an own one here"), (2, "a line that repeats"), (3, "A LINE that repeats\n \n"), (4, ""), (5, None)]
    assert {r["doc_id"] for r in lines.dedup_lines(frame(spark, rows), drop_emptied=True).collect()} == {1, 4, 5}


def test_empty(empty):
    assert lines.line_digest(empty).count() == 0 and lines.dedup_lines(empty).count() == 0
