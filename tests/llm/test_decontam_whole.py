"""Leaks that a stricter reading of the templates lost."""

from tests.llm.conftest import frame
from tests.llm.test_decontam import bench
from vectorloom.llm import decontam

WORDS = ("Tom has 5 apples. Tom gives 2 apples to his sister. Ann buys 9 more apples at the market. "
         "How many apples do Tom and Ann have now?")


def change(text, **to):
    for a, b in to.items():
        text = text.replace(a.strip("_"), b)
    return text


def found(spark, docs, items):
    rows = decontam.contaminated(frame(spark, list(enumerate(docs))), bench(spark, list(enumerate(items)))).collect()
    return {(r["doc_id"], r["item_id"]): r for r in rows}


def test_names_that_open_a_sentence(spark):
    other = change(WORDS, Tom="Bob", Ann="Sue", _5="7", _2="3", _9="8")
    wrapped = other.replace(" and Sue", " and\nSue").replace("at the", "at\nthe")
    mixed = other.replace("Bob gives", "Jim gives").replace("do Bob", "do Kim").replace("Sue buys", "Pat buys")
    got = found(spark, [other, wrapped, mixed, WORDS], [WORDS])
    assert {(0, 0), (1, 0), (3, 0)} == set(got)
    assert got[0, 0]["n_matched"] == got[0, 0]["n_windows"] and got[0, 0]["reparameterised"]
    assert not got[3, 0]["reparameterised"]


def test_each_stretch_has_its_own_mapping(spark):
    one, two = change(WORDS, Tom="Bob", Ann="Sue", _5="7", _2="3", _9="8"), change(WORDS, Tom="Jim", Ann="Kim", _5="6", _2="4", _9="11")
    one_value = change(WORDS, Tom="Bob", Ann="Sue", _5="7", _2="7", _9="7")
    stray = one + " And so it went on for a very long while." * 40 + " Then Tom has 5 apples. Tom gives 2 apples to his dog."
    scattered = "Bob has 7 apples. Sue gives 3 apples to his sister. Tom buys 8 more apples at the market. How many apples do Kim and Jim have now?"
    docs = [one + "\n" + two, two + " " + one + " " + two, one_value, stray, scattered]
    got = found(spark, docs, [WORDS])
    assert {d for d, _ in got} == {0, 1, 2, 3}
    assert all(r["reparameterised"] for r in got.values())


def test_number_dense_items(spark):
    items = ["What is 14 + 7 * 3 - 4 / 2 + 9?", "Find the next number in the list 3, 8, 15, 24, 35, 48, 63, 80, 99, 120"]
    docs = ["Here: what is 15 + 8 * 6 - 3 / 1 + 5? I do not know.", "What is 15 - 8 * 6 + 3 * 1 - 5?",
            "Please find the next number in the list 2, 5, 10, 17, 26, 37, 50, 65, 82, 101 soon",
            "Find the next number in the list", "The table holds 2, 5, 10, 17, 26, 37, 50, 65, 82, 101 and no more",
            "- **" + items[0].replace("What", "*What*") + "** and more words"]
    got = found(spark, docs, items)
    assert set(got) == {(0, 0), (2, 1), (5, 0)}
    assert got[0, 0]["n_matched"] == got[0, 0]["n_windows"] and got[2, 1]["n_matched"] == got[2, 1]["n_windows"]


def test_short_items_and_unspaced_scripts(spark):
    items = ["What is 2 ^ 2?", "Define entropy.", "Name 3 rivers", "小明有五个苹果，小红给他三个，他一共有几个？", "请数到12然后停下来", "?!"]
    docs = ["Question: define entropy in your own words", "Name 7 rivers please", "问题：小明有五个苹果，小红给他三个，他一共有几个？答案", "小红",
            "请数到45然后停下来", "Well, what is 2 ^ 2? Four.", "entropy define", None, "x"]
    assert set(found(spark, docs, items)) == {(0, 1), (1, 2), (2, 3), (4, 4), (5, 0)}
