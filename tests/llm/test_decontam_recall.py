import random
import re

import pyarrow.parquet as pq

from tests.llm.conftest import frame, words
from vectorloom.llm import decontam

PAIRS = [
    ("A farmer owns twelve cows and buys seven more cows at the market , how many cows does he own after that day ?",
     "A farmer owns fifteen cows and buys nine more cows at the market , how many cows does he own after that day ?"),
    ("The rope is 15 m long and it is cut into pieces of 3 m , how many pieces of rope are there in the end ?",
     "The rope is 1,500 centimetres long and it is cut into pieces of 300 centimetres , how many pieces of rope are there in the end ?"),
    ("Un tren recorre 300 kilómetros en cinco horas y luego recorre otros 120 kilómetros , cuánto tiempo necesita en total si no para ?",
     "Un tren recorre 450 millas en ocho horas y luego recorre otros 90 millas , cuánto tiempo necesita en total si no para ?"),
    ("Il faut trois heures pour remplir un bassin avec 240 litres , combien faut il pour remplir un bassin avec 80 litres ?",
     "Il faut quatorze minutes pour remplir un bassin avec 32 gallons , combien faut il pour remplir un bassin avec 11 gallons ?"),
    ("Sie läuft vier Stunden lang und trinkt dabei 2 Liter , wie viel trinkt sie dann wohl wenn sie 9 Stunden lang läuft ?",
     "Sie läuft sechs Minuten lang und trinkt dabei 7 Milliliter , wie viel trinkt sie dann wohl wenn sie 80 Minuten lang läuft ?"),
]
#: Units that stand for one another when an item is given other parameters.
SWAP = {"km": "miles", "kg": "pounds", "hours": "minutes", "minutes": "hours", "days": "weeks", "dollars": "euros", "cm": "inches",
        "m": "feet", "heures": "minutes", "Stunden": "Minuten", "horas": "minutos", "jours": "semaines", "Tage": "Wochen", "días": "semanas"}


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def hits(spark, docs, items):
    found = decontam.contaminated(frame(spark, docs), bench(spark, items))
    return {(r["doc_id"], r["item_id"]) for r in found.select("doc_id", "item_id").collect()}


def with_slots(text, rng):
    """The text with a number, a quantity or a name after every four to eight of its words."""
    out, gap = [], 0
    for word in text.lower().split():
        out.append(word)
        gap += 1
        if gap >= 4 and rng.random() < 0.25 or gap == 8:
            number = rng.choice([str(rng.randrange(2, 900)), rng.choice(sorted(decontam.NUMBER_WORDS))])
            out.append(rng.choice([number, f"{number} {rng.choice(sorted(SWAP))}", "P" + "".join(rng.choice("aeioulmnr") for _ in range(5))]))
            gap = 0
    return " ".join(out)


def other_parameters(text, rng):
    """The text with every number, unit and name (one token for one) replaced, alike wherever it stands."""
    t, became, out, last = decontam.template(text), {}, [], 0
    spans = [m.span() for m in decontam._TOKEN.finditer(text)]
    slots = 0
    for j, kind in zip(t.at, t.kinds):
        a, b = spans[j]
        token = text[a:b]
        if kind == decontam.PLAIN or a and text[a - 1].isalpha():
            continue
        slots += 1
        if kind == decontam.NUMBER:
            new = str(rng.randrange(10, 99_999))
        elif kind == decontam.UNIT:
            new = SWAP.get(token, token)
        else:
            new = "Q" + "".join(rng.choice("aeioulmnr") for _ in range(6))
        out += [text[last:a], became.setdefault(token.lower(), new)]
        last = b
    return "".join(out) + text[last:], slots


def test_number_words_and_units_of_four_languages(spark):
    rng = random.Random(1)
    fill = lambda: words(rng, 40)
    docs = [(i, f"{fill()} . {new} {fill()}") for i, (_, new) in enumerate(PAIRS)] + [(100, fill())]
    assert hits(spark, docs, [(i, old) for i, (old, _) in enumerate(PAIRS)]) == {(i, i) for i in range(len(PAIRS))}


def test_lists_hold_no_stray_words():
    assert {"centimetres", "kilometers", "kilómetros", "zentimeter", "grams", "pounds", "stunden", "heures"} <= decontam.UNITS
    assert not {"", "the", "a", "an", "one", "un", "und", "de", "le", "el"} & (decontam.UNITS | decontam.NUMBER_WORDS)
    assert all(re.fullmatch(r"\S+", u) for u in decontam.UNITS)


def test_recall_of_items_with_other_parameters(spark, sf_dir):
    """All benchmark items, given slots, planted with other parameters: at least nine of ten are found by their own item."""
    rng = random.Random(2)
    items = [(r["item_id"], with_slots(r["text"], rng)) for r in pq.read_table(f"{sf_dir}/benchmark.parquet", columns=["item_id", "text"]).to_pylist() if r["text"]]
    docs = []
    for item, text in items:
        changed, slots = other_parameters(text, rng)
        if slots and changed != text:
            docs.append((item, words(rng, 30) + " .\n" + changed + "\n" + words(rng, 30)))
    found = hits(spark, docs, items)
    recall = sum((d, d) in found for d, _ in docs) / len(docs)
    print(f"recall {recall:.3f} of {len(docs)} items")
    assert docs and recall >= 0.9
