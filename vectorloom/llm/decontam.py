"""Benchmark decontamination by template: find items even with other numbers, names and units.

Texts and benchmark items are tokenised alike. Numbers (in digits or words), units after a number
and names (capitalised words inside a sentence) become typed placeholders, and
their values are kept as slots. Windows of ``WINDOW`` tokens are
hashed with their values, and once more as templates if they have a slot and at least
``LITERALS`` literal tokens (fewer say too little). Document windows that occur in the
benchmark are joined to it by hash. For each document and item the matched windows
vote on what each slot value of the item became; windows that contradict the vote,
or map two values of the item to one, do not count. A document is contaminated by an
item if at least ``CONTAINMENT`` of the item's windows are matched consistently.

A capitalised word that opens a sentence or line may be a name or not. It is hashed both ways, as a plain
word and as a name, in items and documents alike. Pairs that the plain reading does not settle are judged
once more with the windows of both readings, and then stretch by stretch; counts are those of the first of
the three that settled the pair, or of the best stretch.

A stretch holds the matches whose document position minus item position (their shift) fall in one range of
half the item's length; the ranges overlap by half, so a copy is whole in one of them if edits move it by no
more than a quarter of the item, and two copies in a row share none. Each stretch has a mapping of its own:
an item value becomes the document value with the most votes, a vote weighing as many as there are item
windows matched at its shift (ties: the unchanged value, then the smallest). Two item values may become one. Digits
right after a letter belong to a word ('w12x', 'F16'): in a stretch they must be the same on both sides.

Operators between operands are literal tokens. Windows of fewer than ``LITERALS`` literal tokens (lists, tables)
are not looked up as templates; hits beside a run of them carry the run's tokens, and in a stretch such a window
is matched, and votes, if it is the same template at the same shift as the hit. An item of such
windows only is found by its values.

An item of fewer than ``WINDOW`` tokens is one window of its own length, by its values and, with enough literal
tokens, as a template; documents are hashed by the lengths that such items have. Letters of
scripts written without spaces are tokens one by one.

Before the join a Bloom filter of fixed size, built from the benchmark's window hashes,
drops document windows that cannot match. It has no false negatives and its size does
not depend on the data, so the corpus's windows are not shuffled.

Defined results: null texts and items and those without tokens match nothing; an item of one word is found wherever
the word stands; repeated item rows count once, an item_id with two texts is judged by each;
rows with a null doc_id are judged like others (their id is null in the result); extra columns are
ignored by the match and kept by the filter; empty tables give an empty result.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from typing import Iterator, NamedTuple

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.common import BATCH_ROWS, few, map_rows, materialize

WINDOW = 5
LITERALS = 2
CONTAINMENT = 0.8
#: Bits of the Bloom filter, whatever the benchmark's size.
BLOOM_BITS = 1 << 26
#: Bloom positions per hash.
LEVELS = 3

# Units that count as placeholders after a number (fixed lists), of English, German, Spanish and French.
_SYMBOLS = """kg g mg lb lbs oz t km m cm mm mi ft in yd l ml cl dl s sec min h hr hrs % $ € £
mph kmh kph c f k w kw kwh mw v kv hz khz mhz ghz b kb mb gb tb pb rpm dpi px ha cal kcal kj j n pa bar psi mol"""
# Words, then the endings they take.
_WORDS = {
    "s": """ton pound ounce stone mile yard foot inch gallon pint quart cup teaspoon tablespoon acre hectare second minute hour day
            week month year decade century percent dollar euro cent penny degree calorie joule watt volt amp newton hertz knot
            tonelada libra onza milla yarda pulgada galón hora minuto segundo día semana año década siglo grado céntimo centavo caloría
            livre mille pouce gallon heure seconde jour semaine année siècle degré centime calorie tonne hectárea""",
    "n": "tonne stunde minute sekunde woche meile unze kalorie dekade gallone",
    "e en": "pfund tag monat jahr zoll fuß jahrhundert",
    "es": "mes dólar inch",
    "": """feet inches pennies centuries celsius fahrenheit kelvin prozent grad euro cent dollar mois ans pieds ciento
           zoll fuß hektar ampere jahrzehnt jahrzehnte""",
}
# Decimal prefixes go with every base of their language.
_DECIMAL = [("kilo centi milli deci micro nano mega giga", "meter metre gram liter litre gramme second watt volt hertz joule calorie", "s"),
            ("mega giga tera kilo peta", "byte bit pixel", "s"),
            ("kilo zenti milli dezi mikro nano", "meter gramm liter", "n s"),
            ("kiló centí milí decí", "metro", "s"), ("kilo centi mili deci", "metro gramo litro vatio voltio", "s"),
            ("kilo centi milli déci", "mètre gramme litre", "s")]
UNITS = frozenset([*_SYMBOLS.split(),
                   *(w + e for ends, words in _WORDS.items() for w in words.split() for e in ("", *ends.split())),
                   *(p + b + e for prefixes, bases, ends in _DECIMAL for p in ("", *prefixes.split()) for b in bases.split()
                     for e in ("", *ends.split()))])
# Words that are numbers (fixed lists): the same four languages. Those for one are articles too, and left out.
NUMBER_WORDS = frozenset("""
two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen
twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen
zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn
zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend
dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve
veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien mil
deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante cent mille
""".split()) - {"once", "neuf"}      # an English and a French word of other meaning

#: Thai, Lao, Myanmar, Khmer, kana, Han.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_LETTER = rf"[^\W\d_{_UNSPACED}]"
_TOKEN = re.compile(rf"\d+(?:[.,]\d+)*|{_LETTER}+(?:['’]{_LETTER}+)*|[{_UNSPACED}](?<=\w)|[%$€£]|[.!?\n。！？]"
                    # Operators with a number at a side, or signs that no prose has, spaced alike on both sides.
                    r"|[-+*/=<>^×÷−–](?:(?<=[\d)].)(?=[\d(])|(?<=[\d)] .)(?= [\w(])|(?<=[\w)] .)(?= [\d(]))"
                    r"|[+*=<>^×÷](?:(?<=[\w)].)(?=[\w(])|(?<=[\w)] .)(?= [\w(]))")
_SPACED = re.compile(_LETTER)
_SAME = {"×": "*", "÷": "/", "−": "-", "–": "-"}

#: What a token is: plain, number, unit or name as a template token; STOP ends a sentence and is none.
PLAIN, NUMBER, UNIT, NAME, STOP = range(5)
#: How a window was hashed: by its values, as a template, as a template with names that open a sentence.
#: RUN: found beside a hit (see ``beside``).
VALUE, STRICT, LOOSE, RUN = range(4)
#: Bound of a worker's token cache; a full cache is dropped, results do not depend on it.
CACHE_TOKENS = 500_000


class _Tokens(dict):
    """token -> eight bytes: the hash of its lower-case form, the kind it may be in the lowest three bits."""

    def __missing__(self, t: str) -> bytes:
        if len(self) >= CACHE_TOKENS:
            self.clear()
        low = _SAME.get(t) or t.lower()
        if t in ".!?\n。！？":
            kind = STOP
        elif t[0].isdigit() or low in NUMBER_WORDS:
            kind = NUMBER
        elif low in UNITS:
            kind = UNIT
        else:
            kind = NAME if t[0].isupper() and not (len(t) > 1 and t.isupper()) else PLAIN
        value = self[t] = (xxhash.xxh3_64_intdigest(low) >> 3 << 3 | kind).to_bytes(8, "little")
        return value


_CACHE = _Tokens()
_SIGNS = np.array([0, 1, 2, 3, 4], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(11)
#: Odd multipliers of the window's places.
_PLACES = [np.uint64(pow(0x9E3779B97F4A7C15, j + 1, 1 << 64)) for j in range(WINDOW)]


class Template(NamedTuple):
    """The tokens of a text but for sentence ends: where they are among ``found``, kinds and value hashes.
    ``loose`` are the kinds if capitalised words that open a sentence are names."""

    found: list[str]
    at: np.ndarray
    kinds: np.ndarray
    values: np.ndarray
    loose: np.ndarray

    def token(self, i: int) -> str:
        return self.found[self.at[i]].lower()

    def fixed(self, i: int, reading: int, inner: np.ndarray, size: int = WINDOW) -> int:
        """Bits of window ``i``'s slots that are ``inner`` (see ``in_words``)."""
        if reading == VALUE:
            return 0
        kinds = self.loose if reading == LOOSE else self.kinds
        slots = [j for j in range(i, i + size) if kinds[j] != PLAIN]
        return sum(1 << b for b, j in enumerate(slots) if inner[j])

    def slots(self, i: int, reading: int, size: int = WINDOW) -> list[tuple[int, str]]:
        """(kind, value) of window ``i``'s slots; none for a window by its values."""
        if reading == VALUE:
            return []
        kinds = self.loose if reading == LOOSE else self.kinds
        return [(int(kinds[j]), self.token(j)) for j in range(i, i + size) if kinds[j] != PLAIN]


def in_words(text: str, t: Template) -> np.ndarray:
    """Which of the template's tokens are digits right after a letter."""
    starts = [m.start() for m in _TOKEN.finditer(text)]
    return np.array([bool(k == NUMBER and starts[j] and _SPACED.match(text[starts[j] - 1])) for j, k in zip(t.at, t.kinds)], dtype=bool)


def template(text: str) -> Template:
    """A unit counts as one right after a number, a name inside a sentence; elsewhere both are plain."""
    found = _TOKEN.findall(text)
    packed = np.frombuffer(b"".join(map(_CACHE.__getitem__, found)), dtype="<u8")
    kinds = (packed & np.uint64(7)).astype(np.int64)
    before = np.r_[STOP, kinds[:-1]]
    kinds[(kinds == UNIT) & (before != NUMBER)] = PLAIN
    at = np.flatnonzero(kinds != STOP)
    loose = kinds[at]
    return Template(found, at, np.where((loose == NAME) & (before[at] == STOP), PLAIN, loose),
                    packed[at] >> np.uint64(3), loose)


def poor(t: Template) -> np.ndarray:
    """Which windows have a slot and fewer than ``LITERALS`` literal tokens, names that open a sentence as slots."""
    slots = np.cumsum(np.r_[0, t.loose != PLAIN])
    return WINDOW - (slots[WINDOW:] - slots[:-WINDOW]) < LITERALS


def context(t: Template, i: int, few: np.ndarray, inner: np.ndarray) -> str | None:
    """JSON of (windows of the run of poor windows left of ``i``, tokens from that run's start to the end of the run
    right of ``i``); none if there is no run, or ``i`` is poor itself. A token is (kind, value, whether inside a word)."""
    if few[i]:
        return None
    low, high = i, i + 1
    while low and few[low - 1]:
        low -= 1
    while high < len(few) and few[high]:
        high += 1
    if high - low == 1:
        return None
    return json.dumps([i - low, [(int(t.loose[j]), t.token(j), bool(inner[j])) for j in range(low, high - 1 + WINDOW)]])


def beside(pos: int, at: int, item: str, doc: str) -> Iterator[tuple]:
    """Matches of the poor windows beside the hit of item position ``pos`` and document position ``at``."""
    (a, mine), (b, other) = json.loads(item), json.loads(doc)
    for k in range(-min(a, b), min(len(mine) - a, len(other) - b) - WINDOW + 1):
        pairs = list(zip(mine[a + k:a + k + WINDOW], other[b + k:b + k + WINDOW]))
        if k and all(x[0] == y[0] and (x[0] != PLAIN or x[1] == y[1]) for x, y in pairs):
            slots = [(x, y) for x, y in pairs if x[0] != PLAIN]
            yield (RUN, pos + k, at + k, [x[:2] for x, _ in slots], [y[:2] for _, y in slots],
                   sum(1 << j for j, (x, y) in enumerate(slots) if x[2] or y[2]))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(values: np.ndarray, n: int, salt: int, size: int = WINDOW) -> np.ndarray:
    out = np.full(n, salt + 16 * (WINDOW - size), dtype=np.uint64)
    for j in range(size):
        out += values[j:j + n] * _PLACES[j]
    return _mix(out)


def windows(t: Template, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, hashes, readings) of the windows of ``size`` tokens: every window by its values, and as a template if it has a slot and
    ``LITERALS`` literal tokens or more; once more where names that open a sentence make another template."""
    n = len(t.kinds) - size + 1
    if n < 1:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at, hashes, readings = [np.arange(n)], [_hashes(t.values, n, 1, size)], [np.full(n, VALUE)]
    other = np.cumsum(np.r_[0, t.kinds != t.loose])
    for reading, kinds in ((STRICT, t.kinds), (LOOSE, t.loose)):
        slot = kinds != PLAIN
        if not slot.any() or reading == LOOSE and not other[-1]:
            continue
        slots = np.cumsum(np.r_[0, slot])
        here = slots[size:] - slots[:-size]
        use = (here > 0) & (size - here >= LITERALS)
        if reading == LOOSE:
            use &= other[size:] > other[:-size]
        slotted = np.flatnonzero(use)
        at.append(slotted)
        hashes.append(_hashes(np.where(slot, _SIGNS[kinds], t.values), n, 2, size)[slotted])
        readings.append(np.full(len(slotted), reading))
    return np.concatenate(at), np.concatenate(hashes).view(np.int64), np.concatenate(readings)


def item_windows(benchmark: DataFrame) -> DataFrame:
    """hash, item_id, ikey (hash of the item's text), pos, n (windows of the item), size (tokens of a window), reading,
    slots (JSON), fixed (bits of the slots inside words), run (see ``context``)."""
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out = {k: [] for k in ("hash", "item_id", "ikey", "pos", "n", "size", "reading", "slots", "fixed", "run")}
            for item, key, text in zip(b["item_id"].to_pylist(), b["ikey"].to_pylist(), b["text"].to_pylist()):
                t = template(text)
                size = min(WINDOW, len(t.kinds))
                if not size:
                    continue
                n, inner = len(t.kinds) - size + 1, in_words(text, t)
                few = poor(t) if size == WINDOW else np.zeros(1, dtype=bool)
                for i, h, reading in zip(*(x.tolist() for x in windows(t, size))):
                    for k, v in zip(out, (h, item, key, i, n, size, reading, json.dumps(t.slots(i, reading, size)),
                                         t.fixed(i, reading, inner, size), context(t, i, few, inner))):
                        out[k].append(v)
            yield out

    rows = (benchmark.filter("text is not null").select("item_id", "text").distinct()
            .select("item_id", F.xxhash64("text").alias("ikey"), "text"))
    found = map_rows(rows, run, "hash long, item_id long, ikey long, pos int, n int, size int, reading int, "
                                "slots string, fixed int, run string")
    return materialize(few(found, benchmark.count(), BATCH_ROWS), "item-windows")


def _place(hashes: np.ndarray, level: int) -> np.ndarray:
    """Bloom position of signed 64-bit hashes at one level."""
    x = hashes.view(np.uint64)
    return ((x + np.uint64(level) * ((x >> np.uint64(32)) | np.uint64(1))) & np.uint64(BLOOM_BITS - 1)).astype(np.int64)


def hits(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Numbers of the hashes that the filter lets through."""
    left = np.arange(len(hashes))
    for level in range(LEVELS):
        place = _place(hashes[left], level)
        left = left[((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(bool)]
    return left


def bloom(items: DataFrame) -> np.ndarray:
    """Bit array of the items' window hashes: one fixed-size array per task, or-ed on the way."""
    def fill(batches: Iterator[dict]) -> Iterator[dict]:
        bits = np.zeros(BLOOM_BITS // 8, dtype=np.uint8)
        for b in batches:
            hashes = np.array(b["hash"].to_numpy(), dtype=np.int64)
            places = np.concatenate([_place(hashes, level) for level in range(LEVELS)])
            np.bitwise_or.at(bits, places >> 3, (1 << (places & 7)).astype(np.uint8))
        at = np.flatnonzero(bits)
        for i in range(0, len(at), 1 << 16):
            yield {"at": at[i:i + (1 << 16)].tolist(), "byte": bits[at[i:i + (1 << 16)]].astype(np.int16).tolist()}

    rows = map_rows(items.select("hash"), fill, "at int, byte short").groupBy("at").agg(F.bit_or("byte").alias("byte"))
    bits = np.zeros(BLOOM_BITS // 8, dtype=np.uint8)
    got = rows.toPandas()       # at most BLOOM_BITS / 8 rows
    bits[got["at"].to_numpy(dtype=np.int64)] = got["byte"].to_numpy().astype(np.uint8)
    return bits


def document_windows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """hash, doc_id, tkey, dpos, reading, slots, fixed, run of the document windows that pass the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom(items))
    sizes = sorted({r["size"] for r in items.select("size").distinct().collect()} - {WINDOW})     # fewer than WINDOW rows

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        bits = shared.value
        for b in batches:
            out = {k: [] for k in ("hash", "doc_id", "tkey", "dpos", "reading", "slots", "fixed", "run")}
            for doc, key, text in zip(b["doc_id"].to_pylist(), b["tkey"].to_pylist(), b["text"].to_pylist()):
                t = template(text)
                at, hashes, readings = windows(t)
                left = hits(bits, hashes)
                for size in sizes:
                    places, short, how = windows(t, size)
                    for i in hits(bits, short):
                        pos, reading = int(places[i]), int(how[i])
                        for k, v in zip(out, (int(short[i]), doc, key, pos, reading, json.dumps(t.slots(pos, reading, size)),
                                              0, None)):
                            out[k].append(v)
                few = poor(t) if len(left) else None
                inner = in_words(text, t) if len(left) and (readings[left].any() or few.any()) else None
                for i in left:
                    pos, reading = int(at[i]), int(readings[i])
                    for k, v in zip(out, (int(hashes[i]), doc, key, pos, reading, json.dumps(t.slots(pos, reading)),
                                          t.fixed(pos, reading, inner), context(t, pos, few, inner))):
                        out[k].append(v)
            yield out

    rows = docs.filter("text is not null").select("doc_id", F.xxhash64("text").alias("tkey"), "text")
    return map_rows(rows, run, "hash long, doc_id long, tkey long, dpos int, reading int, slots string, "
                               "fixed int, run string")


def consistent(matches: list[tuple[int, list, list]]) -> tuple[set[int], bool]:
    """(item positions matched consistently, whether a slot changed its value).

    ``matches``: (item position, item slots, document slots). Each item value becomes the document value with
    the most votes (ties: the smallest); a document value is given to the item
    value with the most votes for it.
    """
    votes: dict[tuple, Counter] = defaultdict(Counter)
    for _, item, doc in matches:
        for (kind, a), (_, b) in zip(item, doc):
            votes[kind, a][b] += 1
    became, taken = {}, {}
    for (kind, a), c in sorted(votes.items(), key=lambda v: (-max(v[1].values()), v[0])):
        for b, _ in sorted(c.items(), key=lambda x: (x[0] != a, -x[1], x[0])):
            if taken.get((kind, b), a) == a:
                became[kind, a], taken[kind, b] = b, a
                break
    good, changed = set(), False
    for pos, item, doc in matches:
        if all(became.get((kind, a)) == b for (kind, a), (_, b) in zip(item, doc)):
            good.add(pos)
            changed = changed or any(a != b for (_, a), (_, b) in zip(item, doc))
    return good, changed


def unfixed(match: tuple) -> bool:
    """Whether the slots inside words are the same on both sides."""
    *_, item, doc, fixed = match
    return not fixed or all(a == b for j, ((_, a), (_, b)) in enumerate(zip(item, doc)) if fixed >> j & 1)


def stretches(matches: list[tuple], n: int) -> Iterator[list[tuple]]:
    """The matches by ranges of their shift, each range half an item long and overlapping the next by half."""
    step = max(1, (n + WINDOW - 1) // 4)
    found = defaultdict(list)
    for m in matches:
        k = (m[2] - m[1]) // step
        found[k].append(m)
        found[k - 1].append(m)
    yield from (found[k] for k in sorted(found))


def aligned(matches: list[tuple]) -> tuple[set[int], bool]:
    """As ``consistent``, for one stretch: votes weigh by their shift, and item values may become one value."""
    weight: dict[int, set] = defaultdict(set)
    for _, pos, at, *_ in matches:
        weight[at - pos].add(pos)
    votes: dict[tuple, Counter] = defaultdict(Counter)
    for _, pos, at, item, doc, _ in matches:
        for (kind, a), (_, b) in zip(item, doc):
            votes[kind, a][b] += len(weight[at - pos])
    became = {(kind, a): min(c, key=lambda b: (-c[b], b != a, b)) for (kind, a), c in votes.items()}
    good, changed = set(), False
    for _, pos, _, item, doc, _ in matches:
        if all(became[kind, a] == b for (kind, a), (_, b) in zip(item, doc)):
            good.add(pos)
            changed = changed or any(a != b for (_, a), (_, b) in zip(item, doc))
    return good, changed


def judged(matches: list[tuple[int, int, int, list, list, int]], n: int) -> tuple[int, bool] | None:
    """(windows matched, whether a slot changed its value) if the matches contaminate, else None.

    ``matches``: (reading, item position, document position, item slots, document slots, bits of the slots
    inside words on either side), the reading LOOSE if either side's is.
    """
    if len({m[1] for m in matches}) < CONTAINMENT * n:
        return None
    for readings in ((VALUE, STRICT), (VALUE, STRICT, LOOSE)):
        # Over the whole document a match counts once, wherever and however often it stands.
        once = {(m[1], str(m[3]), str(m[4])): (m[1], m[3], m[4]) for m in matches if m[0] in readings}
        good, changed = consistent(list(once.values()))
        if len(good) >= CONTAINMENT * n:
            return len(good), changed
    best = None
    for stretch in stretches(list(filter(unfixed, matches)), n):
        if len({m[1] for m in stretch}) >= CONTAINMENT * n:
            good, changed = aligned(stretch)
            if len(good) >= CONTAINMENT * n:
                best = max(best or (0, False), (len(good), changed))
    return best


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, tkey, item_id, n_windows, n_matched, containment, reparameterised per contaminated pair."""
    items = item_windows(benchmark)
    found = document_windows(docs, items)
    joined = found.join(items.select("hash", "item_id", "ikey", F.col("pos").alias("ipos"), "n",
                                     F.col("reading").alias("ireading"), F.col("slots").alias("islots"), F.col("fixed").alias("ifixed"), F.col("run").alias("irun")), "hash")
    order = ["tkey", "doc_id", "item_id", "ikey"]
    columns = (*order, "ipos", "n", "dpos", "reading", "islots", "slots", "fixed", "irun", "run")
    joined = (joined.withColumn("reading", F.greatest("reading", "ireading"))
              .withColumn("fixed", F.col("fixed").bitwiseOR(F.col("ifixed"))))
    dealt = joined.select(*columns).distinct().repartition(*order).sortWithinPartitions(*order)

    def judge(batches: Iterator[dict]) -> Iterator[dict]:
        key, n, matches, runs = None, 0, [], {}
        names = ("doc_id", "tkey", "item_id", "n_windows", "n_matched", "containment", "reparameterised")

        def verdict() -> Iterator[tuple]:
            if found := judged(matches + list(runs.values()), n):
                good, changed = found
                yield key[1], key[0], key[2], n, good, good / n, changed

        for b in batches:
            rows: list[tuple] = []
            for *k, ipos, size, dpos, reading, islots, slots, fixed, irun, run in zip(*(b[c].to_pylist() for c in columns)):
                if k != key:
                    if key is not None:
                        rows.extend(verdict())
                    key, n, matches, runs = k, size, [], {}
                matches.append((reading, ipos, dpos, json.loads(islots), json.loads(slots), fixed))
                if irun and run:
                    runs.update((m[1:3], m) for m in beside(ipos, dpos, irun, run))
            if rows:
                yield dict(zip(names, map(list, zip(*rows))))
        if key is not None and (rows := list(verdict())):
            yield dict(zip(names, map(list, zip(*rows))))

    return map_rows(dealt, judge, "doc_id long, tkey long, item_id long, n_windows long, n_matched long, "
                                  "containment double, reparameterised boolean")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated rows, all columns kept."""
    bad = (contaminated(docs, benchmark).select(F.col("doc_id").alias("__bad_doc"), F.col("tkey").alias("__bad_tkey"))
           .distinct())
    on = docs["doc_id"].eqNullSafe(bad["__bad_doc"]) & (F.xxhash64(docs["text"]) == bad["__bad_tkey"])
    return few(docs.join(bad.hint("shuffle_hash"), on, "left_anti"), docs.count())


__all__ = ["consistent", "contaminated", "decontaminate", "template", "windows"]
