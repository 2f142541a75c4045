r"""Operator 10: benchmark decontamination by template canonicalisation.

*Templates* (``tokens``, ``joined``): a text is words without their outer punctuation, in lower case; each Chinese or Japanese character is a word. A
word that begins with a digit or is a number word becomes the placeholder NUMBER, a unit after a number UNIT, a capitalised word inside a sentence NAME; every other
word stands for itself. Neighbouring names are one NAME and neighbouring number words one NUMBER, so Mary Ann can stand for Alice and two hundred for 45.
Windows of ``window`` tokens are hashed; windows with fewer than half their tokens literal identify no template and are left out.
An item of fewer than ``window`` tokens is one window of its own length. An item of fewer than four tokens, or without a window that
identifies a template (number sequences, tables, lists of names), is met by value: its windows are hashed with the words that stand in them,
so only equal words match, whatever their kind. ``unmatchable`` lists the items that hold no word at all.

*Hash join*: the windows of a block of benchmark items are a sorted hash array that each task probes with all
windows of all its texts. A block is about ``block_words`` words of six bytes, by bytes, which bounds what is sent to tasks; a larger benchmark is
taken in as many blocks as it needs, one after the other, each with a pass over the texts, and the items found in each are put together by document.

*Slot consistency* (``_judge``): where windows of an item are met, placeholders pair a value of the item with one of the text. A match counts
if each value of the item stands for one value only. An item is leaked into a text if windows that match consistently make up
``share`` of its windows, along one alignment or all together; ``exact`` if all paired values are equal.

Defined results: null and empty texts and null items match nothing; items that are equal are all named; an item_id that repeats
is named once; null item_ids are left out; an empty benchmark finds nothing. Rows of docs that repeat give equal rows.
Only the named columns are read, so others can't clash.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import _LOWER, CHUNK_BYTES, Spans, mix, runs, utf8, words
from .common import cut_lineage, small_batches

#: Units that may follow a number (fixed values).
UNITS = (
    "%", "mm", "cm", "m", "km", "in", "inch", "inches", "ft", "feet", "yd", "yards", "mi", "mile", "miles", "metre", "metres", "meter", "meters", "kilometre", "kilometres", "kilometer", "kilometers",
    "mg", "g", "kg", "t", "lb", "lbs", "oz", "gram", "grams", "kilogram", "kilograms", "pound", "pounds", "ounce", "ounces", "ton", "tons", "ml", "cl", "l", "litre", "litres", "liter", "liters", "gallon", "gallons",
    "ms", "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hr", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "dollar", "dollars", "euro", "euros", "cent", "cents", "usd", "eur", "percent", "degrees", "mph", "kmh", "kb", "mb", "gb", "tb", "hz", "w", "kw", "v", "a", "j",
)
#: Number words (fixed values); tens and ones also with a hyphen between.
ONES = "one two three four five six seven eight nine".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
NUMBER_WORDS = (
    *ONES, *TENS, *(f"{t}-{o}" for t in TENS for o in ONES), *"zero ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen hundred thousand million billion dozen".split(),
    *"〇零一二三四五六七八九十百千万亿两",
)
NUMBER, UNIT, NAME = (np.uint64(x) for x in mix(np.array([11, 12, 13], np.uint64)))
#: Items of fewer tokens are met by value.
SHORTEST = 4
_BY_VALUE = mix(np.array([17], np.uint64))[0]
_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_WORD = _DIGIT | _UPPER
_WORD[97:123] = True
_WORD[128:] = True
_STOP = np.zeros(256, bool)
_STOP[[0x2E, 0x3F, 0x21, 0x3A, 0x0A]] = True


def _lowered(text: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the letters of Latin-1, byte by byte."""
    out = _LOWER[text]
    after = np.r_[False, text[:-1] == 0xC3]
    out[after & (text >= 0x80) & (text <= 0x9E) & (text != 0x97)] += 0x20
    return out


def _hashes_of(listed: tuple[str, ...]) -> np.ndarray:
    data = np.frombuffer("".join(listed).encode(), np.uint8)
    ends = np.cumsum([len(u.encode()) for u in listed])
    return np.sort(Spans(data)(np.r_[0, ends[:-1]], ends))


def _single_characters(text: np.ndarray, first: np.ndarray, last: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words cut around each Chinese or Japanese character (three bytes from U+3000 to U+9FFF), and without their punctuation."""
    at = np.flatnonzero((text >= 0xE3) & (text <= 0xE9) | (text == 0xEF))
    if not len(at):
        return first, last, piece
    begin = np.unique(np.concatenate((first, at, at + 3)))
    word = np.searchsorted(first, begin, "right") - 1
    begin, word = begin[(word >= 0) & (begin < last[word])], word[(word >= 0) & (begin < last[word])]
    end = np.minimum(np.r_[begin[1:], last[-1:]], last[word])
    second = text[np.minimum(begin + 1, len(text) - 1)]
    sign = (text[begin] == 0xE3) & (second == 0x80) | (text[begin] == 0xEF) & ((second == 0xBC) | (second == 0xBD))
    return begin[~sign], end[~sign], piece[word[~sign]]


def tokens(data: np.ndarray, begin: np.ndarray, end: np.ndarray):
    """Of each word that has a letter or digit: token, literal flag, piece, the stripped word's bytes (begin, end), its own hash, and whether it goes on with the placeholder before."""
    first, last, piece = words(data, begin, end)
    origin = int(begin[0])
    text = data[origin : int(end[-1])]
    first, last, piece = _single_characters(text, first - origin, last - origin, piece)
    solid = np.flatnonzero(_WORD[text])
    if not len(first) or not len(solid):
        return None
    left = np.searchsorted(solid, first)
    right = np.searchsorted(solid, last) - 1
    percent = (last - first == 1) & (text[first] == 0x25)
    keep = (left <= right) | percent
    if not keep.any():
        return None
    bare = percent[keep]
    a = np.where(bare, first[keep], solid[np.minimum(left[keep], len(solid) - 1)])
    b = np.where(bare, last[keep], solid[right[keep]] + 1)
    piece = piece[keep]
    lowered = _lowered(text)
    token = value = Spans(lowered)(a, b)
    spelled = np.isin(token, _hashes_of(NUMBER_WORDS))
    number = _DIGIT[text[a]] | spelled
    follows = np.r_[False, piece[1:] == piece[:-1]]
    unit = np.r_[False, number[:-1]] & follows & np.isin(token, _hashes_of(UNITS))
    stops = np.r_[0, np.cumsum(_STOP[text])]
    inside = follows & (np.r_[0, stops[a[1:]] - stops[b[:-1]]] == 0)
    upper = np.r_[0, np.cumsum(_UPPER[text])]
    latin = (text[a] == 0xC3) & (lowered[np.minimum(a + 1, len(text) - 1)] != text[np.minimum(a + 1, len(text) - 1)])
    name = inside & ~number & ~unit & (_UPPER[text[a]] | latin) & (upper[b] - upper[a] == _UPPER[text[a]]) & (b - a > 1)
    token = np.select([number, unit, name], [NUMBER, UNIT, NAME], token)
    goes_on = inside & (np.r_[False, name[1:] & name[:-1]] | np.r_[False, spelled[1:] & spelled[:-1]])
    return token, ~(number | unit | name), piece, a + origin, b + origin, value, goes_on


def joined(found) -> tuple[np.ndarray, ...]:
    """Token, literal flag, piece, begin and end, with neighbouring names, and neighbouring number words, as one token."""
    token, literal, piece, a, b, _, goes_on = found
    starts = np.flatnonzero(~goes_on)
    return token[starts], literal[starts], piece[starts], a[starts], b[np.r_[starts[1:] - 1, len(b) - 1]]


def windows(token: np.ndarray, literal: np.ndarray, piece: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin (as a word index) and hash of each window that has enough literal words."""
    n = len(token) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.full(n, np.uint64(size))
    for k in range(size):
        h = h * _MULTIPLIER + token[k : k + n]
    counts = np.r_[0, np.cumsum(literal)]
    good = np.flatnonzero((piece[:n] == piece[size - 1 :]) & (2 * (counts[size:] - counts[:-size]) >= size))
    return good, mix(h[good])


def windows_by_value(value: np.ndarray, piece: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and hash of each window, by the words themselves."""
    at, h = windows(value, np.ones(len(value), bool), piece, size)
    return at, h ^ _BY_VALUE


def _value(span: np.ndarray) -> bytes:
    """What stands in a placeholder, in lower case, with single spaces."""
    return b" ".join(bytes(span).lower().split())


class Probe:
    """Sorted window hashes of a block of items."""

    def __init__(self, items: list[tuple[int, str]], window: int, share: float):
        self.share, self.window = share, window
        self.ids, self.words, self.sizes, self.total, self.by_value = [], [], [], [], []
        hashes, owner, place = [], [], []
        for item_id, text in items:
            raw = np.frombuffer(text.encode(), np.uint8)
            found = tokens(raw, np.array([0]), np.array([len(raw)])) if len(raw) else None
            if found is None or len(found[0]) < 2:
                continue
            token, literal, piece, a, b = joined(found)
            size = min(window, len(token))
            at, h = windows(token, literal, piece, size)
            by_value = len(token) < SHORTEST or not len(at)
            slots = {}
            if by_value:
                size = min(window, len(found[0]))
                at, h = windows_by_value(found[5], found[2], size)
            else:
                slots = {i: _value(raw[a[i] : b[i]]) for i in np.flatnonzero(~literal).tolist()}
            hashes.append(h)
            owner.append(np.full(len(at), len(self.ids)))
            place.append(at)
            self.ids.append(item_id)
            self.words.append(slots)
            self.sizes.append(size)
            self.total.append(len(at))
            self.by_value.append(by_value)
        self.hashes, self.owner, self.place = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((hashes, np.uint64), (owner, np.int64), (place, np.int64)))
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.owner, self.place = self.hashes[order], self.owner[order], self.place[order]
        self.lengths = sorted(set(zip(self.sizes, self.by_value, strict=True)))

    def hits(self, found, whole):
        """First word (token, where not by value) of each window of the text that some item has, the item and the place in it."""
        for size, by_value in self.lengths:
            at, h = windows_by_value(found[5], found[2], size) if by_value else windows(*whole[:3], size)
            low = np.searchsorted(self.hashes, h)
            met = np.flatnonzero(self.hashes[np.minimum(low, len(self.hashes) - 1)] == h)
            for i in met.tolist():
                high = int(np.searchsorted(self.hashes, h[i], "right"))
                for k in range(int(low[i]), high):
                    if (self.sizes[self.owner[k]], self.by_value[self.owner[k]]) == (size, by_value):
                        yield int(at[i]), int(self.owner[k]), int(self.place[k])


def _judge(probe: Probe, item: int, met: set[tuple[int, int, tuple]]) -> tuple[float, bool] | None:
    """Share of the item's windows that match consistently, and whether all values are equal; None if it isn't leaked.

    met: (alignment, place in the item, values of the text's placeholders).
    """
    lines = defaultdict(set)
    for line, place, values in met:
        lines[line].add((place, values))
    best = None
    for group in [*lines.values(), {x for g in lines.values() for x in g}]:
        if len({p for p, _ in group}) < probe.share * probe.total[item]:
            continue
        stands, exact, consistent = {}, True, True
        for place, values in group:
            own = [probe.words[item][i] for i in range(place, place + probe.sizes[item]) if i in probe.words[item]] if values else []
            for x, y in zip(own, values, strict=True):
                consistent &= stands.setdefault(x, y) == y
                exact &= x == y
        if consistent and (best is None or (exact, len(group)) > best[1:]):
            best = (len({p for p, _ in group}) / probe.total[item], exact, len(group))
    return best[:2] if best else None


def _leaks(probe: Probe):
    """Batches (text) to one list of (item, share, exact) for each row."""

    def long_text(data, begin, stop):
        """Pieces of a text that is too long for one, each of which repeats the last words of the one before."""
        size = CHUNK_BYTES
        while True:
            until = min(begin + size, stop)
            found = tokens(data, np.array([begin]), np.array([until]))
            if until == stop:
                return (yield found)
            cut = None if found is None else joined(found)[3]
            if cut is None or len(cut) < 4 * probe.window or cut[-2 * probe.window] <= begin:
                size *= 2  # few words, or very long ones
                continue
            # the last token may be cut: it is left to the next piece
            yield tuple(x[found[3] < cut[-1]] for x in found)
            begin, size = int(cut[-2 * probe.window]), CHUNK_BYTES

    def run(data, offsets):
        met = defaultdict(set)
        for i, j in runs(offsets):
            if offsets[i] == offsets[j]:
                continue
            if j - i > 1 or offsets[j] - offsets[i] <= 2 * CHUNK_BYTES:
                found = [tokens(data, offsets[i:j], offsets[i + 1 : j + 1])]
            else:
                found = long_text(data, int(offsets[i]), int(offsets[j]))
            for part in found:
                if part is None:
                    continue
                whole = joined(part)
                _, literal, piece, a, b = whole
                for at, item, place in probe.hits(part, whole):
                    if probe.by_value[item]:
                        row, values = part[2][at], ()
                    else:
                        row, values = piece[at], tuple(_value(data[a[k] : b[k]]) for k in range(at, at + probe.sizes[item]) if not literal[k])
                    met[i + int(row), item].add((at - place, place, values))
        rows = defaultdict(list)
        for (row, item), places in sorted(met.items()):
            if verdict := _judge(probe, item, places):
                rows[row].append((probe.ids[item], *verdict))
        return rows

    return run


LEAKS = "array<struct<item_id:bigint,share:double,exact:boolean>>"


def _items(benchmark: DataFrame, item_id: str, item_text: str) -> DataFrame:
    return benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null and text is not null")


def probes(benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text", window: int = 8, share: float = 0.4, block_words: int = 1_000_000):
    """A probe for each block of items of about block_words words of six bytes; a block is gathered only when it is used."""
    items = _items(benchmark, item_id, item_text)
    n = int((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (6 * block_words)) + 1
    for k in range(n):
        block = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield n, Probe([(r.item_id, r.text) for r in block.dropDuplicates().orderBy("item_id", "text").toLocalIterator()], window, share)


def unmatchable(benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id of the items that nothing can match: null texts, and texts of no word or one, which would condemn every text with that word."""

    def run(batches):
        for batch in batches:
            empty = []
            for text in batch.column(1).to_pylist():
                raw = np.frombuffer((text or "").encode(), np.uint8)
                found = tokens(raw, np.array([0]), np.array([len(raw)])) if len(raw) else None
                empty.append(found is None or len(found[0]) < 2)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(empty, pa.bool_()))], ["item_id"])

    return benchmark.select(F.col(item_id).cast("long"), F.col(item_text)).mapInArrow(run, "item_id long")


def _in_blocks(rows: DataFrame, benchmark: DataFrame, how: dict) -> DataFrame:
    """doc_id, print, leaks of the rows (doc_id, print, text) that hold an item: a job for each block, so that tasks hold one block at a time."""
    some = None
    for _, probe in probes(benchmark, **how):
        shared = rows.sparkSession.sparkContext.broadcast(probe)
        part = cut_lineage(rows.mapInArrow(_listed(shared, 2), f"doc_id long, print long, leaks {LEAKS}").where(F.size("leaks") > 0))
        shared.unpersist()
        some = part if some is None else some.unionByName(part)
    return some.select("doc_id", "print", F.explode("leaks").alias("x")).distinct().groupBy("doc_id", "print").agg(F.sort_array(F.collect_list("x")).alias("leaks"))


def _printed(doc_id: str, text: str) -> list:
    return [F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("print")]


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """doc_id, leaks (item_id, share, exact), contaminated for each row of docs."""
    small_batches(docs.sparkSession)
    n, probe = next(probes(benchmark, **how))
    if n == 1:
        rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        whole = rows.mapInArrow(_listed(docs.sparkSession.sparkContext.broadcast(probe)), f"doc_id long, leaks {LEAKS}")
    else:
        # equal keys are equal texts
        rows = docs.select(*_printed(doc_id, text), F.col(text).alias("text"))
        some = _in_blocks(rows, benchmark, how)
        keyed = rows.select("doc_id", "print")
        same = keyed.doc_id.eqNullSafe(some.doc_id) & (keyed.print == some.print)
        whole = keyed.join(some, same, "left").select(keyed.doc_id, F.coalesce("leaks", F.array().cast(LEAKS)).alias("leaks"))
    return whole.withColumn("contaminated", F.size("leaks") > 0)


def _listed(shared, at_text: int = 1):
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("share", pa.float64()), ("exact", pa.bool_())]))

    def run(batches):
        for batch in batches:
            found = _leaks(shared.value)(*utf8(batch.column(at_text))) if shared.value.ids else {}
            lists = [[{"item_id": a, "share": s, "exact": e} for a, s, e in found.get(i, ())] for i in range(batch.num_rows)]
            names = ["doc_id", "print"][:at_text]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(at_text)), pa.array(lists, kind)], [*names, "leaks"])

    return run


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", **how) -> DataFrame:
    """docs without the rows that hold a benchmark item."""
    small_batches(docs.sparkSession)
    n, probe = next(probes(benchmark, **how))
    if n > 1:
        # rows with equal texts hold the same items
        print_ = F.coalesce(F.xxhash64(text), F.lit(0)).alias("print")
        rows = docs.select(F.lit(0).cast("long").alias("doc_id"), print_, F.col(text).alias("text"))
        found = _in_blocks(rows, benchmark, how).select("print")
        return docs.select(F.struct(*docs.columns).alias("doc"), print_).join(found, "print", "left_anti").select("doc.*")
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(probe)

    def run(batches):
        for batch in batches:
            found = _leaks(shared.value)(*utf8(batch.column(at))) if shared.value.ids else {}
            keep = np.ones(batch.num_rows, bool)
            keep[list(found)] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
