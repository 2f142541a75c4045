r"""Operator 3: language identification by interpolated Kneser-Ney character models.

*Symbols*: the text in lower case; letters are kept (16 bits each, letters beyond the basic plane folded to 16
bits), any run of other characters is one space, and a text begins after three pad symbols.

*Fit* (``fit``): 4-gram counts of every labelled training text are summed by language. Tasks count their
own rows with sorted arrays first, so a shuffle sees each gram once for a task. Every gram goes into the model.
Up to ``max_grams`` grams it is one piece. Beyond that it is blocks, gathered and sent to tasks one by one, of about
``max_grams`` grams (a block holds all grams of one language with one third symbol, so it may be larger).
Lower orders use continuation counts; each order has its own discount n1 / (n1 + 2 n2), and the
lowest order is interpolated with a uniform distribution.

*Model* (``Model``): for each order and language a sorted array of packed grams with counts, and one sorted array of all
4-grams of any language with their log probabilities in every language, so that scoring looks each position up once.

*Blocks* (``Part``): grams of a language are cut by the third symbol. All that the 4-grams, 3-grams and 2-grams with that symbol
before their last need is in one block; only the single symbols (65,536 at most) and the discounts are summed over blocks.
Each position meets one block of each language, so log probabilities add up to those of the model in one piece.

*Decision*: least cross-entropy (nats per symbol). ``score`` is the share of the best language in the softmax of minus
cross-entropy times min(symbols, 50). ``rejected`` where cross-entropy is above the language's limit: on all training rows
the 99.9 % quantile at that text's length (powers of two and their neighbours), times ``slack``. Spark counts entropies in steps of 1e-4 nats, so
the quantiles are exact to that step and only the limits, 32 for a language, come to the driver.

Defined results: null text, or text without a letter, gives ``und`` with score 0 and is rejected; so does every
text if there is no labelled training text; ties go to the language first by code point; repeated rows get equal results.
Inputs of a prediction are the text alone. Null doc_ids count as held out. Only the named columns are read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches

ORDER = 4
PAD, SPACE = 1, 32
UNDETERMINED = "und"
#: Texts are worked on in chunks of this many characters.
CHUNK = 1 << 18


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, and the number of each text's. A text without a letter has none."""
    codes = [np.frombuffer((t or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.array([len(c) for c in codes], np.int64)
    if not sizes.sum():
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    flat = np.concatenate(codes)
    letter = _letters()[flat]
    row = np.repeat(np.arange(len(texts)), sizes)
    keep = letter.copy()
    keep[1:] |= letter[:-1] & (row[1:] == row[:-1])
    flat = np.where(letter, np.where(flat > 0xFFFF, flat & 0x7FFF | 0x8000, flat), SPACE)[keep]
    return flat.astype(np.uint64), np.bincount(row[keep], minlength=len(texts))


def grams(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The 4-gram that ends at each symbol, 16 bits a symbol, pads before a text's first."""
    place = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
    key = flat.copy()
    for back in range(1, ORDER):
        before = np.full(len(flat), PAD, np.uint64)
        before[back:] = np.where(place[back:] >= back, flat[:-back] if len(flat) > back else flat[:0], PAD)
        key |= before << np.uint64(16 * back)
    return key


def _chunks(texts: list[str | None]):
    """Slices of texts with about CHUNK characters, one text at least."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _count(batches):
    """Batches (lang, text) to (lang, gram, n), counted over the task."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def emit(lang):
        keys, n = held.pop(lang)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    for batch in batches:
        by: dict[str, list[str]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            for i, j in _chunks(texts):
                keys, n = np.unique(grams(*symbols(texts[i:j])), return_counts=True)
                if lang in held:
                    keys = np.concatenate((held[lang][0], keys))
                    n = np.concatenate((held[lang][1], n))
                    keys, where = np.unique(keys, return_inverse=True)
                    n = np.bincount(where, weights=n).astype(np.int64)
                held[lang] = keys, n
            if len(held[lang][0]) > 1 << 20:
                yield emit(lang)
    for lang in list(held):
        yield emit(lang)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), max(len(table) - 1, 0))
    return at, (table[at] == keys) if len(table) else np.zeros(len(keys), bool)


def _once_twice(counts: np.ndarray) -> np.ndarray:
    return np.array([(counts == 1).sum(), (counts == 2).sum()])


def _discount(once_twice: np.ndarray) -> float:
    one, two = once_twice.tolist()
    return float(one / (one + 2 * two)) if one else 0.1


def _level(keys: np.ndarray, counts: np.ndarray) -> tuple:
    """Grams of one order with counts, and their contexts with totals and types."""
    context, start = np.unique(keys >> np.uint64(16), return_index=True)
    total = np.add.reduceat(counts, start) if len(counts) else counts
    return keys, counts, context, total, np.diff(np.r_[start, len(keys)])


class _Language:
    """Kneser-Ney tables of one language: for each order the grams with counts and their contexts' totals and types."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.levels = []
        for order in range(ORDER, 0, -1):
            self.levels.append((*_level(keys, counts), _discount(_once_twice(counts))))
            keys, counts = np.unique(keys & np.uint64((1 << 16 * (order - 1)) - 1), return_counts=True)
        self.alphabet = len(self.levels[-1][0]) + 1

    def probability(self, keys: np.ndarray) -> np.ndarray:
        p = np.full(len(keys), 1 / self.alphabet)
        for order in range(1, ORDER + 1):
            table, counts, contexts, total, types, discount = self.levels[ORDER - order]
            own = keys & np.uint64((1 << 16 * order) - 1) if order < 4 else keys
            at, hit = _find(table, own)
            where, known = _find(contexts, own >> np.uint64(16))
            count = np.where(hit, np.maximum(counts[at] - discount, 0), 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                p = np.where(known, count / total[where] + discount * types[where] / total[where] * p, p)
        return p


def _third(keys: np.ndarray) -> np.ndarray:
    return keys >> np.uint64(16) & np.uint64(0xFFFF)


class Part(_Language):
    """The tables of one language for the grams whose third symbol is in [low, high)."""

    def __init__(self, language: int, low: int, high: int, keys: np.ndarray, counts: np.ndarray):
        self.language, self.low, self.high = language, low, high
        self.tables = []
        for order in range(ORDER, 1, -1):
            self.tables.append(_level(keys, counts))
            keys, counts = np.unique(keys & np.uint64((1 << 16 * (order - 1)) - 1), return_counts=True)
        self.single = keys, counts

    def complete(self, shared: list) -> None:
        """Take over what is summed over the language's parts: discounts, and the table of single symbols."""
        discounts, single = shared[self.language]
        self.levels = [(*t, d) for t, d in zip([*self.tables, single], discounts, strict=True)]
        self.alphabet = len(single[0]) + 1


class Summed:
    """What parts of a language have in common, summed as they are made."""

    def __init__(self):
        self.once_twice = np.zeros((ORDER - 1, 2), np.int64)
        self.single = np.zeros(1 << 16, np.int64)

    def add(self, part: Part) -> None:
        self.once_twice += [_once_twice(t[1]) for t in part.tables]
        self.single[part.single[0].astype(np.int64)] += part.single[1]

    def shared(self) -> tuple:
        keys = np.flatnonzero(self.single)
        counts = self.single[keys]
        return [_discount(x) for x in [*self.once_twice, _once_twice(counts)]], _level(keys.astype(np.uint64), counts)


class Model:
    def __init__(self, languages: list[str], tables: list[tuple[np.ndarray, np.ndarray]]):
        self.languages = languages
        self.parts = [_Language(*t) for t in tables]
        self.keys = np.unique(np.concatenate([t[0] for t in tables])) if tables else np.zeros(0, np.uint64)
        self.logs = self._logs(self.keys)
        self.limits: dict[str, np.ndarray] = {}
        self.blocks: list = []

    def __getstate__(self) -> dict:
        """Without the blocks, which are sent on their own."""
        return vars(self) | {"blocks": []}

    def _logs(self, keys: np.ndarray) -> np.ndarray:
        """One row for each language."""
        return np.array([np.log(p.probability(keys)) for p in self.parts], np.float32).reshape(len(self.parts), len(keys))

    def cross_entropy(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per symbol, one row for each language; number of symbols."""
        flat, counts = symbols(texts)
        total = np.zeros((len(self.parts), len(texts)))
        if len(flat) and self.parts:
            keys = grams(flat, counts)
            at, hit = _find(self.keys, keys)
            miss = np.flatnonzero(~hit)
            rows = np.flatnonzero(counts)
            start = (np.cumsum(counts) - counts)[rows]
            new = self._logs(keys[miss])
            for k in range(len(self.parts)):
                logs = self.logs[k][at]
                logs[miss] = new[k]
                total[k, rows] = np.add.reduceat(logs, start, dtype=np.float64)
        return -total / np.maximum(counts, 1), counts

    def decide(self, texts: list[str | None], blocks=()):
        """Language, score, cross-entropy, symbols, rejected of each text."""
        entropy, counts = self.cross_entropy(texts, *([blocks] if blocks else []))
        if not self.languages:
            none = [None] * len(texts)
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), none, counts, np.ones(len(texts), bool)
        best = entropy.argmin(axis=0)
        least = entropy[best, np.arange(len(texts))]
        share = 1 / np.exp(-(entropy - least) * np.minimum(counts, 50)).sum(axis=0)
        known = counts > 0
        length = np.minimum(np.log2(np.maximum(counts, 1)).astype(int), 31)
        limit = np.array([self.limits[self.languages[b]][k] if self.limits else np.inf for b, k in zip(best, length, strict=True)])
        languages = [self.languages[b] if k else UNDETERMINED for b, k in zip(best.tolist(), known.tolist(), strict=True)]
        return languages, np.where(known, share, 0.0), [x if k else None for x, k in zip(least.tolist(), known.tolist(), strict=True)], counts, ~known | (least > limit)


class BlockModel(Model):
    """A model whose tables are blocks: lists of parts in broadcasts, which tasks load in turn."""

    def __init__(self, languages: list[str], shared: list):
        super().__init__([], [])
        self.languages, self.shared = languages, shared

    def cross_entropy(self, texts: list[str | None], blocks=()) -> tuple[np.ndarray, np.ndarray]:
        flat, counts = symbols(texts)
        total = np.zeros((len(self.languages), len(texts)))
        if len(flat):
            keys, at = np.unique(grams(flat, counts), return_inverse=True)
            third = _third(keys)
            row = np.repeat(np.arange(len(texts)), counts)
            for block in blocks:
                for part in block.value:
                    part.complete(self.shared)
                    logs = np.zeros(len(keys), np.float32)
                    own = (third >= part.low) & (third < part.high)
                    logs[own] = np.log(part.probability(keys[own]))
                    total[part.language] += np.bincount(row, weights=logs[at], minlength=len(texts))
                vars(block).pop("_value", None)  # one block is held at a time
        return -total / np.maximum(counts, 1), counts


def _ranges(sizes: list[tuple[str, int, int]], max_grams: int) -> list[list[tuple[str, int, int]]]:
    """Blocks of (language, low, high) of about max_grams grams that cover all third symbols of each language once.

    sizes: (language, third symbol, grams) in order.
    """
    blocks, held = [[]], 0
    for k, (lang, third, n) in enumerate(sizes):
        if k == 0 or sizes[k - 1][0] != lang:
            if k:
                blocks[-1][-1][2] = 1 << 16
            if held + n > max_grams and held:
                blocks.append([])
                held = 0
            blocks[-1].append([lang, 0, 1 << 16])
        elif held + n > max_grams:
            blocks[-1][-1][2] = third
            blocks.append([[lang, third, 1 << 16]])
            held = 0
        held += n
    return [[tuple(x) for x in block] for block in blocks]


def _gathered(counted: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Sorted grams and counts by language."""
    got = counted.toArrow()
    names = np.array(got["lang"].to_pylist(), object)
    keys, n = (got[c].to_numpy() for c in ("gram", "n"))
    tables = {}
    for name in sorted(set(names.tolist())):
        own = names == name
        key = keys[own].view(np.uint64)
        order = np.argsort(key)
        tables[name] = key[order], n[own][order]
    return tables


def _in_blocks(counted: DataFrame, max_grams: int) -> tuple[Model, list]:
    """The model in blocks, each gathered, made and sent before the next."""
    third = F.shiftrightunsigned("gram", 16).bitwiseAND(F.lit(0xFFFF))
    sizes = counted.groupBy("lang", third.alias("third")).count().collect()
    ranges = _ranges(sorted((r["lang"], r["third"], r["count"]) for r in sizes), max_grams)
    languages = sorted({r["lang"] for r in sizes})
    summed, blocks = [Summed() for _ in languages], []
    for block in ranges:
        wanted = F.lit(False)
        for lang, low, high in block:
            wanted |= (F.col("lang") == lang) & (third >= low) & (third < high)
        tables = _gathered(counted.where(wanted))
        parts = [Part(languages.index(lang), low, high, *tables[lang]) for lang, low, high in block]
        for part in parts:
            summed[part.language].add(part)
        blocks.append(counted.sparkSession.sparkContext.broadcast(parts))
    return BlockModel(languages, [x.shared() for x in summed]), blocks


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the doc_id as text is 1 modulo 3. Null: held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(True))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", max_grams: int = 2_000_000, slack: float = 1.25) -> Model:
    """The model from the training rows of docs. See the module for the bounds."""
    small_batches(docs.sparkSession)
    rows = docs.where(~held_out(F.col(doc_id)) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    labelled = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    counted = labelled.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = counted.persist(StorageLevel.DISK_ONLY)
    try:
        if counted.count() <= max_grams:
            tables = _gathered(counted)
            model, blocks = Model(list(tables), list(tables.values())), []
        else:
            model, blocks = _in_blocks(counted, max_grams)
    finally:
        counted.unpersist()
    model.blocks = blocks
    if model.languages:
        _calibrate(model, predict(rows, model, doc_id, text), slack)
    return model


#: Entropies are counted in steps of 1 / STEPS nats.
STEPS = 10_000


def _limits(scored: DataFrame, quantile: float = 0.999, least: int = 20) -> DataFrame:
    """lang_pred, k and the quantile of the cross-entropies of all rows whose length (a power of two) is k - 1, k or k + 1, where there are enough.

    The quantile is interpolated between the two values about it, each found in running counts of the steps.
    """
    known = scored.where((F.col("lang_pred") != UNDETERMINED) & (F.col("n_symbols") > 0))
    length = F.length(F.bin("n_symbols")) - 1
    steps = known.groupBy("lang_pred", length.alias("length"), F.round(F.col("cross_entropy") * STEPS).cast("long").alias("step")).count()
    near = steps.select("lang_pred", "step", "count", F.explode(F.sequence(F.col("length") - 1, F.col("length") + 1)).alias("k"))
    near = near.where("k BETWEEN 0 AND 31").groupBy("lang_pred", "k", "step").agg(F.sum("count").alias("count"))
    group = Window.partitionBy("lang_pred", "k")
    up_to = near.withColumn("n", F.sum("count").over(group)).withColumn("upto", F.sum("count").over(group.orderBy("step")))
    place = quantile * (F.col("n") - 1)
    value = lambda i: F.min(F.when(F.col("upto") > i, F.col("step")))
    found = up_to.where(F.col("n") >= least).withColumn("place", place).groupBy("lang_pred", "k", "place").agg(value(F.floor("place")).alias("low"), value(F.ceil("place")).alias("high"))
    return found.select("lang_pred", "k", ((F.col("low") + (F.col("place") - F.floor("place")) * (F.col("high") - F.col("low"))) / STEPS).alias("entropy"))


def _calibrate(model: Model, scored: DataFrame, slack: float) -> None:
    model.limits = {name: np.full(32, np.inf) for name in model.languages}
    for row in _limits(scored).collect():
        model.limits[row["lang_pred"]][row["k"]] = row["entropy"] * slack


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, n_symbols, rejected for each row of docs, from the text alone."""
    small_batches(docs.sparkSession)
    shared, blocks = docs.sparkSession.sparkContext.broadcast(model), model.blocks

    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            parts = [shared.value.decide(texts[i:j], blocks) for i, j in _chunks(texts)]
            if not parts:
                continue
            languages, score, entropy, counts, rejected = zip(*parts, strict=True)
            columns = [batch.column(0), batch.column(1), pa.array(sum(languages, []), pa.string()), pa.array(np.concatenate(score)), pa.array([y for x in entropy for y in x], pa.float64()), pa.array(np.concatenate(counts).astype(np.int64)), pa.array(np.concatenate(rejected))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "n_symbols", "rejected"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, n_symbols long, rejected boolean")


def keep_identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """docs without the rows that the model rejects."""
    model = fit(docs, doc_id, text, lang)
    shared, blocks = docs.sparkSession.sparkContext.broadcast(model), model.blocks
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            parts = [shared.value.decide(texts[i:j], blocks)[4] for i, j in _chunks(texts)]
            if parts:
                yield batch.filter(pa.array(~np.concatenate(parts)))

    return docs.mapInArrow(run, docs.schema)
