r"""Operator 7: edit-aware token counts with segment trees over pre-tokens.

*State* (``count_tokens``): a text is split into pre-tokens by the tokenizer's pattern; ``leaf`` neighbouring pre-tokens are a leaf with its length in
characters and its number of tokens. ``tree`` is a segment tree of the leaves' token counts, in heap order with the root first, so
the root is the document's count and an update of one leaf changes one path.

*Edits* (``apply_edits``): spans (begin, end, text) of the old text, in characters. For each group of near edits the new text is split again from two
leaves before the first touched one (a pre-token's end depends on what follows it only up to the next pre-token) until a
boundary of the new split meets a boundary of an old leaf after the edit: from there on the old leaves hold.
Only these pre-tokens are encoded. If a region keeps its number of leaves, leaves change in place and the
sums on their paths are updated; otherwise the leaves are spliced and the sums of the tree are made anew from the counts that are kept.

The number of tokens of a pre-token is kept in a bounded table of each task. Vocabulary and pattern are parameters; the driver
reads the file and sends its content (about 1 MB).

Defined results: null and empty texts have no leaf, the tree [0] and 0 tokens; edits are sorted by (begin, end), clipped to the text, and one that overlaps an
earlier one is left out; edits of a null text are ignored; null edits are none; equal rows give equal rows.
A text is worked on whole, whatever its length. Other columns are carried in ``row``, so their names can't clash.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How texts are split before the merges of that vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 32
KNOWN = 1 << 18

STATE = T.StructType([T.StructField("lengths", T.ArrayType(T.IntegerType())), T.StructField("tree", T.ArrayType(T.LongType())), T.StructField("n_tokens", T.LongType())])
EDITS = "array<struct<begin:bigint,end:bigint,text:string>>"


class Counter:
    """Tokens of a pre-token."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN):
        import tiktoken

        vocabulary = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=vocabulary, special_tokens={})
        self.split = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def counts(self, parts: list[str]) -> list[int]:
        known = self.known
        if len(known) > KNOWN:
            known.clear()
        for p in set(parts).difference(known):
            known[p] = len(self.encoding.encode_ordinary(p))
        return [known[p] for p in parts]

    def leaves(self, parts: list[str]) -> tuple[list[int], list[int]]:
        """Length in characters and tokens of each leaf."""
        counts = self.counts(parts)
        at = range(0, len(parts), LEAF)
        return [sum(map(len, parts[i : i + LEAF])) for i in at], [sum(counts[i : i + LEAF]) for i in at]


@lru_cache(maxsize=4)
def _counter(ranks: bytes, pattern: str) -> Counter:
    return Counter(ranks, pattern)


def build(leaves: list[int]) -> list[int]:
    """Segment tree in heap order: node i has children 2 i + 1 and 2 i + 2, leaves are last, padded to a power of two."""
    size = 1
    while size < len(leaves):
        size *= 2
    levels = [np.array([*leaves, *[0] * (size - len(leaves))], np.int64)]
    while len(levels[-1]) > 1:
        levels.append(levels[-1].reshape(-1, 2).sum(axis=1))
    return np.concatenate(levels[::-1]).tolist()


def leaf_counts(tree: list[int], n: int) -> list[int]:
    size = (len(tree) + 1) // 2
    return tree[size - 1 : size - 1 + n]


def update(tree: list[int], leaf: int, tokens: int) -> None:
    """Sets one leaf and the sums above it."""
    at = (len(tree) + 1) // 2 - 1 + leaf
    change = tokens - tree[at]
    while True:
        tree[at] += change
        if not at:
            return
        at = (at - 1) // 2


def clean_edits(edits, size: int) -> list[tuple[int, int, str]]:
    kept, at = [], 0
    for begin, end, text in sorted((max(0, min(b, size)), max(0, min(e, size)), t or "") for b, e, t in edits if b is not None and e is not None):
        if begin >= at and end >= begin:
            kept.append((begin, end, text))
            at = end
    return kept


def edit(counter: Counter, text: str, lengths: list[int], tree: list[int], edits: list[tuple[int, int, str]]):
    """New text, lengths, tree, and the number of characters that were encoded again."""
    edits = clean_edits(edits, len(text))
    ends = np.cumsum(lengths)
    old = leaf_counts(tree, len(lengths))
    new_text, at = [], 0
    for begin, end, insert in edits:
        new_text += [text[at:begin], insert]
        at = end
    new = "".join([*new_text, text[at:]])
    regions: list[tuple[int, int, list[int], list[int]]] = []  # old leaves [i, j) and what they become
    again, shift, k = 0, 0, 0
    while k < len(edits):
        i = max(0, int(np.searchsorted(ends, edits[k][0], "left")) - 2)
        if regions:
            i = max(i, regions[-1][1])
        start = int(ends[i - 1]) if i else 0
        begin = start + shift
        boundaries = {}  # old leaf ends that a new boundary may meet, in new places
        parts, place, stop, j = [], begin, None, len(lengths)
        reach, moved = edits[k][1], shift
        pending = k
        for m in counter.split.finditer(new, begin):
            while pending < len(edits) and edits[pending][0] + moved <= m.end():
                moved += len(edits[pending][2]) - (edits[pending][1] - edits[pending][0])
                reach = edits[pending][1]
                pending += 1
                boundaries = None
            parts.append(m[0])
            place = m.end()
            if boundaries is None and place - moved > reach:
                leaf = int(np.searchsorted(ends, place - moved, "left"))
                if leaf < len(ends) and ends[leaf] == place - moved and (pending == len(edits) or edits[pending][0] > place - moved):
                    stop, j = place, leaf + 1
                    break
        k = max(pending, k + 1)
        while k < len(edits) and stop is None:  # the split ran to the end of the text
            k += 1
        again += (stop if stop is not None else len(new)) - begin
        regions.append((i, j, *counter.leaves(parts)))
        shift = moved
    if all(j - i == len(size) for i, j, size, _ in regions):
        tree, lengths = list(tree), list(lengths)
        for i, _, sizes, counts in regions:
            for n, (s, c) in enumerate(zip(sizes, counts, strict=True)):
                lengths[i + n] = s
                update(tree, i + n, c)
        return new, lengths, tree, again
    sizes, counts, at = [], [], 0
    for i, j, s, c in regions:
        sizes += [*lengths[at:i], *s]
        counts += [*old[at:i], *c]
        at = j
    sizes, counts = [*sizes, *lengths[at:]], [*counts, *old[at:]]
    return new, sizes, build(counts), again


def _broadcast(docs: DataFrame, vocabulary: str):
    with open(vocabulary, "rb") as file:
        return docs.sparkSession.sparkContext.broadcast(file.read())


def count_tokens(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``row`` (all columns of docs) and ``state`` (lengths, tree, n_tokens)."""
    small_batches(docs.sparkSession)
    ranks, at = _broadcast(docs, vocabulary), docs.columns.index(text)

    def run(batches):
        counter = _counter(ranks.value, pattern)
        for batch in batches:
            states = []
            for value in batch.column(0).field(at).to_pylist():
                sizes, counts = counter.leaves(counter.split.findall(value or ""))
                tree = build(counts) if counts else [0]
                states.append({"lengths": sizes, "tree": tree, "n_tokens": tree[0]})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(states, _STATE)], ["row", "state"])

    return docs.select(F.struct("*").alias("row")).mapInArrow(run, T.StructType([T.StructField("row", docs.schema), T.StructField("state", STATE)]))


_STATE = pa.struct([("lengths", pa.list_(pa.int32())), ("tree", pa.list_(pa.int64())), ("n_tokens", pa.int64())])


def apply_edits(counted: DataFrame, edits: str = "edits", text: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``row`` with the new text, the new ``state``, ``was`` (old n_tokens), ``n_edits`` that took effect and ``n_encoded`` characters.

    counted: ``row`` and ``state`` as of count_tokens; row has a column ``edits`` of type EDITS.
    """
    row = counted.schema["row"].dataType
    at, at_edits = row.names.index(text), row.names.index(edits)
    ranks = _broadcast(counted, vocabulary)

    def run(batches):
        counter = _counter(ranks.value, pattern)
        for batch in batches:
            columns = [batch.column(0).field(i) for i in range(len(row.names))]
            texts, states, old, numbers, sizes = [], [], [], [], []
            for value, state, wanted in zip(columns[at].to_pylist(), batch.column(1).to_pylist(), columns[at_edits].to_pylist(), strict=True):
                todo = clean_edits([(e["begin"], e["end"], e["text"]) for e in wanted or ()], len(value)) if value is not None else []
                new, lengths, tree, again = edit(counter, value, state["lengths"], state["tree"], todo) if todo else (value, state["lengths"], state["tree"], 0)
                texts.append(new)
                states.append({"lengths": lengths, "tree": tree, "n_tokens": tree[0]})
                old.append(state["n_tokens"])
                numbers.append(len(todo))
                sizes.append(again)
            columns[at] = pa.array(texts, pa.string())
            whole = pa.StructArray.from_arrays(columns, fields=[pa.field(n, c.type) for n, c in zip(row.names, columns, strict=True)])
            yield pa.RecordBatch.from_arrays([whole, pa.array(states, _STATE), *(pa.array(x, pa.int64()) for x in (old, numbers, sizes))], ["row", "state", "was", "n_edits", "n_encoded"])

    fields = [T.StructField("row", row), T.StructField("state", STATE), *(T.StructField(n, T.LongType()) for n in ("was", "n_edits", "n_encoded"))]
    return counted.mapInArrow(run, T.StructType(fields))


#: What the registered query edits out of texts: addresses, long numbers and long keys.
PERSONAL = re.compile(r"[\w.+-]+@[\w-]+\.[\w.]+|\+?\d[\d ()-]{7,}\d|\b[A-Za-z0-9_-]{24,}\b")


def redactions(docs: DataFrame, text: str = "text", edits: str = "edits") -> DataFrame:
    """docs with a column ``edits`` that replaces personal data and keys by placeholders; a column of that name in docs gives way to it."""
    docs = docs.drop(edits) if edits != text else docs
    names, at = docs.columns, docs.columns.index(text)
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("text", pa.string())]))

    def run(batches):
        for batch in batches:
            found = [[{"begin": m.start(), "end": m.end(), "text": "<email>" if "@" in m[0] else "<removed>"} for m in PERSONAL.finditer(t or "")] for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*names, edits])

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(edits, T._parse_datatype_string(EDITS))]))
