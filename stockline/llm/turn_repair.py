r"""Operator 11: the cheapest edits that give a conversation its form, by Four-Russians tables of cost vectors.

The roles of a sound conversation have the initials ``(s?(ua)+)?``. Rows are kept (0), given the role user or assistant (1), deleted (2; required for
blank and duplicate rows), and rows without text are inserted (5); a truncated row that stays costs 5 more.

1. *Faults*: a row's first of blank, duplicate (role and text seen earlier in the conversation; by the least place of each role and text) and truncated.
   A row becomes a symbol: its role's initial and what its fault asks for.
2. *Tables*: the cost to go from each of the four states of the form is a vector; less its least value it is one of a few dozen. For each such vector and each block
   of ``BLOCK`` symbols the tables hold the vector before the block and what is added (``Tables``, made from the edits' rules).
3. *Chunks*: rows are sorted over all machines by range and numbered; up to ``CHUNK`` rows of a conversation are a chunk. A chunk's function, from the vector after
   it to the vector before it, is looked up block by block for all vectors, so chunks of one long conversation are worked on in parallel.
4. *Backward*: chunks of a conversation pass from the last to the first, one lookup each; each learns the vector after it.
5. *Forward*: chunks and texts pass in order. A chunk expands its blocks backward from its vector, so each row knows its costs to go; of the cheapest edits the
   least letter in ASCII is taken (D, I, K, R). A letter decides the next state, so the audit is the least of all cheapest ones.

Both passes stream a conversation's rows and hold a batch at a time: the hash of a repaired conversation is a sequence by nature, but no conversation is collected.

Defined results: null roles and texts are one space; an empty role, and one with any other initial, can't be kept; rows of one turn are
ordered by role and md5 of the text; rows that repeat are duplicates after the first; null is a conv_id of its own; an empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States of the form: nothing yet, after s, after u, after a. A conversation may end in the first and the last.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
ENDS = (START, AFTER_A)
#: The state that a new role leads to, and, for the initials s, u, a and others, the state that a kept row leads to (-1: none).
NEW = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
KEPT = ((AFTER_S, AFTER_U, -1, -1), (-1, AFTER_U, -1, -1), (-1, -1, AFTER_A, -1), (-1, AFTER_U, -1, -1))
#: Symbols: an initial, an initial of a truncated row (+ 4), a row that must go, and none (fills the last block).
GOES, NONE, SYMBOLS = 8, 9, 10
BLOCK, CHUNK_BITS = 3, 12
#: Codes of rows: the initial, and 4 times the fault (none, blank, duplicate, truncated).
CODE_SYMBOL = np.array([0, 1, 2, 3, *[GOES] * 8, 4, 5, 6, 7], np.int64)
NAMES = {AFTER_U: "user", AFTER_A: "assistant"}


def _closed(direct: list[float]) -> list[float]:
    """The least costs with rows inserted first."""
    for _ in range(3):
        direct = [min(x, INSERT + direct[NEW[q]]) for q, x in enumerate(direct)]
    return direct


def _options(after: tuple, symbol: int, q: int) -> dict[str, float]:
    """Costs to go of the edits that use up the row, by letter."""
    more = TRUNCATED if 4 <= symbol < GOES else 0
    found = {"D": DELETE + after[q]}
    if symbol < GOES:
        if KEPT[q][symbol % 4] >= 0:
            found["K"] = KEEP + more + after[KEPT[q][symbol % 4]]
        found["R"] = REROLE + more + after[NEW[q]]
    return found


class Tables:
    """Vectors of costs to go (``vectors``, less their least value), the vector before each symbol and block, what is added, and the edits."""

    def __init__(self, block: int = BLOCK):
        end = tuple(_closed([0 if q in ENDS else np.inf for q in range(4)]))
        self.vectors, todo, step = {end: 0}, [end], {}
        for vector in todo:
            for symbol in range(NONE):
                before = _closed([min(_options(vector, symbol, q).values()) for q in range(4)])
                least = min(before)
                to = tuple(x - least for x in before)
                if to not in self.vectors:
                    self.vectors[to] = len(todo)
                    todo.append(to)
                step[self.vectors[vector], symbol] = (self.vectors[to], int(least))
        n = len(todo)
        self.start = np.array([int(v[START]) for v in todo])
        self.one = np.array([[*(step[v, s][0] for s in range(NONE)), v] for v in range(n)])
        added = np.array([[*(step[v, s][1] for s in range(NONE)), 0] for v in range(n)])
        self.block, size = block, SYMBOLS**block
        self.to, self.added = np.zeros((n, size), np.int16), np.zeros((n, size), np.int64)
        for i, symbols in enumerate(product(range(SYMBOLS), repeat=block)):
            at = np.arange(n)
            for s in reversed(symbols):
                self.added[:, i] += added[at, s]
                at = self.one[at, s]
            self.to[:, i] = at
        #: By vector after the row, symbol and state: the letters and the state after them.
        self.edits = [[[self._edits(v, s, q) for q in range(4)] for s in range(NONE)] for v in todo]

    @staticmethod
    def _edits(after: tuple, symbol: int, q: int) -> tuple[str, int]:
        letters = ""
        while True:
            options = {x: _options(after, symbol, x) for x in range(4)}
            before = _closed([min(options[x].values()) for x in range(4)])
            choice = {k: c for k, c in (options[q] | {"I": INSERT + before[NEW[q]]}).items() if c == before[q]}
            letter = min(choice)
            letters += letter
            if letter != "I":
                return letters, {"D": q, "K": KEPT[q][symbol % 4], "R": NEW[q]}[letter]
            q = NEW[q]

    def blocks(self, codes: np.ndarray) -> np.ndarray:
        """Numbers of the blocks of a chunk's codes."""
        symbols = np.full(-(-len(codes) // self.block) * self.block, NONE)
        symbols[: len(codes)] = CODE_SYMBOL[codes]
        return symbols.reshape(-1, self.block) @ SYMBOLS ** np.arange(self.block)[::-1]

    def function(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The vector before a chunk, and what is added, for each vector after it."""
        at, total = np.arange(len(self.to)), np.zeros(len(self.to), np.int64)
        for block in self.blocks(codes)[::-1]:
            total += self.added[at, block]
            at = self.to[at, block]
        return at, total

    def expanded(self, codes: np.ndarray, after: int) -> list[int]:
        """The vector after each row of a chunk: blocks by lookup, then each block backward."""
        out: list[int] = []
        symbols, blocks = CODE_SYMBOL[codes], self.blocks(codes)
        for i in range(len(blocks) - 1, -1, -1):
            at = after
            for s in symbols[i * self.block : (i + 1) * self.block][::-1]:
                out.append(int(at))
                at = self.one[at, s]
            after = self.to[after, blocks[i]]
        return out[::-1]


@lru_cache(1)
def tables() -> Tables:
    return Tables()


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of damaged rows: by the crc32 of ``conv_id:turn`` modulo 20, a row is dropped (0), loses its text (1) or
    its ``[.!?]`` (2), is repeated (3) or becomes the user's (4)."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", h.alias("h"), part("role").alias("role"), part("text").alias("text")).where("h > 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("h") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("_")).drop("_")


def in_order(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with ``place``, which orders all rows by conversation and turn, and the md5 of the text."""
    clean = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    keys = ["conv_id", "turn", "role", "mark"]
    dealt = clean.withColumn("mark", F.md5(F.col("text").cast("binary"))).repartitionByRange(*keys).sortWithinPartitions(*keys)
    return written(dealt.withColumn("place", F.monotonically_increasing_id()), "rows")


def _code() -> Column:
    initial = F.left("role", F.lit(1))
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return (role + 4 * F.when(F.col("last") == "", 1).when(F.col("place") > F.col("first"), 2).when(~F.col("last").isin(".", "!", "?"), 3).otherwise(0)).cast("byte")


def chunks(rows: DataFrame) -> DataFrame:
    """conv_id, place (of its first row) and codes of each chunk of ordered rows."""
    small = rows.select("conv_id", "place", "role", "mark", F.right(F.btrim("text", F.lit(SPACE)), F.lit(1)).alias("last"))
    first = small.groupBy("conv_id", "role", "mark").agg(F.min("place").alias("first")).select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("mark").alias("_mark"), "first")
    met = small.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("mark") == F.col("_mark")))
    found = met.groupBy("conv_id", F.shiftright("place", CHUNK_BITS).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("place", _code().alias("code")))).alias("of"))
    return found.select("conv_id", F.col("of")[0]["place"].alias("place"), F.transform("of", lambda x: x["code"]).alias("codes"))


_CODES = pa.list_(pa.int8())
FUNCTION = "conv_id {0}, place long, codes array<tinyint>, before array<smallint>, added array<long>"
BEHIND = "conv_id {0}, place long, codes array<tinyint>, after smallint, cost long"
DIGEST = "conv_id {0}, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
ROWS = "conv_id {0}, number long, edit string, role string, text string"


def _functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = tables()
    for batch in batches:
        made = [t.function(np.array(codes, np.int64)) for codes in batch.column(2).to_pylist()]
        arrays = [pa.array([m[0] for m in made], pa.list_(pa.int16())), pa.array([m[1] for m in made], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], ["conv_id", "place", "codes", "before", "added"])


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks from the last to the first of each conversation: the vector after each, and the cost to go from its begin."""
    t, current, after, total = tables(), object(), 0, 0
    for batch in batches:
        ids, out = batch.column(0).to_pylist(), []
        for conv, before, added in zip(ids, batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            if conv != current:
                current, after, total = conv, 0, 0
            total += added[after]
            out.append((after, total + int(t.start[before[after]])))
            after = before[after]
        arrays = [pa.array([x[0] for x in out], pa.int16()), pa.array([x[1] for x in out], pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *arrays], ["conv_id", "place", "codes", "after", "cost"])


class _Conversation:
    """A conversation as its chunks and rows come in order; ``pieces`` are its repaired rows so far."""

    def __init__(self, conv):
        self.conv, self.q, self.rows, self.cost = conv, START, iter(()), None
        self.faults, self.illegal, self.last = [0, 0, 0, 0], 0, None

    def chunk(self, codes: list[int], after: int, cost: int) -> None:
        t, codes = tables(), np.array(codes, np.int64)
        self.cost = cost if self.cost is None else self.cost
        for fault, n in zip(*np.unique(codes // 4, return_counts=True), strict=True):
            self.faults[fault] += int(n)
        roles = codes % 4 if self.last is None else np.r_[self.last, codes % 4]
        fits = ((roles[:-1] != 3) & (roles[1:] == 1) & (roles[:-1] != 1)) | ((roles[:-1] == 1) & (roles[1:] == 2))  # su, au, ua
        self.illegal += int((~fits).sum())
        self.last = roles[-1]
        self.rows = iter(zip(t.expanded(codes, after), CODE_SYMBOL[codes].tolist(), strict=True))

    def row(self, role: str, text: str) -> Iterator[tuple[str, str | None, str | None]]:
        """The edits up to this row, each with the row that it leaves."""
        after, symbol = next(self.rows)
        letters, to = tables().edits[after][symbol][self.q]
        for _ in letters[:-1]:
            yield self.inserted()
        if letters[-1] == "D":
            yield "D", None, None
        else:
            yield letters[-1], (role if letters[-1] == "K" else NAMES[to]), text
        self.q = to

    def inserted(self) -> tuple[str, str, str]:
        self.q = NEW[self.q]
        return "I", NAMES[self.q], ""

    def end(self) -> Iterator[tuple[str, str, str]]:
        while self.q not in ENDS:
            yield self.inserted()


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Conversation, tuple | None]]:
    """Each conversation with each of its edits, in order, and with None at its end."""
    now: _Conversation | None = None
    for batch in batches:
        for conv, codes, after, cost, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or conv != now.conv:
                if now is not None:
                    yield from ((now, edit) for edit in (*now.end(), None))
                now = _Conversation(conv)
            if codes is not None:
                now.chunk(codes, after, cost)
            else:
                yield from ((now, edit) for edit in now.row(role, text))
    if now is not None:
        yield from ((now, edit) for edit in (*now.end(), None))


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    sha, audit, between = hashlib.sha256(), [], ""
    for now, edit in _forward(batches):
        if edit is None:
            yield now.conv, *now.faults[1:], now.illegal, now.cost, "".join(audit), sha.hexdigest()
            sha, audit, between = hashlib.sha256(), [], ""
            continue
        letter, role, text = edit
        audit.append(letter)
        if role is not None:
            sha.update(f"{between}{role}:{text}".encode())
            between = "\n"


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    last, number = None, 0
    for now, edit in _forward(batches):
        if now is not last:
            last, number = now, 0
        if edit is not None and edit[1] is not None:
            number += 1
            yield now.conv, number, *edit


def _streamed(rows: DataFrame, what, schema: str) -> DataFrame:
    """``what`` of the conversations in ordered rows: chunks backward, then chunks and texts forward."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    conv = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    types = {"long": pa.int64(), "string": pa.string()}
    out = pa.schema([("conv_id", conv), *((c.split()[0], types[c.split()[1]]) for c in schema.split(", ")[1:])])
    found = chunks(rows).mapInArrow(_functions, FUNCTION.format(kind))
    back = found.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("place")).mapInArrow(_backward, BEHIND.format(kind))
    text = rows.select("conv_id", "place", F.lit(1).alias("kind"), F.expr("CAST(NULL AS ARRAY<TINYINT>)").alias("codes"), F.expr("CAST(NULL AS SMALLINT)").alias("after"), F.expr("CAST(NULL AS LONG)").alias("cost"), "role", "text")
    heads = back.select("conv_id", "place", F.lit(0).alias("kind"), "codes", "after", "cost", F.expr("CAST(NULL AS STRING)").alias("role"), F.expr("CAST(NULL AS STRING)").alias("text"))
    both = heads.unionByName(text).repartition("conv_id").sortWithinPartitions("conv_id", "place", "kind").select("conv_id", "codes", "after", "cost", "role", "text")
    return both.mapInArrow(lambda batches: _batches(what(batches), out), schema.format(kind))


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, number (from 1), edit (K, R or I), role and text of their rows."""
    small_batches(rows.sparkSession)
    return _streamed(in_order(rows), _repaired, ROWS)


def digest(original: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each conv_id of ``original``: gaps, faults, illegal neighbours, cost, audit and hash of the conversation that ``rows`` hold."""
    small_batches(rows.sparkSession)
    ordered = in_order(rows)
    gaps = ordered.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    found = _streamed(ordered, _digests, DIGEST)
    met = original.select("conv_id").distinct()
    for part in (gaps, found):
        part = part.withColumnRenamed("conv_id", "_conv")
        met = met.join(part, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return met.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
