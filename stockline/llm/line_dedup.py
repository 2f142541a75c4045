r"""Operator 12: lines that many documents share, by sharded cuckoo filters backed by exact tables of reference counts.

A line's key is the line without ``[\x20\x09-\x0D]`` at both ends and with A-Z in lower case. Keys that at least ``least`` documents hold lose all
their lines. The state is two tables in the shared folder, so lines can be deduplicated as documents come and go:

- *counts*: key (128 bits of hash) and the number of documents that hold it, exact, hash-partitioned; a task combines a key's documents before the shuffle;
- *filters*: one cuckoo filter (16-bit fingerprints, four to a bucket) for each shard of about ``SHARD`` keys, with the keys of at least ``least``
  documents. Beside the filter are the keys of the exact table that it would wrongly report, so with its table it answers exactly.

``insert`` and ``delete`` add or subtract documents' keys in the counts and put the keys that cross ``least`` into the shard's filter or take
them out; the filter is made anew, from the exact table, only when it is full or the number of shards changes. A key's last document takes
the key away, so inserting documents and deleting them again gives the state before. ``without_shared`` asks the filters for each line of documents of the state.

Lines travel as hashes: (row, place, key), to their key's shard. Very frequent keys are split: a shard is dealt to as many groups as its lines
need, each with a copy of the filter (at most 2 MB). Texts are shuffled once, to meet the places of their lines that go.

Defined results: null and empty texts are one empty line; empty keys never go; rows that repeat doc_id and text are documents of their own,
and each counts; an empty table gives an empty result. ``delete`` takes documents that were inserted before. Other columns stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowtext import mix
from .common import written

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys of a shard, and lines of a group that asks a copy of its filter: a task's memory is a few times 10 MB.
SHARD, GROUP = 1 << 18, 1 << 18
#: The numbers of groups of so many shards (16 MB) are broadcast; beyond that they meet the lines in a join.
SMALL = 1 << 20
#: Fingerprints of a bucket, the share of places that may be taken, and rounds of moves before a filter counts as full.
SLOTS, LOAD, MOVES = 4, 0.9, 500


class Cuckoo:
    """A cuckoo filter of 64-bit hashes: a fingerprint lies in one of two buckets, each known from the other and the fingerprint."""

    def __init__(self, n_buckets: int, table: np.ndarray | None = None):
        self.mask = np.uint64(n_buckets - 1)
        self.table = np.zeros((n_buckets, SLOTS), np.uint16) if table is None else table

    @classmethod
    def sized(cls, n: int) -> Cuckoo:
        need = max(1, int(np.ceil(n / (SLOTS * LOAD))))
        return cls(1 << (need - 1).bit_length())

    @classmethod
    def of_bytes(cls, raw: bytes) -> Cuckoo:
        table = np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy()
        return cls(len(table), table)

    def _marks(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        marks = (keys >> np.uint64(48)).astype(np.uint16)
        return np.where(marks == 0, np.uint16(1), marks), mix(keys) & self.mask

    def _other(self, bucket: np.ndarray, marks: np.ndarray) -> np.ndarray:
        return (bucket ^ mix(marks.astype(np.uint64))) & self.mask

    def insert(self, keys: np.ndarray) -> bool:
        """Puts all keys in, round by round: those that find a free place, then those that drive out another. False if it is full."""
        marks, bucket = self._marks(keys)
        for turn in range(MOVES):
            for _ in range(2):
                order = np.argsort(bucket, kind="stable")
                marks, bucket = marks[order], bucket[order]
                first = np.r_[True, bucket[1:] != bucket[:-1]] if len(bucket) else np.zeros(0, bool)
                rank = np.arange(len(bucket)) - np.maximum.accumulate(np.where(first, np.arange(len(bucket)), 0))
                free = np.argsort(self.table[bucket] != 0, axis=1, kind="stable")
                room = (self.table[bucket] == 0).sum(1)
                put = rank < room
                self.table[bucket[put], free[put, rank[put]]] = marks[put]
                marks, bucket = marks[~put], bucket[~put]
                if not len(marks):
                    return True
                bucket = self._other(bucket, marks)
            _, one = np.unique(bucket, return_index=True)
            place = (mix(bucket[one] + np.uint64(turn)) & np.uint64(SLOTS - 1)).astype(np.int64)
            driven = self.table[bucket[one], place].copy()
            self.table[bucket[one], place] = marks[one]
            bucket = bucket.copy()
            marks[one], bucket[one] = driven, self._other(bucket[one], driven)
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Takes out one fingerprint for each key, all of which were put in."""
        marks, bucket = self._marks(keys)
        for m, b, c in zip(marks, bucket, self._other(bucket, marks), strict=True):
            at = b if (self.table[b] == m).any() else c
            self.table[at, int(np.argmax(self.table[at] == m))] = 0

    def __contains__(self, key: int) -> bool:
        return bool(self.holds(np.array([key], np.uint64))[0])

    def holds(self, keys: np.ndarray) -> np.ndarray:
        marks, bucket = self._marks(keys)
        return (self.table[bucket] == marks[:, None]).any(1) | (self.table[self._other(bucket, marks)] == marks[:, None]).any(1)


@dataclass(frozen=True)
class State:
    """The two tables (None before the first batch), the number of shards, and the threshold that the filters are for."""

    counts: DataFrame | None
    filters: DataFrame | None
    shards: int
    least: int


def empty(least: int = 10) -> State:
    return State(None, None, 0, least)


def _lines() -> Column:
    return F.split(F.coalesce("text", F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def hashed_lines(docs: DataFrame) -> DataFrame:
    """row (128 bits that doc_id and text decide) and keys: two hashes for each line, null for lines without a key."""
    key = lambda x: F.when(x != "", F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b")))
    keys = F.transform(F.transform(_lines(), _key), key)
    return docs.select(*_row(), keys.alias("keys"))


def _row() -> list[Column]:
    return [F.xxhash64("doc_id", "text").alias("row_a"), F.xxhash64("text", "doc_id").alias("row_b")]


def _shard(shards: int) -> Column:
    return F.pmod(F.col("a"), F.lit(shards))


FILTERS = "shard long, cuckoo binary, wrong binary, n_held long"
_FILTERS = pa.schema([("shard", pa.int64()), ("cuckoo", pa.binary()), ("wrong", pa.binary()), ("n_held", pa.int64())])


def _filtered(least: int):
    """The filter of a shard, from the one before and the shard's keys with their counts before (``was``) and now (``n``)."""

    def run(keys: pa.Table, before: pa.Table) -> pa.Table:
        if not keys.num_rows:
            return _FILTERS.empty_table()
        a, b, was, now = (keys.column(c).to_numpy() for c in ("a", "b", "was", "n"))
        marks, held, was_held = a.view(np.uint64), now >= least, was >= least
        cuckoo, put = Cuckoo.of_bytes(before.column("cuckoo")[0].as_py()) if before.num_rows else None, False
        if cuckoo is not None and held.sum() <= LOAD * cuckoo.table.size:
            cuckoo.delete(marks[was_held & ~held])
            put = cuckoo.insert(marks[held & ~was_held])
        size = len(Cuckoo.sized(int(held.sum())).table)
        while not put:
            cuckoo = Cuckoo(size)
            put, size = cuckoo.insert(marks[held]), 2 * size
        wrong = ~held & (now > 0) & cuckoo.holds(marks)
        return pa.table([[keys.column("shard")[0].as_py()], [cuckoo.table.tobytes()], [np.stack([a[wrong], b[wrong]], 1).tobytes()], [int(held.sum())]], schema=_FILTERS)

    return run


def _distinct(keys: Column) -> Column:
    """Each key of an array once, without null: sorted, since array_distinct compares structs pair by pair."""
    return F.transform(F.array(F.sort_array(keys)), lambda s: F.filter(s, lambda x, i: ~x.eqNullSafe(F.get(s, i - 1))))[0]


def _changed(state: State, hashed: DataFrame, sign: int) -> State:
    delta = hashed.select(F.explode(_distinct(F.col("keys"))).alias("k")).groupBy("k.a", "k.b").agg((sign * F.count("*")).alias("n"))
    delta = delta.select("a", "b", F.lit(0).cast("long").alias("was"), "n")
    if state.counts is not None:
        held = state.counts.select("a", "b", F.col("n").alias("was"), "n")
        delta = held.unionByName(delta).groupBy("a", "b").agg(F.sum("was").alias("was"), F.sum("n").alias("n"))
    merged = written(delta, "line-counts")
    n_keys = merged.count()
    shards = 1 << (-(-n_keys // SHARD) - 1).bit_length() if n_keys else 1
    filters = state.filters if state.filters is not None and shards == state.shards else None
    before = merged.sparkSession.createDataFrame([], FILTERS) if filters is None else filters
    sharded = merged.withColumn("shard", _shard(shards))
    if filters is None:  # made anew, from the exact table
        sharded = sharded.withColumn("was", F.lit(0).cast("long"))
    made = sharded.groupBy("shard").cogroup(before.groupBy("shard")).applyInArrow(_filtered(state.least), FILTERS)
    return State(merged.where("n > 0").select("a", "b", "n"), written(made, "line-filters"), shards, state.least)


def insert(state: State, docs: DataFrame) -> State:
    """The state with the lines of ``docs``."""
    return _changed(state, hashed_lines(docs), 1)


def delete(state: State, docs: DataFrame) -> State:
    """The state without the lines of ``docs``, which were inserted before."""
    return _changed(state, hashed_lines(docs), -1)


def _asked(lines: pa.Table, filters: pa.Table) -> pa.Table:
    """Rows and places of the lines whose keys a shard's filter holds, without those that it is known to report wrongly."""
    if not filters.num_rows or not lines.num_rows:
        return lines.select(["row_a", "row_b", "place"]).slice(0, 0)
    a, b = (lines.column(c).to_numpy() for c in "ab")
    held = Cuckoo.of_bytes(filters.column("cuckoo")[0].as_py()).holds(a.view(np.uint64))
    if raw := filters.column("wrong")[0].as_py():
        wrong = np.frombuffer(raw, np.int64).reshape(-1, 2)
        pair = np.dtype([("a", np.int64), ("b", np.int64)])
        held &= ~np.isin(np.rec.fromarrays([a, b], pair), np.rec.fromarrays([wrong[:, 0], wrong[:, 1]], pair))
    return lines.select(["row_a", "row_b", "place"]).filter(pa.array(held))


def shared_places(hashed: DataFrame, state: State) -> DataFrame:
    """row_a, row_b and places: the lines of each row that go, in order."""
    filters = state.filters.where("n_held > 0")
    # rows that repeat are asked for once
    lines = hashed.dropDuplicates(["row_a", "row_b"]).select("row_a", "row_b", F.posexplode("keys").alias("place", "k")).where("k IS NOT NULL")
    lines = lines.select("row_a", "row_b", "place", "k.a", "k.b").withColumn("shard", _shard(state.shards))
    sizes = hashed.select(F.explode("keys").alias("k")).where("k IS NOT NULL").select("k.a").groupBy(_shard(state.shards).alias("shard")).count()
    groups = filters.join(sizes, "shard").select("shard", F.ceil(F.col("count") / GROUP).alias("groups"), "cuckoo", "wrong")
    few = groups.select("shard", "groups")
    lines = lines.join(F.broadcast(few) if state.shards <= SMALL else few, "shard")
    lines = lines.withColumn("part", F.pmod(F.xxhash64("row_a", "place"), F.col("groups"))).drop("groups")
    copies = groups.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("part"), "cuckoo", "wrong")
    found = lines.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInArrow(_asked, "row_a long, row_b long, place int")
    return found.groupBy("row_a", "row_b").agg(F.array_sort(F.collect_list("place")).alias("places"))


def without_shared(docs: DataFrame, state: State, hashed: DataFrame | None = None) -> DataFrame:
    """``docs`` (all columns) with text without the lines that at least ``least`` documents of the state hold, n_lines and n_dropped."""
    hashed = hashed_lines(docs) if hashed is None else hashed
    if state.counts is None:
        found = hashed.select("row_a", "row_b", F.array().cast("array<int>").alias("places")).limit(0)
    else:
        found = shared_places(hashed, state)
    rows = docs.select(F.struct(*docs.columns).alias("doc"), *_row()).join(found, ["row_a", "row_b"], "left")
    lines = F.split(F.coalesce("doc.text", F.lit("")), "\n", -1)
    # what lies between the places that go, slice by slice: in the size of the text, whatever goes. The struct is made once for a row
    marks = F.concat(F.array(F.lit(-1)), F.col("places"), F.array(F.size(lines)))
    between = lambda d: F.transform(F.sequence(F.lit(0), F.size(d["marks"]) - 2), lambda i: F.slice(d["lines"], F.get(d["marks"], i) + 2, F.get(d["marks"], i + 1) - F.get(d["marks"], i) - 1))
    rest = F.transform(F.array(F.struct(lines.alias("lines"), marks.alias("marks"))), lambda d: F.array_join(F.flatten(between(d)), "\n"))[0]
    kept = F.when(F.col("places").isNull(), F.col("doc.text")).otherwise(rest)
    return rows.select(F.col("doc").withField("text", kept).alias("doc"), F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"))


def digest(docs: DataFrame, least: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of each row of ``docs``, judged against all of ``docs``."""
    hashed = written(hashed_lines(docs.select("doc_id", "text")), "lines")
    state = _changed(empty(least), hashed, 1)
    kept = without_shared(docs.select("doc_id", "text"), state, hashed)
    return kept.select("doc.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("doc.text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


#: The same rows in SQL: documents are numbered, so that rows that repeat count one by one.
DIGEST_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, generate_subscripts(lines, 1) AS i, unnest(lines) AS line FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
often AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
m AS (SELECT r, doc_id, i, line, key IN (SELECT key FROM often) AS goes FROM k)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE goes) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT goes), '')) AS kept_sha256
FROM m GROUP BY r
"""
