r"""Operator 8: repeated byte strings, by blockwise suffix sorting with a difference cover.

A byte is removed when it lies in a 100-byte string that also starts earlier:
in a document of smaller doc_id, or earlier in the same document.

1. *Candidate suffixes* (``_anchors``). In each window of 100 bytes the smallest
   hash of its 32-byte grams picks an anchor, so equal windows have equal anchors
   at equal distances. A run of windows with one anchor is one row: anchor hash,
   hash of all bytes of the run, place. This keeps 1 row for about 31 suffixes and
   loses no equal pair. Rows with the same two hashes are combined in the task
   that makes them, before the shuffle: all but the earliest are repeats already.
2. *Buckets*. Rows meet by anchor hash, the suffix bucket. An anchor that occurs once
   holds no repeat. Runs equal as a whole (96 bits of hash) are repeats but for the
   earliest. Only the earliest runs of anchors that have several are left over.
3. *Block by block sort* (``_sort_block``). The bytes of those runs are sent by
   bucket. A task takes as many buckets as fit in a block and sorts their
   suffixes, by distance from the anchor and by the first 31 and the last 31
   bytes, eight bytes at a time. Suffixes that still tie are compared by ranks:
   the 69-byte strings at the positions of a difference cover modulo 31 are ranked
   together, and any two suffixes have a common offset below 31 at which both
   are in the cover. Suffixes at different distances never tie, so the block's suffixes are
   sorted a few distances at a time. Memory depends on the block, not on the corpus.
4. *Removal*. Spans meet their document by one shuffle of the texts, used twice.

Anchors that are very frequent (estimated on a sample, which affects the route and not
the result) are taken window by window: each window is then its own bucket, combined
before the shuffle, so no bucket grows with the number of documents that share a line.

A row is known by (doc_id, 64-bit hash of its text) everywhere, so rows without a doc_id, or
with that of another row, never get each other's spans.

Defined results: null text is empty; a null doc_id sorts after all others; rows that
repeat a doc_id (null too) are ordered by the hash of their texts, and rows equal in both are
one document that is there several times: they are never earlier than one another and lose the same bytes;
an empty table gives an empty result. Other columns are carried in a struct, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import Spans, gram_hash, mix, pieces, runs, utf8
from .common import cut_lineage, small_batches

LENGTH = 100
GRAM_LOG2 = 5
GRAM = 1 << GRAM_LOG2
RUN = LENGTH - GRAM + 1
#: Difference cover: every residue modulo 31 is a difference of two of these (fixed values).
COVER_PERIOD, COVER = 31, np.array([1, 5, 11, 24, 25, 27])
#: Length of the cover's strings: with the first and last 31 bytes they cover 100 bytes from any offset below 31.
COVER_LENGTH = LENGTH - COVER_PERIOD
#: Bytes of suffix buckets that are held at once, and suffixes of them that are sorted at once (but for those of one distance).
BLOCK_BYTES, SORT_SUFFIXES = 1 << 18, 1 << 16
#: An anchor with more rows than this is taken window by window. The list of such anchors is sent to tasks; where it would pass
#: MOST_HOT (64 MB), the rarest of them stay buckets of their own.
HOT_ROWS, HOT_SAMPLE, MOST_HOT = 2_500, 1 / 64, 1 << 23

_INDEX_BITS = 26
_LAST = (1 << 63) - 1
SPANS = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))
ANCHOR_SCHEMA = "repeat boolean, h long, c int, doc long, print long, at long"
#: Bytes of text whose equal runs are combined before the shuffle, rows that are held for it at most (but for those of one piece), and rows
#: sent to Spark at once. Frequent anchors make a row for each byte, so without the second bound a task would hold millions of rows.
COMBINE_BYTES, COMBINE_ROWS, SEND_ROWS = 8 << 20, 1 << 19, 1 << 16


def _windows(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple | None:
    """Runs of windows with one anchor: bucket, content, piece, first window, last window, anchor (piece-relative)."""
    origin = int(begin[0])
    text = data[origin : int(end[-1])]
    if len(text) < LENGTH:
        return None
    grams = gram_hash(text, GRAM_LOG2)
    low = np.uint64((1 << _INDEX_BITS) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    step = 1
    while 2 * step <= RUN:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    least = np.minimum(least[: len(text) - LENGTH + 1], least[RUN - step :])
    begin, end = begin - origin, end - origin
    whole = end - begin >= LENGTH
    counts = end[whole] - begin[whole] - LENGTH + 1
    if not len(counts):
        return None
    jump = np.cumsum(counts) - counts
    window = np.arange(counts.sum()) + np.repeat(begin[whole] - jump, counts)
    anchor = (least[window] & low).astype(np.int64)
    cut = np.flatnonzero(np.diff(anchor)) + 1
    first, last = window[np.r_[0, cut]], window[np.r_[cut - 1, len(window) - 1]]
    anchor = anchor[np.r_[0, cut]]
    content = Spans(text)
    piece = np.searchsorted(begin, first, "right") - 1
    return grams[anchor], content, piece, first, last, anchor


def _anchors(hot: np.ndarray):
    """Batches (doc, print, text) to rows of ANCHOR_SCHEMA: a run's bucket, or a span that is a repeat within this batch."""

    def one(data, offsets) -> Iterator[tuple]:
        for rows, begin, end in pieces(offsets, LENGTH - 1):
            if (found := _windows(data, begin, end)) is None:
                continue
            bucket, content, piece, first, last, anchor = found
            own = np.isin(bucket, hot) if len(hot) else np.zeros(len(bucket), bool)
            if own.any():
                spread = last[own] - first[own] + 1
                at = np.repeat(first[own], spread) + np.arange(spread.sum()) - np.repeat(np.cumsum(spread) - spread, spread)
                bucket = np.r_[bucket[~own], np.repeat(bucket[own], spread) ^ content(at, at + LENGTH)]
                piece = np.r_[piece[~own], np.repeat(piece[own], spread)]
                anchor = np.r_[anchor[~own], np.repeat(anchor[own], spread)]
                first, last = np.r_[first[~own], at], np.r_[last[~own], at]
            row = rows[piece]
            at = ((first + begin[0] - offsets[row]) << 14) | ((last - first) << 7) | (anchor - first)
            yield bucket, content(first, last + LENGTH), row, at

    def combined(data, offsets, doc, print_):
        place, owner = _documents(doc, print_)
        held, spans, size = [], [], 0

        def rows(h, c, d, at):
            row = owner[d]
            return _rows(False, h, c, doc[row], print_[row], at)

        for h, c, row, at in one(data, offsets):
            held.append((h, (c >> np.uint64(32)).astype(np.uint32).view(np.int32), place[row], at))
            size += len(h)
            if size >= COMBINE_ROWS:
                least, again = _combined(held)
                spans.append(again)
                held, size = [least], len(least[0])
                if size > COMBINE_ROWS // 2:
                    yield from rows(*least)
                    held, size = [], 0
        if held:
            least, again = _combined(held)
            spans.append(again)
            yield from rows(*least)
        if sum(len(x[0]) for x in spans):
            d, begin, until = _merged(*(np.concatenate(x) for x in zip(*spans, strict=True)))
            row = owner[d]
            yield from _rows(True, mix(doc[row].view(np.uint64) ^ begin.view(np.uint64)), (until - begin).astype(np.int32), doc[row], print_[row], begin)

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            doc, print_ = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for i, j in runs(offsets, COMBINE_BYTES):
                yield from combined(data, offsets[i : j + 1], doc[i:j], print_[i:j])

    return run


def _combined(held: list[tuple]) -> tuple[tuple, tuple]:
    """Of rows (bucket, content, place of the document, at): the earliest of each bucket and content, and the others' spans, merged."""
    h, c, d, at = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((at, d, c, h))
    h, c, d, at = h[order], c[order], d[order], at[order]
    same = np.r_[False, (h[1:] == h[:-1]) & (c[1:] == c[:-1]) & ((d[1:] != d[:-1]) | (at[1:] != at[:-1]))]
    kept = np.flatnonzero(~same)[np.argsort(order[~same])]
    d_same, at_same = d[same], at[same]
    spans = (d_same, at_same >> 14, (at_same >> 14) + (at_same >> 7 & 127) + LENGTH)
    return (h[kept], c[kept], d[kept], at[kept]), _merged(*spans) if len(d_same) else spans


def _documents(doc: np.ndarray, print_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each row's document in order of (doc, print), equal for equal rows, and one row of each place."""
    order = np.lexsort((print_, doc))
    fresh = np.r_[True, (doc[order][1:] != doc[order][:-1]) | (print_[order][1:] != print_[order][:-1])][: len(order)]
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(fresh) - 1
    return place, order[fresh]


def _rows(repeat: bool, h, c, doc, print_, at) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(h), SEND_ROWS):
        part = slice(i, i + SEND_ROWS)
        arrays = [pa.array(np.full(len(h[part]), repeat)), pa.array(h[part].view(np.int64)), *(pa.array(x[part]) for x in (c, doc, print_, at))]
        yield pa.RecordBatch.from_arrays(arrays, ["repeat", "h", "c", "doc", "print", "at"])


def _merged(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of spans within each document, as maximal spans."""
    order = np.lexsort((begin, doc))
    doc, begin, end = doc[order], begin[order], end[order]
    start = np.r_[True, doc[1:] != doc[:-1]]
    group = np.cumsum(start) - 1
    # ends only grow within a document: lift each document above the one before
    reach = np.empty_like(end)
    bounds = np.r_[np.flatnonzero(start), len(doc)]
    if len(bounds) - 1 > 0:
        dense = np.unique(end, return_inverse=True)
        lifted = np.maximum.accumulate(group * (len(dense[0]) + 1) + dense[1])
        reach = dense[0][lifted - group * (len(dense[0]) + 1)]
    fresh = start | np.r_[True, begin[1:] > reach[:-1]]
    at = np.flatnonzero(fresh)
    return doc[at], begin[at], reach[np.r_[at[1:] - 1, len(doc) - 1]]


def _words(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes at each position as a number that sorts as they do."""
    out = np.zeros(len(at), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | text[at + k]
    return out


def _refine(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Ranks of (group, key)."""
    order = np.lexsort((key, group))
    g, k = group[order], key[order]
    rank = np.empty(len(group), np.int64)
    rank[order] = np.cumsum(np.r_[False, (g[1:] != g[:-1]) | (k[1:] != k[:-1])])
    return rank


def _tied(rank: np.ndarray) -> np.ndarray:
    return np.bincount(rank, minlength=1)[rank] > 1


def _sort_block(text, bucket, begin, doc, at):
    """Repeated windows of one block of buckets: index of the run, first window and last window (run-relative).

    text: all bytes of the block; run i covers text[begin[i]:begin[i + 1]].
    """
    count, farthest = (at >> 7 & 127) + 1, at & 127
    found = []
    for near, far in _distances(farthest - count + 1, farthest):
        # the windows of each run that are so far from its anchor
        first, stop = np.maximum(farthest - far, 0), np.minimum(farthest - near + 1, count)
        size = np.maximum(stop - first, 0)
        owner = np.repeat(np.arange(len(count)), size)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + first[owner]
        again = _earlier_too(text, bucket, begin, doc, at, owner, step)
        found.append((owner[again] << 7) | step[again])
    again = np.sort(np.concatenate(found))
    owner, step = again >> 7, again & 127
    if not len(again):
        return owner, step, step
    cut = np.flatnonzero((np.diff(step) != 1) | (np.diff(owner) != 0)) + 1
    first, last = np.r_[0, cut], np.r_[cut - 1, len(again) - 1]
    return owner[first], step[first], step[last]


def _distances(nearest: np.ndarray, farthest: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges (nearest, farthest) of distances that cover those of all runs, each with at most SORT_SUFFIXES suffixes or of one distance."""
    count = np.cumsum(np.bincount(nearest, minlength=129) - np.bincount(farthest + 1, minlength=129)).tolist()
    begin, size = 0, 0
    for distance, n in enumerate(count):
        if size and size + n > SORT_SUFFIXES:
            yield begin, distance - 1
            begin, size = distance, 0
        size += n
    yield begin, len(count) - 1


def _earlier_too(text, bucket, begin, doc, at, owner, step):
    """Which of the suffixes (owner: run, step: place in the run) also start earlier."""
    place = begin[:-1][owner] + step
    distance = (at & 127)[owner] - step
    rank = _refine(bucket[owner], distance)
    live = np.flatnonzero(_tied(rank))
    head = [0, 8, 16, COVER_PERIOD - 8]
    rank = rank[live]
    for offset in [*head, *(COVER_LENGTH + x for x in head)]:
        rank = _refine(rank, _words(text, place[live] + offset))
        keep = _tied(rank)
        live, rank = live[keep], rank[keep]
        if not len(live):
            return live
    # ranks of the cover's strings that the tied suffixes need
    samples = place[live][:, None] + (COVER[None, :] - place[live][:, None]) % COVER_PERIOD
    used, which = np.unique(samples, return_inverse=True)
    cover = np.zeros(len(used), np.int64)
    for offset in [*range(0, COVER_LENGTH - 8, 8), COVER_LENGTH - 8]:
        cover = _refine(cover, _words(text, used + offset))
    which = which.reshape(samples.shape)
    order = np.empty(len(live), np.int64)
    order[np.lexsort((at[owner[live]] + (step[live] << 14), doc[owner[live]]))] = np.arange(len(live))
    # equal places (a repeated row) share a number
    by = np.argsort(order)
    d, a = doc[owner[live]][by], (at[owner[live]] >> 14)[by] + step[live][by]
    order[by] = np.cumsum(np.r_[False, (d[1:] != d[:-1]) | (a[1:] != a[:-1])])
    # two equal suffixes share (offset, rank) at one element of the cover each, seldom the same element
    offset = (samples - place[live][:, None]).ravel()
    key = _refine(_refine(np.repeat(rank, len(COVER)), offset), cover[which].ravel())
    least = np.full(key.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, key, np.repeat(order, len(COVER)))
    earliest = least[key].reshape(samples.shape).min(axis=1)
    return live[earliest < order]


def _bucket_sort(batches):
    """Batches (h, doc, print, at, bytes), sorted by h, to spans (doc, print, begin, end); a block ends where a bucket ends."""

    def sort(h, doc, print_, at, parts):
        text = np.frombuffer(b"".join(parts) + bytes(8), np.uint8)
        begin = np.r_[0, np.cumsum((at >> 7 & 127) + LENGTH)]
        run, first, last = _sort_block(text, h, begin, _documents(doc, print_)[0], at)
        place = (at[run] >> 14) + first
        arrays = (doc[run], print_[run], place, place + (last - first) + LENGTH)
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in arrays], ["doc", "print", "begin", "end"])

    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)), batch.column(4).to_pylist()])
        size += sum(map(len, held[-1][4]))
        if size >= BLOCK_BYTES:
            columns = [np.concatenate(x) for x in list(zip(*held, strict=True))[:4]] + [[y for x in held for y in x[4]]]
            cut = int(np.searchsorted(columns[0], columns[0][-1], "left"))
            if cut:
                yield sort(*(x[:cut] for x in columns))
            held, size = [[x[cut:] for x in columns]], sum(map(len, columns[4][cut:]))
    if held:
        yield sort(*(np.concatenate(x) for x in list(zip(*held, strict=True))[:4]), [y for x in held for y in x[4]])


def _cut_runs(at_text: int):
    """Batches (row, doc, print, runs of (h, at)) to the bytes of each run."""

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(0).field(at_text))
            doc, print_ = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            lists = batch.column(3)
            flat = lists.flatten()
            h, at = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            row = np.repeat(np.arange(len(doc)), lists.value_lengths().to_numpy(zero_copy_only=False))
            begin = offsets[row] + (at >> 14)
            end = begin + (at >> 7 & 127) + LENGTH
            view = memoryview(np.ascontiguousarray(data))
            for i in range(0, len(h), SEND_ROWS):
                s = slice(i, i + SEND_ROWS)
                # pyarrow never lets go of a memoryview, which would keep all texts of the task
                part = pa.array([bytes(view[a:b]) for a, b in zip(begin[s].tolist(), end[s].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(h[s]), pa.array(doc[row[s]]), pa.array(print_[row[s]]), pa.array(at[s]), part], ["h", "doc", "print", "at", "part"])

    return run


def _hot_anchors(texts: DataFrame) -> np.ndarray:
    """Anchors that are probably above HOT_ROWS, at most MOST_HOT of them."""
    sample = texts.sample(HOT_SAMPLE, seed=1).mapInArrow(_anchors(np.zeros(0, np.uint64)), ANCHOR_SCHEMA).where("not repeat")
    counts = sample.groupBy("h").count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    least = max(HOT_ROWS * HOT_SAMPLE, total / MOST_HOT)
    return np.sort(np.array([r[0] for r in counts.where(F.col("count") > least).select("h").toLocalIterator()], np.int64).view(np.uint64))


def _spanned(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per row of docs: ``row`` (all its columns) and ``spans``, spans of repeated bytes that may overlap."""
    small_batches(docs.sparkSession)
    keyed = docs.select(
        F.struct("*").alias("row"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)).alias("doc"),
        F.coalesce(F.xxhash64(text), F.lit(0)).alias("print"),
    )
    texts = keyed.select("doc", "print", F.col("row").getField(text).alias("text"))
    found = texts.mapInArrow(_anchors(_hot_anchors(texts)), ANCHOR_SCHEMA)
    bucket, same = Window.partitionBy("h"), Window.partitionBy("h", "c").orderBy("doc", "print", "at")
    marked = (
        found.withColumn("first", F.first(F.struct("doc", "print", "at")).over(same))
        .withColumn("several", F.min("c").over(bucket) != F.max("c").over(bucket))
        .withColumn("again", F.struct("doc", "print", "at") != F.col("first"))
        .where("repeat or several or again")
    )
    begin = F.when(F.col("repeat"), F.col("at")).otherwise(F.shiftright("at", 14))
    size = F.when(F.col("repeat"), F.col("c").cast("long")).otherwise(F.shiftright("at", 7).bitwiseAND(F.lit(127)) + LENGTH)
    listed = cut_lineage(
        marked.groupBy("doc", "print").agg(
            F.collect_list(F.when(~F.col("again") & ~F.col("repeat"), F.struct("h", "at"))).alias("runs"),
            F.collect_list(F.when(F.col("again") | F.col("repeat"), F.struct(begin.alias("begin"), (begin + size).alias("end")))).alias("again"),
        )
    )
    joined = keyed.join(listed, ["doc", "print"], "left")
    parts = joined.where(F.size("runs") > 0).select("row", "doc", "print", "runs").mapInArrow(_cut_runs(docs.columns.index(text)), "h long, doc long, print long, at long, part binary")
    spans = parts.repartition(F.col("h")).sortWithinPartitions("h").mapInArrow(_bucket_sort, "doc long, print long, begin long, end long")
    spans = spans.groupBy("doc", "print").agg(F.collect_list(F.struct("begin", "end")).alias("more"))
    empty = F.array().cast("array<struct<begin:bigint,end:bigint>>")
    whole = F.concat(F.coalesce("again", empty), F.coalesce("more", empty))
    return joined.join(spans, ["doc", "print"], "left").select("row", whole.alias("spans"))


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: ``row`` (all its columns) and ``spans``, the maximal repeated spans (begin, end) in bytes."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _merged_lists(batch.column(1))], ["row", "spans"])

    return _spanned(docs, doc_id, text).mapInArrow(run, T.StructType([T.StructField("row", docs.schema), T.StructField("spans", SPANS)]))


def _merged_lists(lists: pa.ListArray) -> pa.ListArray:
    """Lists of spans to lists of maximal spans, in order."""
    flat = lists.flatten()
    begin, end = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(2))
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    if len(row):
        row, begin, end = _merged(row, begin, end)
    offsets = np.r_[0, np.cumsum(np.bincount(row, minlength=len(lists)))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(begin.astype(np.int64)), pa.array(end.astype(np.int64))], ["begin", "end"]))


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """What is left of a text without its spans."""
    parts, at = [], 0
    for begin, end in spans:
        parts.append(text[at:begin])
        at = end
    return b"".join([*parts, text[at:]]) if spans else text


def _per_row(batch, text_index: int) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
    data, offsets = utf8(batch.column(0).field(text_index))
    spans = _merged_lists(batch.column(1))
    flat = spans.flatten()
    begin, end = (flat.field(i).to_pylist() for i in range(2))
    at = np.r_[0, np.cumsum(spans.value_lengths().to_numpy(zero_copy_only=False))].tolist()
    raw = memoryview(np.ascontiguousarray(data))
    for i in range(len(spans)):
        yield bytes(raw[offsets[i] : offsets[i + 1]]), list(zip(begin[at[i] : at[i + 1]], end[at[i] : at[i + 1]], strict=True))


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the remaining bytes for each row of docs."""
    docs = docs.select(doc_id, text)
    fields = docs.columns
    at_text = fields.index(text)

    def run(batches):
        for batch in batches:
            size, gone, count, sha = [], [], [], []
            for raw, spans in _per_row(batch, at_text):
                size.append(len(raw))
                gone.append(sum(e - b for b, e in spans))
                count.append(len(spans))
                sha.append(hashlib.sha256(kept_bytes(raw, spans)).hexdigest())
            ids = batch.column(0).field(fields.index(doc_id)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _spanned(docs, doc_id, text).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """docs with the repeated spans cut out of the texts; halves of cut characters go too. Null stays null."""
    fields = docs.schema.names
    at_text = fields.index(text)

    def run(batches):
        for batch in batches:
            row = batch.column(0)
            columns = [row.field(i) for i in range(len(fields))]
            was_null = columns[at_text].is_null().to_pylist()
            texts = [None if null else kept_bytes(raw, spans).decode("utf-8", "ignore") for null, (raw, spans) in zip(was_null, _per_row(batch, at_text), strict=True)]
            columns[at_text] = pa.array(texts, pa.string())
            if n_chars in fields:
                columns[fields.index(n_chars)] = pa.array([None if x is None else len(x) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(columns, fields)

    return _spanned(docs, doc_id, text).mapInArrow(run, docs.schema)
