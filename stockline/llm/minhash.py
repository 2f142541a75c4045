r"""Operator 4: near duplicates by fast similarity sketching, banding and exact verification.

1. A document's set: distinct shingles of ``shingle`` words of the whole text, as 64-bit hashes.
2. *Sketch* (``sketch``): in round i each shingle is put in a hashed bin with a hashed value that
   ranks after those of all earlier rounds; every bin keeps its least value. After ``SIZE`` rounds,
   round SIZE + j puts all shingles in bin j, so every coordinate is filled. It takes
   O(n + SIZE log SIZE) expected steps and keeps the concentration of independent coordinates.
3. Documents with one set are one class, a node with a number of its own, represented by the text of one row. Classes meet
   where all rows of a band agree. With 32 bands of 5 rows a pair at similarity 0.85 fails to meet
   with probability 1e-8, at 0.8 with 4e-6.
4. Links are confirmed on the full sets. Each member of a bucket is compared with the bucket's centre, the member
   that meets most others. Where members of a centre are then in several components, those outside the largest one look for
   partners by a prefix filter on their differences from the centre (``_candidates``), which loses no similar pair and meets no
   pair in what it shares with the centre. Pairs inside a component are never made, so a group of n copies
   gives about n pairs, and no link between components is lost.
5. Components: least label over links with pointer jumping; each step is cut by a checkpoint. A component's id is its least doc_id.

Hot groups: exact copies and buckets are pre-aggregated before their shuffles, and rows meet their
bucket in joins that adaptive execution splits.

Defined results: null or empty text has an empty set, is linked with nothing and is its own
component; rows are told apart by doc_id and text (64 bits of hash), never by doc_id alone, so rows that repeat a doc_id, or
have none, are each placed by their own text (components with the same least doc_id have one component_id); a null doc_id sorts last and comes back as null, and a component of such rows has component_id null and its rows are ``kept``; an empty
table gives an empty result. Only ``doc_id`` and ``text`` are read, so other columns can't clash. ``distinct`` keeps one row for each component
even where ids repeat or are null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import mix, utf8, word_hashes
from .common import cut_lineage, small_batches

BANDS, ROWS = 32, 5
SIZE = BANDS * ROWS
_LAST = (1 << 63) - 1
_SEEDS = mix(np.arange(1, 2 * SIZE + 1, dtype=np.uint64) * np.uint64(0x9E3779B9))
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW = np.uint64(0xFFFFFFFF)
_A, _B = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


def sketch(values: np.ndarray) -> np.ndarray:
    """SIZE coordinates (round, hash) of a non-empty set of hashes."""
    least = np.full(SIZE, _FULL)
    together = min(SIZE, max(1, 2 * SIZE // len(values)))  # rounds at once; later rounds never displace earlier ones
    for i in range(0, SIZE, together):
        seeds = _SEEDS[i : min(i + together, SIZE)]
        h = mix(values[None, :] ^ seeds[:, None])
        bins = ((h >> np.uint64(32)) * np.uint64(SIZE)) >> np.uint64(32)
        value = (np.arange(i, i + len(seeds), dtype=np.uint64)[:, None] << np.uint64(32)) | (h & _LOW)
        np.minimum.at(least, bins.ravel().astype(np.int64), value.ravel())
        if not (least == _FULL).any():
            return least
    for j in np.flatnonzero(least == _FULL):
        least[j] = (np.uint64(SIZE + j) << np.uint64(32)) | (mix(values ^ _SEEDS[SIZE + j]) & _LOW).min()
    return least


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    """BANDS keys for each row of SIZE coordinates; the same rows in another band have another key."""
    rows = coordinates.reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _A, rows.shape[:2])
    for k in range(ROWS):
        key = mix(key * _B + rows[:, :, k])
    return key


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int):
    """Row and sorted distinct shingle hashes of each row that has words."""
    for row, word in word_hashes(data, offsets):
        begins = np.r_[0, np.flatnonzero(np.diff(row)) + 1, len(row)]
        hashed = word
        for k in range(1, size):
            hashed = mix(hashed[: len(word) - k] * _A + word[k:]) if len(word) > k else np.zeros(0, np.uint64)
        for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
            if b - a >= size:
                values = np.sort(hashed[a : b - size + 1])
                yield row[a], values[np.r_[True, values[1:] != values[:-1]]]
            elif b > a:
                key = np.uint64(b - a)
                for w in word[a:b]:
                    key = mix(np.array([key]) * _B + w)[0]
                yield row[a], np.array([key])


def _sketches(size: int):
    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            n = np.zeros(batch.num_rows, np.int64)
            prints = np.zeros((2, batch.num_rows), np.uint64)
            coordinates = []
            for i, values in shingle_sets(data, offsets, size):
                n[i] = len(values)
                prints[0, i] = mix(values).sum(dtype=np.uint64)
                prints[1, i] = (values * (values >> np.uint64(7) | np.uint64(1))).sum(dtype=np.uint64)
                coordinates.append(sketch(values))
            keys = band_keys(np.array(coordinates, np.uint64).reshape(-1, SIZE)).view(np.int64).ravel()
            lengths = np.r_[0, np.cumsum((n > 0) * BANDS)].astype(np.int32)
            f = [pa.array(x.view(np.int64)) for x in prints]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), *f, pa.ListArray.from_arrays(pa.array(lengths), pa.array(keys))], ["doc", "print", "n", "f1", "f2", "bands"])

    return run


def _full_sets(size: int):
    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            sets: list = [None] * batch.num_rows
            for i, values in shingle_sets(data, offsets, size):
                sets[i] = values.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["doc", "shingles"])

    return run


def _similar(common: int, x: int, y: int, percent: int) -> bool:
    return 100 * common >= percent * (x + y - common)


def _confirmed(percent: int):
    """Batches (a, b, set of a, set of b) to the pairs that are similar."""

    def run(batches):
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (left, right))
                if _similar(min(len(x), len(y)), len(x), len(y), percent):
                    both = np.sort(np.concatenate((x, y)), kind="stable")
                    keep[i] = _similar(int((both[1:] == both[:-1]).sum()), len(x), len(y), percent)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["a", "b"])

    return run


def _compared(percent: int):
    """Batches (centre, member, their sets) to: n, d, whether they are similar, and the member's prefix.

    d shingles are in one of the two sets: those that the centre lacks, then those that the member lacks. With e = (100 + percent) d -
    (100 - percent) (sum of both sizes), above 0 if they aren't similar, a member of another component that is similar to this one
    has e / 200 of these in common with it at least, so the prefix ends where fewer are left.
    """

    def run(batches):
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            size, different, similar, prefixes = [], [], [], []
            for i in range(batch.num_rows):
                c, x = (np.frombuffer(k[i].as_buffer(), np.uint64) for k in (left, right))
                at = np.minimum(np.searchsorted(c, x), len(c) - 1)
                there = c[at] == x
                lacks = np.ones(len(c), bool)
                lacks[at[there]] = False
                both = np.concatenate((x[~there], c[lacks]))
                size.append(len(x))
                different.append(len(both))
                similar.append(_similar(int(there.sum()), len(c), len(x), percent))
                beyond = (100 + percent) * len(both) - (100 - percent) * (len(c) + len(x))
                prefixes.append(both[: (200 * len(both) - max(beyond, 0)) // 200 + 1].view(np.int64))
            offsets = np.r_[0, np.cumsum([len(x) for x in prefixes])].astype(np.int32)
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            columns = [batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(different, pa.int64()), pa.array(similar, pa.bool_()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "n", "d", "similar", "prefix"])

    return run


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")


def components(links: DataFrame) -> DataFrame:
    """Least reachable doc of each linked doc, from links (a, b)."""
    both = cut_lineage(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = cut_lineage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("doc"), "label"))
    while True:
        near = both.join(labels.select(F.col("doc").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        stepped = labels.join(near.withColumnRenamed("a", "doc"), "doc").select("doc", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("doc").alias("label"), F.col("label").alias("above"))
        stepped = cut_lineage(stepped.join(up, "label").select("doc", "was", F.least("label", "above").alias("label")))
        done = stepped.where("was <> label").isEmpty()
        labels = stepped.select("doc", "label")
        if done:
            return labels


def _candidates(starred: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that have a centre in common and can be similar.

    The differences of two sets from their centre, d and e shingles with k in common, tell how far they differ from one another: by d + e - 2 k
    shingles. So n and m shingles are similar where 2 (100 + percent) k >= (100 + percent) (d + e) - (100 - percent) (n + m). The right
    side is above 0 unless both are similar to the centre, and then they are in one component. At their first common shingle, at places i and j of a
    common order, k is at most min(d - i, e - j), and after the last one that is met at most as many are left. Members of a group of copies
    don't meet in what all of them have. Only members outside the largest component of their centre look for partners.
    """
    placed = starred.join(labels.select(F.col("doc").alias("b"), "label"), "b", "left").withColumn("label", F.coalesce("label", "b"))
    several = placed.groupBy("a").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("a")
    placed = cut_lineage(placed.join(several, "a").select("a", "b", "n", "d", "label", "prefix"))
    parts = placed.groupBy("a", "label").agg(F.count("*").alias("size"))
    largest = parts.groupBy("a").agg(F.max(F.struct("size", "label")).alias("top")).select("a", F.col("top.label").alias("top"))
    side = lambda rows, v: rows.select("a", F.col("b").alias(v), F.col("n").alias(f"{v}_n"), F.col("d").alias(f"{v}_d"), F.col("label").alias(f"{v}_label"), F.posexplode("prefix").alias(f"{v}_i", "shingle"))
    x, y = side(placed.join(largest, "a").where("label <> top"), "x"), side(placed, "y")
    enough = lambda k, x_n, x_d, y_n, y_d: 2 * (100 + percent) * k >= (100 + percent) * (x_d + y_d) - (100 - percent) * (x_n + y_n)
    sizes = ["x_n", "x_d", "y_n", "y_d"]
    left = lambda i, j: F.least(F.col("x_d") - F.col(i), F.col("y_d") - F.col(j))
    met = x.join(y, ["a", "shingle"]).where((F.col("x_label") != F.col("y_label")) & enough(left("x_i", "y_i"), *map(F.col, sizes)))
    pairs = met.groupBy("a", "x", "y", *sizes).agg(F.count("*").alias("k"), F.max("x_i").alias("i"), F.max("y_i").alias("j"))
    pairs = pairs.where(enough(F.col("k") + left("i", "j") - 1, *map(F.col, sizes)))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _grouped(docs: DataFrame, doc_id: str, text: str, shingle: int, percent: int) -> DataFrame:
    """doc, print, n, group_id (a node of the component, null for rows without words) and component for each row of docs."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)).alias("doc"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("print"), F.col(text).alias("text"))
    sketched = cut_lineage(texts.mapInArrow(_sketches(shingle), "doc long, print long, n long, f1 long, f2 long, bands array<long>"))
    key = ["n", "f1", "f2"]
    classes = sketched.where("n > 0").groupBy(*key).agg(F.min("doc").alias("least_doc"), F.first(F.struct("doc", "print")).alias("row"), F.first("bands").alias("bands"))
    classes = cut_lineage(classes.withColumn("node", F.monotonically_increasing_id()))
    member = classes.select(F.col("node").alias("member"), F.explode("bands").alias("band"))
    shared = member.groupBy("band").agg(F.count("*").alias("size"), F.min("member").alias("low"), F.max("member").alias("high")).where("low <> high").select("band", "size")
    buckets = cut_lineage(member.join(shared, "band").distinct())
    # a bucket's centre is its member that meets most others over all bands
    weight = buckets.groupBy("member").agg(F.sum("size").alias("weight"))
    weighted = buckets.join(weight, "member")
    centre = weighted.groupBy("band").agg(F.max(F.struct("weight", -F.col("member"))).alias("top")).select("band", (-F.col("top")[F.lit("col2")]).alias("centre"))
    pairs = buckets.join(centre, "band").where("member <> centre").select(F.col("centre").alias("a"), F.col("member").alias("b")).distinct()
    involved = classes.join(buckets.select(F.col("member").alias("node")).distinct(), "node").select("node", "row.doc", "row.print")
    # rows equal in doc and print are one text
    found = texts.join(involved, ["doc", "print"]).groupBy("doc", "print", "node").agg(F.first("text").alias("text"))
    sets = cut_lineage(found.select("node", "text").mapInArrow(_full_sets(shingle), "doc long, shingles binary").where("shingles is not null"))
    starred = cut_lineage(_with_sets(pairs, sets).mapInArrow(_compared(percent), "a long, b long, n long, d long, similar boolean, prefix array<long>"))
    links = starred.where("similar").select("a", "b")
    labels = components(links)
    more = cut_lineage(_candidates(starred, labels, percent))
    if not more.isEmpty():
        found = cut_lineage(_with_sets(more, sets).mapInArrow(_confirmed(percent), "a long, b long"))
        labels = components(links.union(found))
    nodes = classes.select(*key, "node", "least_doc").join(labels.select(F.col("doc").alias("node"), "label"), "node", "left").withColumn("group_id", F.coalesce("label", "node"))
    least = nodes.where("label is not null").groupBy("label").agg(F.min("least_doc").alias("least"))
    nodes = nodes.join(least, "label", "left").select(*key, "group_id", F.coalesce("least", "least_doc").alias("component"))
    linked = sketched.where("n > 0").join(nodes, key).select("doc", "print", "n", "group_id", "component")
    alone = sketched.where("n = 0").select("doc", "print", "n", F.lit(None).cast("long").alias("group_id"), F.col("doc").alias("component"))
    return linked.unionByName(alone)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept. Links have 100 * common >= percent * union."""
    whole = _grouped(docs, doc_id, text, shingle, percent)
    null_last = lambda c: F.when(F.col(c) == _LAST, F.lit(None)).otherwise(F.col(c)).alias(c)
    named = whole.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("doc") == F.col("component")).alias("kept"))
    return named.select(null_last("doc_id"), "n_shingles", null_last("component_id"), "kept")


def distinct(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row for each component: that of the least doc_id, of the least hash of the text if several rows have it.

    Rows that repeat a doc_id and a text are one row, with words or without.
    """
    whole = _grouped(docs, doc_id, text, shingle, percent)
    chosen = whole.where("n > 0").groupBy("group_id").agg(F.min(F.struct("doc", "print")).alias("x")).select("x.doc", "x.print")
    chosen = chosen.union(whole.where("n = 0").select("doc", "print").distinct()).withColumnsRenamed({"doc": "_doc", "print": "_print"})
    keyed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)).alias("_doc"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("_print"))
    return keyed.join(chosen, ["_doc", "_print"], "left_semi").groupBy("_doc", "_print").agg(F.first("row").alias("row")).select("row.*")
