r"""Operator 13: groups of spelling variants, found by a frontier of states in a trie that is a table of edges.

1. *Words*: maximal runs ``[A-Za-zÀ-ÿ]+`` of whole texts, A-Z in lower case. Let h be the crc32 of ``<doc_id>:<run>``; if 97 divides h, the
   run loses its code point h % length (a planted slip). Results of at least ``least_length`` code points with at least ``least_count``
   occurrences are the words. Tasks count what they read before anything is shuffled.
2. *Trie*: an edge table (node, head, label, child). A node is the hash of a prefix and its length. Words that a chain of nodes has in common make one
   edge: the edges of a chain have the same words below, so one grouping by (least word, number of words) finds its ends, and a long word
   makes no deep trie. The last edge of a word ends in ``$``, has no child and holds the word.
3. *Frontier*: states (word, position, node, edits). All words that share a prefix are in one state: the prefix's own place in the trie stands
   for (word, position). States without an edit are a node beside itself, so the frontier begins with one edit, where two edges of a node
   differ: the heads are replaced, or the left one is left out. Each level joins the nodes of a state with their edges by the next code
   point and compares the labels; states that end together are neighbours.
   Two words differ first at one node only, so each pair is met once. A node has at most 91 edges and is near a bounded number of nodes, so no key of
   a join grows with the corpus.
4. *Forms*: a word's form is its neighbour of largest count, if that is at least ``ratio`` times its own; ``root`` follows forms to the last,
   by pointer doubling. Counts at least double along forms, so there are few rounds.

Each pair is confirmed by the edit distance of its two words. Nodes and words are known by 64 bits of hash and their depth (ten million nodes: one
chance in a hundred thousand that two are one).

Defined results: a null text has no words; a null doc_id is written as an empty text before the colon; rows that repeat are documents of
their own; of neighbours with equal counts the least in code-point order is the form; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import mix
from .common import cut_lineage, small_batches

LETTERS = "a-zÀ-ÿ"
#: One of so many runs of a document loses a code point.
SLIP = 97
#: Words that a task counts before it hands them on, and code points of a text that are read at once.
HELD, SLICE = 200_000, 1 << 20
_BASE = 0xD6E8FEB86659FD93


def _slices(text: str) -> Iterator[str]:
    """The text in parts that cut no run of letters, A-Z in lower case."""
    other, at = re.compile(f"[^A-Z{LETTERS}]"), 0
    while at < len(text):
        cut = other.search(text, at + SLICE) if len(text) - at > SLICE else None
        end = cut.start() if cut else len(text)
        yield text[at:end].encode().lower().decode()
        at = end


def _counted(batches: Iterator[pa.RecordBatch], least_length: int) -> Iterator[pa.RecordBatch]:
    runs = re.compile(f"[{LETTERS}]{{{least_length},}}")
    total: dict[str, int] = {}

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
        total.clear()
        return batch

    for batch in batches:
        for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            seed = zlib.crc32(f"{'' if doc is None else doc}:".encode())
            for part in _slices(text or ""):
                for run, n in Counter(runs.findall(part)).items():
                    h = zlib.crc32(run.encode(), seed)
                    if h % SLIP == 0:
                        i = h % len(run)
                        run = run[:i] + run[i + 1 :]
                        if len(run) < least_length:
                            continue
                    total[run] = total.get(run, 0) + n
                if len(total) >= HELD:
                    yield out()
    yield out()


def words(docs: DataFrame, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """word, n: what the runs of letters of all texts give, and how often."""
    small_batches(docs.sparkSession)
    counted = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(lambda batches: _counted(batches, least_length), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An edge for each code point of each word, and one for its end."""
    for batch in batches:
        spelled = batch.column(1).to_pylist()
        if not spelled:
            continue
        codes = np.frombuffer("".join(w + "\0" for w in spelled).encode("utf-32-le"), np.uint32)
        size = np.fromiter((len(w) + 1 for w in spelled), np.int64, len(spelled))
        begin = np.cumsum(size) - size
        depth = np.arange(len(codes)) - np.repeat(begin, size)
        powers = np.full(int(size.max()), np.uint64(_BASE))
        powers[0] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        value = mix(codes.astype(np.uint64)) * powers[depth]
        until = np.cumsum(value, dtype=np.uint64)
        before = until - value
        origin = np.repeat(before[begin], size)
        node = lambda sums, d: mix(sums - origin + d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
        child = np.where(codes > 0, node(until, depth + 1), 0)
        ids = np.repeat(batch.column(0).to_numpy(), size)
        yield pa.RecordBatch.from_arrays(
            [pa.array(node(before, depth)), pa.array(codes.astype(np.int32)), pa.array(child), pa.array(ids), pa.array(depth.astype(np.int32))], ["node", "c", "child", "id", "depth"]
        )


END = "$"


def trie(vocabulary: DataFrame) -> DataFrame:
    """node, head, label, child of each edge; child is null where a word ends, and there are its word and n."""
    spelled = vocabulary.select(F.xxhash64("word").alias("id"), "word", "n")
    rows = spelled.select("id", "word").mapInArrow(_prefixes, "node long, c int, child long, id long, depth int")
    steps = rows.groupBy("depth", "node", "c", "child").agg(F.count("*").alias("below"), F.min("id").alias("id"))
    chains = steps.groupBy("id", "below").agg(F.min(F.struct("depth", "node")).alias("top"), F.max(F.struct("depth", "child")).alias("last"))
    last = F.col("below") == 1
    edges = chains.join(spelled, "id").select(
        F.col("top.node").alias("node"),
        F.when(last, F.concat(F.expr("substring(word, top.depth + 1)"), F.lit(END))).otherwise(F.expr("substring(word, top.depth + 1, last.depth - top.depth + 1)")).alias("label"),
        F.when(~last, F.col("last.child")).alias("child"), F.when(last, F.col("word")).alias("word"), F.when(last, F.col("n")).alias("n"),
    )
    return edges.withColumn("head", F.left("label", F.lit(1)))


_SIDE = ("child", "label", "word", "n")


def _edges(edges: DataFrame, side: str) -> DataFrame:
    """The edge table as the next step of a side of states."""
    return edges.select("node", F.col("head").alias(f"{side}_head"), *(F.col(x).alias(f"{side}_{x}") for x in _SIDE))


def _settled(states: DataFrame) -> DataFrame:
    """States whose labels agree as far as both go, without what they share. ``ended``: both words are at their ends. Else the right side is at a node."""
    short = F.least(F.length("l_label"), F.length("r_label"))
    rest = {f"{x}_label": F.substring(f"{x}_label", short + 1, F.length(f"{x}_label")) for x in "lr"}
    kept = states.where(F.left("l_label", short) == F.left("r_label", short)).withColumns(rest)
    turn = F.col("r_label") != ""
    kept = kept.select(*(F.when(turn, F.col(f"{b}_{x}")).otherwise(F.col(f"{a}_{x}")).alias(f"{a}_{x}") for a, b in ("lr", "rl") for x in _SIDE))
    return kept.withColumn("ended", F.col("l_child").isNull() & F.col("r_child").isNull() & (F.col("l_label") == ""))


def first_states(edges: DataFrame) -> DataFrame:
    """States of one edit, made where two edges of a node differ."""
    forks = _edges(edges, "l").join(_edges(edges, "r"), "node").where((F.col("l_head") != F.col("r_head")) & (F.col("l_head") != END))
    left_out = F.struct(F.expr("substring(l_label, 2)").alias("l"), F.col("r_label").alias("r"))
    replaced = F.struct(F.expr("substring(l_label, 2)").alias("l"), F.expr("substring(r_label, 2)").alias("r"))
    once = (F.col("r_head") != END) & (F.col("l_head") < F.col("r_head"))
    states = forks.withColumn("edit", F.explode(F.when(once, F.array(left_out, replaced)).otherwise(F.array(left_out))))
    return _settled(states.withColumns({"l_label": F.col("edit.l"), "r_label": F.col("edit.r")}))


def next_states(states: DataFrame, edges: DataFrame) -> DataFrame:
    """The next level: sides at a node take its edges; the right side takes that of the left side's next code point."""
    right = [f"r_{x}" for x in _SIDE]
    within = states.where("l_label <> ''").select("l_child", "l_label", "l_word", "l_n", *right)
    at = states.where("l_label = ''").select(F.col("l_child").alias("node"), *right)
    left = within.unionByName(at.join(_edges(edges, "l"), "node").select("l_child", "l_label", "l_word", "l_n", *right))
    left = left.select("l_child", "l_label", "l_word", "l_n", F.left("l_label", F.lit(1)).alias("r_head"), F.col("r_child").alias("node"))
    return _settled(left.join(_edges(edges, "r"), ["node", "r_head"]))


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """word, n, other, other_n: all ordered pairs of words one inserted, deleted or replaced code point apart."""
    edges = cut_lineage(trie(vocabulary))
    states, ended = cut_lineage(first_states(edges)), None
    while True:
        pairs = states.where("ended").select("l_word", "l_n", "r_word", "r_n")
        ended = pairs if ended is None else ended.unionByName(pairs)
        alive = states.where("NOT ended")
        if alive.isEmpty():
            break
        states = cut_lineage(next_states(alive, edges))
    ended = ended.where(F.levenshtein("l_word", "r_word", 1) == 1)
    turned = ended.selectExpr("r_word AS l_word", "r_n AS l_n", "l_word AS r_word", "l_n AS r_n")
    return ended.unionByName(turned).toDF("word", "n", "other", "other_n").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of the chain of forms that starts at each word; ``forms`` has word and form, none of them null."""
    to = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        after = to.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        to = cut_lineage(to.join(after, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        if to.where("moved").isEmpty():
            return to.drop("moved")
        to = to.drop("moved")


def variants(docs: DataFrame, least_length: int = 5, least_count: int = 3, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word of ``docs``."""
    vocabulary = cut_lineage(words(docs, least_length, least_count))
    best = neighbours(vocabulary).groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word"))).alias("best"))
    is_form = -F.col("best.n") >= ratio * F.col("n")
    near = cut_lineage(best.select("word", "n_near", F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.n")).alias("form_n")))
    ends = roots(near.where("form IS NOT NULL"))
    found = vocabulary.join(near, "word", "left").join(ends, "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")
