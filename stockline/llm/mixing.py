r"""Operator 1: mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. *Targets*: the sizes (words) of all documents are shared among the sources by weight; a source stops at ``most`` times its
   own size and the excess is shared again by weight among the others (``targets``, in closed form: with sources in
   order of cap / weight, the level is the largest of (rest of the total) / (rest of the weights)).
2. *Quotas*: the total is a number of blocks of ``block_words`` words. ``apportion`` gives blocks to sources by the highest
   quotients target / 1, 3, 5, ..., then a source's blocks to its groups of shards and a group's to its
   shards in the same way by their words, so each shard has an integer quota. A shard has about ``shard_words`` words of one source, so a source with a
   third of all rows is as many shards as it needs, and a group has at most ``GROUP`` shards.
   Of all quotients only those near the line are made: seats differ from the exact quota by less than
   1 + (number of parts) * (part's share) / 2, so a part has about three candidates.
3. *Selection*: documents are dealt to shards, and ordered within a shard, by an md5 of the seed, the doc_id and the text's md5, so rows that repeat a
   doc_id, or have none, are dealt like any others. A shard's documents are one run of words, cut in blocks. A quota of q of n
   blocks takes all of them q div n times and q mod n blocks more: a circular run of blocks from a seeded block.
   A block is one word unless asked otherwise: a run of neighbouring blocks is the same run of words, and neither a short last block nor a seat beyond
   a small shard's limit is lost, so small sources come as near their targets as large ones.
   ``taken`` is the sum over the blocks that a document lies in, so no document exceeds ``most`` times its size.

Everything is DataFrame work; texts are read once to count words and never shuffled. Sources themselves (one short row each) are ordered in one task.

Defined results: null and empty texts have size 0 and are taken 0 times; null is a source of its own, the last; documents that repeat a doc_id
are rows of their own; without any word every target is 0; an empty table gives an empty result.
Only the named columns are read, so others can't clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, n_words

GROUP = 1024
#: Up to this many sources (about 100 bytes each) are sent to the documents, more meet them in a join.
FEW_SOURCES = 50_000


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """Adds weight and target to (name, words): one row a source, sorted by name for the weights."""
    by_name = Window.orderBy("name")
    by_room = Window.orderBy(F.col("cap") / F.col("weight"), "name")
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    after = by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    return (
        sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("double"))
        .withColumn("cap", (F.lit(most) * F.col("words")).cast("double"))
        .withColumn("total", F.sum("words").over(everything).cast("double"))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
        .withColumn("target", F.least("cap", F.max("level").over(everything) * F.col("weight")))
        .select("name", "words", "weight", "target", "total")
    )


def apportion(parts: DataFrame, parent: list[str], child: list[str], votes: str, seats: str) -> DataFrame:
    """Seats of each child by highest quotients votes / 1, 3, 5, ... within each parent; ties go to the first child.

    ``seats`` is the parent's number, on each row; the result has parent, child and ``got``.
    """
    whole = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    spread = F.col("n_parts") * F.col("share") / 2 + 1
    base = (
        parts.withColumn("n_parts", F.count("*").over(whole))
        .withColumn("share", F.coalesce(F.try_divide(F.col(votes), F.sum(votes).over(whole)), F.lit(0.0)))
        .withColumn("sure", F.greatest(F.lit(0), F.floor(F.col(seats) * F.col("share") - spread)).cast("long"))
        .withColumn("most", F.ceil(F.col(seats) * F.col("share") + spread).cast("long"))
        .withColumn("open", F.col(seats) - F.sum("sure").over(whole))
    )
    tried = base.where(F.col(votes) > 0).withColumn("k", F.explode(F.sequence(F.col("sure") + 1, F.col("most"))))
    rank = F.row_number().over(whole.orderBy(F.desc(F.col(votes) / (2 * F.col("k") - 1)), *child, "k"))
    won = tried.withColumn("rank", rank).where(F.col("rank") <= F.col("open")).groupBy(*parent, *child).agg(F.count("*").alias("more"))
    return base.join(won, [*parent, *child], "left").withColumn("got", F.col("sure") + F.coalesce("more", F.lit(0))).drop("n_parts", "share", "sure", "most", "open", "more")


def _number(hashed, start: int):
    """31 bits of an md5 in hex."""
    return F.conv(F.substring(hashed, start, 7), 16, 10).cast("long")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (5, 2, 1), most: int = 3, block_words: int = 1, shard_words: int = 65536, seed: str = "1") -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken."""
    sized = cut_lineage(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), F.md5(F.coalesce(text, F.lit(""))).alias("print"))
        .withColumn("name", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("~")))
        .withColumn("dice", F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "print")))
    )
    sources = targets(sized.groupBy("name").agg(F.sum("size").alias("words")), weights, most)
    sources = sources.withColumn("blocks", F.round(F.col("total") / block_words).cast("long"))
    sources = apportion(sources, [], ["name"], "target", "blocks").select("name", F.col("words").alias("source_size"), "target", F.col("got").alias("source_blocks"))
    groups = F.greatest(F.lit(1), F.ceil(F.col("source_size") / (GROUP * shard_words)))
    sources = cut_lineage(sources.withColumn("groups", groups.cast("long")).withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / (F.col("groups") * shard_words))).cast("long")))
    placed = (
        sized.join(F.broadcast(sources) if sources.count() <= FEW_SOURCES else sources, "name")
        .withColumn("g", _number(F.col("dice"), 1) % F.col("groups")).withColumn("s", _number(F.col("dice"), 8) % F.col("shards"))
        .select("doc_id", "source", "size", "name", "dice", "source_size", "target", "source_blocks", "g", "s")
    )
    shards = placed.groupBy("name", "g", "s").agg(F.sum("size").alias("words"), F.first("source_blocks").alias("source_blocks"))
    grouped = shards.groupBy("name", "g").agg(F.sum("words").alias("words"), F.first("source_blocks").alias("source_blocks"))
    grouped = apportion(grouped, ["name"], ["g"], "words", "source_blocks").select("name", "g", F.col("got").alias("group_blocks"))
    shards = apportion(shards.join(grouped, ["name", "g"]), ["name", "g"], ["s"], "words", "group_blocks")
    n = F.ceil(F.col("words") / block_words).cast("long")
    shards = shards.select(
        "name", "g", "s", n.alias("n"), F.least(F.col("got"), most * n).alias("quota"),
        (_number(F.md5(F.concat_ws("|", F.lit(seed), "name", "g", "s")), 1) % F.greatest(n, F.lit(1))).alias("start"),
    )
    run = Window.partitionBy("name", "g", "s").orderBy("dice", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = F.when(F.col("n") > 0, F.col("quota") % F.col("n")).otherwise(0)
    rounds = F.when(F.col("n") > 0, F.floor(F.col("quota") / F.col("n"))).otherwise(0)
    overlap = lambda a, b: F.greatest(F.lit(0), F.least("until", b * block_words) - F.greatest(F.col("until") - F.col("size"), a * block_words))
    stop = F.col("start") + F.col("rest")
    return (
        placed.join(shards, ["name", "g", "s"])
        .withColumn("until", F.sum("size").over(run)).withColumn("rest", rest).withColumn("rounds", rounds)
        .withColumn("taken", F.col("rounds") * F.col("size") + overlap(F.col("start"), F.least(stop, "n")) + overlap(F.lit(0), F.greatest(F.lit(0), stop - F.col("n"))))
        .select("doc_id", "source", "size", F.col("source_size").cast("long"), F.col("target").cast("double"), F.col("taken").cast("long"))
    )


def _apportion_sql(step: str, rows: str, parent: str, child: str, votes: str, seats: str) -> str:
    """Common tables that end in ``{step}``: all columns of ``rows`` and got."""
    over = f"OVER (PARTITION BY {parent})" if parent else "OVER ()"
    keys = ", ".join(x for x in (parent, child) if x)
    order = f"{votes}/CAST(2*k-1 AS DOUBLE) DESC, {child}, k"
    return f"""
{step}a AS (SELECT *, count(*) {over} AS n_parts, coalesce({votes}/nullif(CAST(sum({votes}) {over} AS DOUBLE), 0), 0) AS share FROM {rows}),
{step}b AS (SELECT *, CAST(greatest(0, floor({seats}*share-(n_parts*share/2+1))) AS BIGINT) AS sure, CAST(ceil({seats}*share+(n_parts*share/2+1)) AS BIGINT) AS most_k FROM {step}a),
{step}c AS (SELECT *, {seats} - sum(sure) {over} AS open_seats FROM {step}b),
{step}d AS (SELECT *, unnest(range(sure+1, most_k+1)) AS k FROM {step}c WHERE {votes} > 0),
{step}e AS (SELECT *, row_number() OVER ({f"PARTITION BY {parent} " if parent else ""}ORDER BY {order}) AS rk FROM {step}d),
{step}f AS (SELECT {keys}, count(*) AS more FROM {step}e WHERE rk <= open_seats GROUP BY {keys}),
{step} AS (SELECT x.*, x.sure + coalesce(f.more, 0) AS got FROM {step}c x LEFT JOIN {step}f f ON {" AND ".join(f"x.{c.strip()} = f.{c.strip()}" for c in keys.split(","))})"""


def mix_sql(block_words: int = 1, shard_words: int = 65536, seed: str = "1") -> str:
    """The mix of ``documents`` for DuckDB, with the default weights and limit."""
    number = lambda text, start: f"CAST('0x' || substr({text}, {start}, 7) AS BIGINT)"
    return rf"""
WITH z AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0) AS BIGINT) AS size, coalesce('=' || source, '~') AS name, md5('{seed}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS dice FROM documents),
s0 AS (SELECT name, CAST(sum(size) AS BIGINT) AS words FROM z GROUP BY name),
s1 AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY name)-1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight, CAST(3*words AS DOUBLE) AS cap, CAST(sum(words) OVER () AS DOUBLE) AS total FROM s0),
s2 AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap/weight, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap/weight, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM s1),
s3 AS (SELECT name, words, least(cap, max(lvl) OVER () * weight) AS target, CAST(round(total/{block_words}) AS BIGINT) AS blocks FROM s2),
{_apportion_sql("s4", "s3", "", "name", "target", "blocks")},
s5 AS (SELECT name, words AS source_size, target, got AS source_blocks, CAST(greatest(1, ceil(words/CAST({GROUP * shard_words} AS DOUBLE))) AS BIGINT) AS groups FROM s4),
s6 AS (SELECT *, CAST(greatest(1, ceil(source_size/CAST(groups*{shard_words} AS DOUBLE))) AS BIGINT) AS shards FROM s5),
p AS (SELECT z.*, source_size, target, source_blocks, {number("dice", 1)} % groups AS g, {number("dice", 8)} % shards AS s FROM z JOIN s6 ON z.name = s6.name),
h0 AS (SELECT name, g, s, CAST(sum(size) AS BIGINT) AS words, max(source_blocks) AS source_blocks FROM p GROUP BY name, g, s),
g0 AS (SELECT name, g, CAST(sum(words) AS BIGINT) AS words, max(source_blocks) AS source_blocks FROM h0 GROUP BY name, g),
{_apportion_sql("g1", "g0", "name", "g", "words", "source_blocks")},
h1 AS (SELECT h0.*, g1.got AS group_blocks FROM h0 JOIN g1 ON h0.name = g1.name AND h0.g = g1.g),
{_apportion_sql("h2", "h1", "name, g", "s", "words", "group_blocks")},
h3 AS (SELECT name, g, s, got, CAST(ceil(words/CAST({block_words} AS DOUBLE)) AS BIGINT) AS n FROM h2),
h4 AS (SELECT name, g, s, n, least(got, 3*n) AS quota, {number(f"md5('{seed}|' || name || '|' || CAST(g AS VARCHAR) || '|' || CAST(s AS VARCHAR))", 1)} % greatest(n, 1) AS start FROM h3),
d0 AS (SELECT p.*, n, quota, start, sum(size) OVER (PARTITION BY p.name, p.g, p.s ORDER BY dice, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS until FROM p JOIN h4 ON p.name = h4.name AND p.g = h4.g AND p.s = h4.s),
d1 AS (SELECT *, CASE WHEN n > 0 THEN quota % n ELSE 0 END AS rest, CASE WHEN n > 0 THEN quota // n ELSE 0 END AS rounds FROM d0)
SELECT doc_id, source, size, source_size, target, CAST(rounds*size + greatest(0, least(until, least(start+rest, n)*{block_words}) - greatest(until-size, start*{block_words}))
  + greatest(0, least(until, greatest(0, start+rest-n)*{block_words}) - greatest(until-size, 0)) AS BIGINT) AS taken FROM d1"""
