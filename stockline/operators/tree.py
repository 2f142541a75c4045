"""Conversation trees: active branch, sub-trees by root, replay order. Links are followed by pointer doubling.

Entries: session_id, ord, uuid, parent_uuid, is_sidechain. A thread of n entries takes log2(n) joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockline.sources.shared import cut_lineage

KEY = ["session_id", "uuid"]


def tree_edges(entries: DataFrame) -> DataFrame:
    """Entries that are in the tree, the last of each uuid; a parent that isn't there makes a root."""
    own = entries.where(F.col("uuid").isNotNull() & ~F.coalesce("is_sidechain", F.lit(False))).groupBy(*KEY).agg(F.max("ord").alias("ord"), F.max_by("parent_uuid", "ord").alias("parent_uuid"))
    there = own.select("session_id", F.col("uuid").alias("parent_uuid"), F.lit(True).alias("_there"))
    return own.join(there, ["session_id", "parent_uuid"], "left").select(*KEY, "ord", F.when(F.col("_there") & (F.col("parent_uuid") != F.col("uuid")), F.col("parent_uuid")).alias("parent_uuid"))


def _doubled(links: DataFrame) -> DataFrame:
    """The end of each chain of links (session_id, a, b); nodes without a link end there.

    A chain is no longer than its session, so cycles stop after log2 of the largest session's links.
    """
    links = cut_lineage(links)
    largest = links.groupBy("session_id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(largest.bit_length() + 1):
        further = links.select("session_id", F.col("a").alias("b"), F.col("b").alias("c"))
        joined = links.join(further, ["session_id", "b"], "left")
        if joined.where("c IS NOT NULL").isEmpty():
            break
        links = cut_lineage(joined.select("session_id", "a", F.coalesce("c", "b").alias("b")))
    return links


def _leaf_of(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """session_id, uuid, leaf: following last-added children from each start."""
    child = edges.where("parent_uuid IS NOT NULL").groupBy("session_id", F.col("parent_uuid").alias("a")).agg(F.max_by("uuid", "ord").alias("b"))
    end = _doubled(child)
    return starts.join(end.select("session_id", F.col("a").alias("uuid"), F.col("b").alias("leaf")), KEY, "left").select(*KEY, F.coalesce("leaf", "uuid").alias("leaf"))


def _up(edges: DataFrame, leaves: DataFrame) -> DataFrame:
    """session_id, leaf, uuid: all nodes from each leaf to its root; in each round the links are twice as long."""
    jump = cut_lineage(edges.select("session_id", F.col("uuid").alias("a"), F.col("parent_uuid").alias("b")).where("b IS NOT NULL"))
    reached = cut_lineage(leaves.select("session_id", "leaf", F.col("leaf").alias("uuid")).distinct())
    largest = jump.groupBy("session_id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(largest.bit_length() + 1):  # a cycle ends here too
        if jump.isEmpty():
            break
        new = reached.join(jump.select("session_id", F.col("a").alias("uuid"), "b"), ["session_id", "uuid"]).select("session_id", "leaf", F.col("b").alias("uuid"))
        reached = cut_lineage(reached.union(new).distinct())
        further = jump.select("session_id", F.col("a").alias("b"), F.col("b").alias("c"))
        jump = cut_lineage(jump.join(further, ["session_id", "b"]).select("session_id", "a", F.col("c").alias("b")))
    return reached


def active_path(edges: DataFrame) -> DataFrame:
    """session_id, uuid of the branch that is active: from the last-written entry down its last-added children, and up to the root."""
    latest = edges.groupBy("session_id").agg(F.max_by("uuid", "ord").alias("uuid"))
    return _up(edges, _leaf_of(edges, latest)).select(*KEY)


def roots(edges: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    return edges.where("parent_uuid IS NULL").select(*KEY, "ord", F.row_number().over(Window.partitionBy("session_id").orderBy("ord")).alias("root_ord"))


def subtree_paths(edges: DataFrame) -> DataFrame:
    """session_id, root, root_ord, uuid: for each root the branch to its deepest last-added leaf."""
    leaves = _leaf_of(edges, roots(edges).select(*KEY)).join(roots(edges).select(*KEY, "root_ord"), KEY)
    up = _up(edges, leaves)
    return up.join(leaves.select("session_id", "leaf", F.col("uuid").alias("root"), "root_ord"), ["session_id", "leaf"]).select("session_id", "root", "root_ord", "uuid")


def _jumps(edges: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables of the 1st, 2nd, 4th, ... ancestors (session_id, a, b), and the depth of each node (null on a cycle and below one)."""
    at = cut_lineage(edges.select("session_id", F.col("uuid").alias("a"), F.col("parent_uuid").alias("b"), F.col("parent_uuid").isNotNull().cast("long").alias("steps")))
    largest = at.groupBy("session_id").count().agg(F.max("count")).first()[0] or 0
    tables: list[DataFrame] = []
    for _ in range(largest.bit_length() + 1):
        jump = at.where("b IS NOT NULL").select("session_id", "a", "b")
        if jump.isEmpty():
            break
        tables.append(jump)
        further = at.select("session_id", F.col("a").alias("b"), F.col("b").alias("c"), F.col("steps").alias("more"))
        at = cut_lineage(at.join(further, ["session_id", "b"], "left").select("session_id", "a", F.col("c").alias("b"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")))
    return tables, at.select("session_id", "a", F.when(F.col("b").isNull(), F.col("steps")).alias("depth"))


def is_ancestor(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Adds ``is_ancestor`` to pairs (session_id, ancestor, uuid): the node is lifted by the difference of depths, a power of two at a time.

    Only the asked pairs are lifted; nodes on or below a cycle, which have no depth, are followed by their links instead.
    """
    tables, depth = _jumps(edges)
    asked = pairs.select("session_id", "ancestor", "uuid").distinct()
    level = lambda c: depth.select("session_id", F.col("a").alias(c), F.col("depth").alias(f"_{c}"))
    known = cut_lineage(asked.join(level("uuid"), ["session_id", "uuid"]).join(level("ancestor"), ["session_id", "ancestor"]))
    lifted = known.where("_uuid > _ancestor").select("session_id", "ancestor", "uuid", F.col("uuid").alias("at"), (F.col("_uuid") - F.col("_ancestor")).alias("by"))
    for k, table in enumerate(tables):
        jump = table.select("session_id", F.col("a").alias("at"), "b", F.lit(1).alias("bit"))
        rows = lifted.withColumn("bit", F.shiftright("by", k).bitwiseAND(F.lit(1)).cast("int"))
        lifted = rows.join(jump, ["session_id", "at", "bit"], "left").select("session_id", "ancestor", "uuid", F.coalesce("b", "at").alias("at"), "by")
    hit = lifted.where("at = ancestor").select("session_id", "ancestor", "uuid")
    loose = known.where("_uuid IS NULL").select("session_id", "ancestor", "uuid")
    if not loose.isEmpty():
        cyclic = edges.join(loose.select("session_id").distinct(), "session_id", "left_semi")
        up = _up(cyclic, loose.select("session_id", F.col("uuid").alias("leaf")).distinct()).where("leaf <> uuid")
        hit = hit.unionByName(up.select("session_id", F.col("uuid").alias("ancestor"), F.col("leaf").alias("uuid")).join(loose, ["session_id", "ancestor", "uuid"], "left_semi").select("session_id", "ancestor", "uuid"))
    return pairs.join(hit.withColumn("is_ancestor", F.lit(True)), ["session_id", "uuid", "ancestor"], "left").withColumn("is_ancestor", F.coalesce("is_ancestor", F.lit(False)))


def restrict_to_active(entries: DataFrame, active: DataFrame) -> DataFrame:
    """Entries on the active branch, and those without a uuid."""
    return entries.where("uuid IS NULL").unionByName(entries.where("uuid IS NOT NULL").join(active.select(*KEY).distinct(), KEY, "left_semi").select(*entries.columns))


def replay_plan(entries: DataFrame) -> DataFrame:
    """Entries in replay order with root_ord: the branch of each root if a session has several, otherwise the active branch;
    a session without a tree is replayed whole."""
    edges = cut_lineage(tree_edges(entries))
    many = roots(edges).groupBy("session_id").agg(F.count("*").alias("n")).where("n > 1").select("session_id")
    by_root = subtree_paths(edges.join(many, "session_id", "left_semi")).groupBy(*KEY).agg(F.min("root_ord").alias("root_ord"))
    one = active_path(edges.join(many, "session_id", "left_anti")).withColumn("root_ord", F.lit(1))
    kept = entries.join(by_root.unionByName(one), KEY).select(*entries.columns, "root_ord")
    free = entries.join(edges.select("session_id").distinct(), "session_id", "left_anti").withColumn("root_ord", F.lit(1)).select(*entries.columns, "root_ord")
    return kept.unionByName(free)
