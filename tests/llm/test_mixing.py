import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from stockline.llm import mixing as X


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    got, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > most * sizes[s]}
        if not full:
            got |= share
            break
        for s in full:
            got[s] = float(most * sizes[s])
            left -= got[s]
        free -= full
    return got


@pytest.mark.parametrize("seed,shard", [(1, 65536), (2, 300)])
def test_targets_quotas_and_limits(spark, seed, shard):
    rng = random.Random(seed)
    rows = []
    for i in range(1500):
        s = rng.choice(["a", "b", "b", "b", "b", "c", "Z", "é", None, "tiny"])
        n = rng.choice([0, 1, 5, 30, 200, 2000]) if s != "tiny" else rng.choice([0, 1])
        rows.append((i, "w\t" * n if n or i % 2 else None, s))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = X.mix(docs, shard_words=shard, block_words=8).collect()
    assert len(got) == len(rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    want = brute_targets(sizes)
    for s in want:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= max(0.02 * want[s], 12)
    assert sum(r.size for r in got) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows)
    again = X.mix(docs.repartition(7), shard_words=shard, block_words=8).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_apportion_is_sainte_lague(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for parent in range(12):
        votes = [rng.choice([0, 1, 3, 50, 1000, 20000]) * rng.random() for _ in range(rng.randint(1, 40))]
        seats = rng.choice([0, 1, 7, 100, 5000])
        won = [0] * len(votes)
        for _ in range(seats if sum(votes) else 0):
            best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
            won[best] += 1
        rows += [(parent, i, v, seats) for i, v in enumerate(votes)]
        want |= {(parent, i): w for i, w in enumerate(won)}
    parts = spark.createDataFrame(rows, "p int, c int, votes double, seats long")
    got = {(r.p, r.c): r.got for r in X.apportion(parts, ["p"], ["c"], "votes", "seats").collect()}
    assert got == want


def test_empty_null_and_repeated(spark):
    docs = spark.createDataFrame([(None, "a b", None, 1), (2, None, "x", 1), (3, "a a a", "x", 1), (3, "a a a", "x", 1)], "doc_id long, text string, source string, n int")
    got = X.mix(docs).collect()
    assert sorted(r.size for r in got) == [0, 2, 3, 3]
    assert X.mix(docs.where("false")).count() == 0
    assert {(r.target, r.taken) for r in X.mix(docs.where("doc_id = 2")).collect()} == {(0.0, 0)}


def test_rows_without_ids_are_dealt_over_shards(spark):
    docs = spark.createDataFrame([(None if i % 2 else 5, f"text {i} " + "w " * (i % 40), "s") for i in range(2000)], "doc_id long, text string, source string")
    got = X.mix(docs, shard_words=500)
    assert got.count() == 2000 and got.agg(F.sum("taken")).first()[0] == pytest.approx(got.first().target, rel=0.01)
    assert sorted(map(str, X.mix(docs.repartition(5), shard_words=500).collect())) == sorted(map(str, got.collect()))
    # were all of them in one shard, whole stretches of one order would be taken twice and the rest once
    assert got.groupBy("size").agg((F.sum("taken") / F.sum("size")).alias("share")).agg(F.min("share")).first()[0] > 0.7


def test_few_rows_come_near_their_targets(spark):
    """Sources of a few words, on their own and beside larger ones, take what their targets say."""
    for rows in ([(1, "a b c", "x"), (2, "d", "x"), (3, "e", "y"), (4, "f g h i j k", "z")], [(i, "w " * (i % 3), "abc"[i % 3]) for i in range(40)], [(1, "one", "x")]):
        got = X.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
        for name in {r.source for r in got}:
            own = [r for r in got if r.source == name]
            assert abs(sum(r.taken for r in own) - own[0].target) <= 1, (rows, got)


def test_very_long_text_and_clashing_columns(spark):
    rows = [(1, "w " * 200_000, "x", 1, 2), (2, "a b", "y", 3, 4), (None, None, None, 5, 6)]
    got = X.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, size int, name int")).collect()
    assert {r.doc_id: r.size for r in got} == {1: 200_000, 2: 2, None: 0} and all(0 <= r.taken <= 3 * r.size for r in got)
