import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockline.llm import topk as K


def brute(rows, k=5, step=3):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % step == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good if i != q and len(a) == len(b))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(set(out))


@pytest.mark.parametrize("block,pairs,longest,scale", [(2048, 4096, 1024, 1), (7, 3, 20, 1), (50, 2, 3, 1e6), (16, 1, 0, 1)])
def test_matches_brute_force(spark, monkeypatch, block, pairs, longest, scale):
    monkeypatch.setattr(K, "FEWEST", 3)
    rng = random.Random(block)
    rows = [(i, [rng.gauss(0, scale) for _ in range(20)]) for i in range(150)]
    rows += [(200 + i, rows[i][1]) for i in range(20)] + [(300, [0.0] * 20), (303, [1.0, 2.0]), (304, [2.0, 1.0])]
    rows += [(400, None), (401, []), (402, [float("nan")] * 20), (403, [float("inf")] + [0.0] * 19), (404, [None] + [0.0] * 19), (None, rows[0][1])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x")).repartition(3)
    got = sorted(tuple(r) for r in K.top_k(vectors, F.col("vec_id") % 3 == 0, block_rows=block, cell_pairs=pairs, longest=longest).collect())
    assert got == brute(rows)


def test_empty_and_repeated(spark):
    vectors = spark.createDataFrame([(0, [1.0]), (1, [1.0]), (1, [1.0]), (2, [-1.0])], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in K.top_k(vectors, F.col("vec_id") == 0).collect())
    assert got == [(0, 1, 1, 65536), (0, 2, 1, 65536), (0, 3, 2, -65536)]
    assert K.top_k(vectors.where("false"), F.lit(True)).count() == 0


def test_repeated_queries_are_one(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), *((i, [float(i), -float(i)]) for i in range(1, 9))]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in K.top_k(vectors, F.col("vec_id") == 0, block_rows=2).collect())
    assert got == [(0, r, 9 - r, 65536 * (9 - r)) for r in range(1, 6)]


def test_grid_copies_little():
    for candidates, queries, pairs in [(1, 1, 4096), (26, 1, 4096), (500_000, 10_000, 4096), (500_000, 500_000, 4096), (10, 5000, 16)]:
        rows, columns = K.grid(candidates, queries, pairs)
        assert 1 <= columns <= queries and rows >= K.FEWEST and candidates * queries <= pairs * rows * columns
    rows, columns = K.grid(500_000, 10_000, 4096)
    copied = 500_000 * columns + 10_000 * rows
    assert copied < 1.1 * min(500_000 * c + 10_000 * (500_000 * 10_000 / 4096 / c) for c in range(1, 10_000))


def test_floors_send_little(spark):
    """With the floor, pairs of blocks send about what can be among the best, not k rows for each query and block."""
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) * (5 if i % 100 == 7 else 1) for _ in range(16)]) for i in range(3000)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    sent = []
    blocks = [(np.array([i for i, _ in rows[a : a + 100]]), np.floor(256 * np.array([v for _, v in rows[a : a + 100]])).T) for a in range(0, 3000, 100)]
    long = sorted(rows, key=lambda r: -sum(x * x for x in r[1]))[:60]
    known = (np.array([i for i, _ in long]), np.floor(256 * np.array([v for _, v in long])).T)
    for floors in ([], [K._floors(*blocks[0], known, 5)]):
        sent.append(sum(len(list(K._search((*blocks[0], *floors), c, 5))) for c in blocks))
    assert sent[1] < sent[0] / 3
    got = sorted(tuple(r) for r in K.top_k(vectors, F.col("vec_id") % 50 == 0, block_rows=100).collect())
    assert got == brute(rows, step=50)
