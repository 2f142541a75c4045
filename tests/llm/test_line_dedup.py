import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockline.llm import line_dedup as L

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows, least=10, among=None):
    n = Counter(k for _, t in (rows if among is None else among) for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if n[key(x)] < least]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=80):
    rng = random.Random(seed)
    common = [f"Shared Line {i}" for i in range(30)]
    rows = []
    for i in range(n):
        lines = [rng.choice([rng.choice(common[: 1 + rng.randrange(30)]), f"own {rng.random()}", "", " \t", " ", "É"]) for _ in range(rng.randrange(12))]
        lines = [rng.choice(["", " ", "\r"]) + (x.upper() if rng.random() < 0.3 else x) + rng.choice(["", "\x0b \t"]) for x in lines]
        rows.append((i, "\n".join(lines)))
    return rows


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed,shard,group", [(1, 1 << 18, 1 << 18), (2, 16, 5)])
def test_digest_equals_brute_force(spark, monkeypatch, seed, shard, group):
    monkeypatch.setattr(L, "SHARD", shard)
    monkeypatch.setattr(L, "GROUP", group)
    rows = corpus(seed)
    assert collected(L.digest(docs_of(spark, rows))) == brute(rows)


def test_many_shards_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(L, "SHARD", 16)
    monkeypatch.setattr(L, "SMALL", 0)
    rows = corpus(3)
    assert collected(L.digest(docs_of(spark, rows))) == brute(rows)


def test_documents_come_and_go(spark, monkeypatch):
    monkeypatch.setattr(L, "SHARD", 64)
    rows, more = corpus(4), [(i + 1000, t) for i, t in corpus(5, 60)]
    first = L.insert(L.empty(), docs_of(spark, rows))
    both = L.insert(first, docs_of(spark, more))
    back = L.delete(both, docs_of(spark, more))
    none = L.delete(back, docs_of(spark, rows))
    assert both.shards > 1
    for state, among in ((first, rows), (both, rows + more), (back, rows)):
        kept = L.without_shared(docs_of(spark, rows), state).select("doc.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("doc.text", F.lit("")).cast("binary"), 256))
        assert collected(kept) == brute(rows, among=among)
    assert collected(back.counts) == collected(first.counts)
    assert none.counts.count() == 0


def test_defined_results_and_clashing_columns(spark):
    long = "\n".join(["again and again"] * 30_000 + [f"line {i}" for i in range(30_000)])
    rows = [(None, "a\nshared"), (None, "a\nshared"), (1, None), (2, ""), (3, "\n\n"), (4, long)] + [(i, "Shared\nown %d" % i) for i in range(5, 13)] + [(20, "shared")] * 2
    docs = spark.createDataFrame([(d, t, 1, "x", 2, 3) for d, t in rows], "doc_id long, text string, places int, keys string, row_a int, n_lines int")
    assert collected(L.digest(docs)) == brute(rows)
    kept = L.without_shared(docs, L.insert(L.empty(), docs)).select("doc.*", F.col("n_dropped"))
    assert kept.columns == [*docs.columns, "n_dropped"]
    assert [r.text for r in kept.collect() if r.doc_id == 20] == ["", ""]
    assert L.digest(docs.limit(0)).collect() == []


def test_cuckoo_filter_loses_nothing_and_gives_back():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 64, 20_000, dtype=np.uint64))
    f = L.Cuckoo.sized(len(keys))
    assert f.insert(keys) and f.holds(keys).all()
    assert (f.table != 0).sum() == len(keys)
    others = np.setdiff1d(rng.integers(0, 1 << 64, 50_000, dtype=np.uint64), keys)
    assert f.holds(others).mean() < 0.001
    f.delete(keys[:10_000])
    assert (f.table != 0).sum() == len(keys) - 10_000 and f.holds(keys[10_000:]).all() and f.holds(keys[:10_000]).mean() < 0.001
    assert int(keys[-1]) in f
    small = L.Cuckoo(4)
    assert not small.insert(keys[:17])  # 16 places
