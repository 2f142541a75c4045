import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stockline.llm import minhash as M


def brute(rows, size, percent):
    sets = {}
    for doc, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[doc] = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())
    at = {d: d for d in sets}

    def root(d):
        while at[d] != d:
            d = at[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(a), root(b)))
                at[q] = p
    return sorted((d, len(sets[d]), root(d), root(d) == d) for d in ids)


def corpus(seed, n=150):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aébcdeF") for _ in range(rng.randint(1, 4)))
    base = [[word() for _ in range(rng.randint(1, 120))] for _ in range(12)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base)) if rng.random() < 0.7 else [word() for _ in range(rng.randint(0, 60))]
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            if words:
                words[rng.randrange(len(words))] = word()
        rows.append((i * 3 + 1, rng.choice([" ", "\n", "\t "]).join(words)))
    rows[5], rows[6], rows[7] = (rows[5][0], None), (rows[6][0], ""), (rows[7][0], " \n")
    return rows


@pytest.mark.parametrize("seed,size,percent", [(1, 3, 85), (2, 5, 80)])
def test_matches_brute_force(spark, seed, size, percent):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in M.near_duplicates(docs, shingle=size, percent=percent).collect())
    assert got == brute(rows, size, percent)


def test_group_of_edited_copies_gives_few_pairs(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(300):
        words = list(base)
        for _ in range(rng.randrange(10)):
            words[rng.randrange(150)] = rng.choice(base) + rng.choice("xy")
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    keep = M._candidates
    try:
        M._candidates = lambda *a: seen.append(keep(*a).count()) or keep(*a)
        got = sorted(tuple(r) for r in M.near_duplicates(docs, shingle=3, percent=85).collect())
    finally:
        M._candidates = keep
    assert got == brute(rows, 3, 85)
    assert seen[0] < 5000  # of 44,850


def test_members_unlike_their_centre_meet_seldom(spark):
    """Members that lack different shingles of their centre don't meet in what all of them have; similar ones do."""
    rng = np.random.default_rng(3)
    centre = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
    new = lambda k: rng.integers(0, 1 << 63, k, dtype=np.uint64)
    members = [np.sort(np.concatenate((rng.permutation(centre)[38:], new(28)))) for _ in range(100)]
    members += [np.sort(np.concatenate((rng.permutation(m)[10:], new(6)))) for m in members[:10]]
    raw = pa.array([x.tobytes() for x in members])
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 110), pa.array(range(1, 111)), pa.array([centre.tobytes()] * 110), raw], ["a", "b", "sa", "sb"])
    compared = next(M._compared(85)([batch]))
    assert not any(compared.column(compared.schema.get_field_index("similar")).to_pylist())
    starred = spark.createDataFrame(pa.Table.from_batches([compared]))
    got = {tuple(r) for r in M._candidates(starred, spark.createDataFrame([], "doc long, label long"), 85).collect()}
    sets = [set(x.tolist()) for x in members]
    similar = {(i + 1, j + 1) for i in range(110) for j in range(i + 1, 110) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}
    assert len(similar) >= 10 and similar <= got
    assert len(got) < 2000  # of 5,995


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    common, x, y = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (800, 100, 100))
    a, b = M.sketch(np.concatenate((common, x))), M.sketch(np.concatenate((y, common)))
    assert abs((a == b).mean() - 0.8) < 0.12
    one = M.sketch(x[:1])  # every coordinate is filled
    assert len(one) == M.SIZE and (one != M._FULL).all()


def test_long_text_in_pieces(monkeypatch):
    from stockline.llm import arrowtext as A

    text = ("word Thé " * 4000 + "end").encode()
    data, offsets = np.frombuffer(text + b"x yy", np.uint8), np.array([0, len(text), len(text) + 4])
    whole = [h for _, h in A.word_hashes(data, offsets)]
    monkeypatch.setattr(A.word_pieces, "__defaults__", (997,))
    cut = list(A.word_hashes(data, offsets))
    assert len(cut[0][1]) == 8001 and (np.concatenate(whole) == np.concatenate([h for _, h in cut])).all()


def test_empty_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a b c", 1), (4, "A B C", 2), (4, "A B C", 2)], "doc_id long, text string, n long")
    got = sorted((tuple(r) for r in M.near_duplicates(docs).collect()), key=str)
    assert got == [(4, 1, 4, True), (4, 1, 4, True), (None, 1, 4, False)]
    assert M.near_duplicates(docs.where("false")).count() == 0


def test_rows_without_or_with_repeated_ids(spark):
    """Rows are compared by their own texts: numbered by hand they give the same components."""
    rng = random.Random(4)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(rng.randint(60, 90))] for _ in range(150)]
    texts = []
    for _ in range(500):
        words = list(rng.choice(base))
        if rng.random() < 0.5:
            words[rng.randrange(len(words))] = "edited"
        texts.append(" ".join(words))
    texts = list(dict.fromkeys(texts))
    ids = [None if i % 2 else i % 30 for i in range(len(texts))]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    numbered = brute(list(enumerate(texts)), 3, 85)
    groups = {}
    for i, _, root, _ in numbered:
        groups.setdefault(root, []).append(i)
    least = {root: min((ids[i] for i in members if ids[i] is not None), default=None) for root, members in groups.items()}
    want = sorted(((ids[i], n, least[root], ids[i] == least[root]) for i, n, root, _ in numbered), key=str)
    assert sorted((tuple(r) for r in M.near_duplicates(docs, shingle=3, percent=85).collect()), key=str) == want
    repeated = docs.union(docs).withColumn("_doc", F.lit(1))
    kept = M.distinct(repeated, shingle=3, percent=85).collect()
    assert kept[0].asDict().keys() == {"doc_id", "text", "_doc"}
    of = {t: root for (_, _, root, _), t in zip(numbered, texts, strict=True)}
    assert sorted(of[r.text] for r in kept) == sorted(groups)
    for r in kept:
        assert r.doc_id == least[of[r.text]]


def test_every_link_of_the_documents(spark, sf_dir):
    """All pairs by an inverted index of shingles, against the components found: recall and precision are 1."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in M.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=3, percent=85).collect())
    assert got == brute(rows, 3, 85)
