import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from stockline.llm import language_id as L


def test_matches_textbook_kneser_ney():
    """The tables give the recursive definition's probabilities, which sum to 1 over the alphabet and the unseen rest."""
    texts = ["abracadabra abra", "cabra dab"]
    flat, counts = L.symbols(texts)
    keys, n = np.unique(L.grams(flat, counts), return_counts=True)
    model = L._Language(keys, n)
    seen = Counter()
    for t in texts:
        padded = "\1\1\1" + t
        seen.update(padded[i : i + 4] for i in range(len(t)))
    levels = [None, None, None, None, seen]
    for k in (3, 2, 1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def p(gram):
        if not gram:
            return 1 / (len(levels[1]) + 1)
        table = levels[len(gram)]
        one, two = sum(v == 1 for v in table.values()), sum(v == 2 for v in table.values())
        d = one / (one + 2 * two) if one else 0.1
        same = {g: c for g, c in table.items() if g[:-1] == gram[:-1]}
        if not same:
            return p(gram[1:])
        total = sum(same.values())
        return max(same.get(gram, 0) - d, 0) / total + d * len(same) / total * p(gram[1:])

    alphabet = sorted({g[-1] for g in seen})
    pack = lambda g: sum(ord(c) << 16 * i for i, c in enumerate(reversed(g)))
    for context in ("abr", "zzz", "\1\1\1", "bra"):
        got = model.probability(np.array([pack(context + c) for c in alphabet], np.uint64))
        assert all(math.isclose(a, p(context + c), rel_tol=1e-9) for a, c in zip(got, alphabet, strict=True))
        unseen = model.probability(np.array([pack(context + "q")], np.uint64))[0]
        assert math.isclose(got.sum() + unseen, 1, rel_tol=1e-9)


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = L.predict(docs, L.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    long = got[got.n_symbols >= 40]
    assert (long.lang == long.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()
    assert not long.rejected.any()


def test_nothing_is_learned_from_held_out_rows(spark):
    rows = [(i, "lorem ipsum dolor" if i % 2 else "zwölf boxkämpfer", "la" if i % 2 else "de") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    wrong = docs.withColumn("lang", L.F.when(L.held_out(L.F.col("doc_id")), "xx").otherwise(L.F.col("lang")))
    assert L.fit(wrong).languages == ["de", "la"]


def test_und_nulls_and_empty(spark):
    rows = [(1, None, "la", 1), (2, "", "la", 1), (3, "12 !?", "la", 1), (4, "lorem ipsum 𝒜", "la", 1), (4, "lorem ipsum 𝒜", "la", 1), (None, "lorem", None, 1), (6, "ipsum dolor", "la", 1), (9, "ipsum" * 1000, "la", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = L.predict(docs, L.fit(docs)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 8 and all(by[i].lang_pred == "und" and by[i].score == 0 and by[i].rejected for i in (1, 2, 3))
    assert by[4].lang_pred == "la" and by[None].held_out
    assert L.keep_identified(docs).columns == docs.columns
    empty = docs.where("false")
    assert L.predict(empty, L.fit(empty)).count() == 0
    assert {r.lang_pred for r in L.predict(docs, L.fit(empty)).collect()} == {"und"}


def test_every_gram_of_a_rare_language_counts(spark):
    """A model of more than max_grams grams is blocks, gives what one piece gives, and loses no language."""
    import random

    rng = random.Random(4)
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(30))
    rows = [(i, text("abcdefghij"), "aa") for i in range(300)] + [(1000 + i, text("klmnopqrst\u4e00\u4e01"), "zz") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole, blocks = L.fit(docs), L.fit(docs, max_grams=300)
    assert blocks.languages == whole.languages == ["aa", "zz"] and len(blocks.blocks) > 3
    want, got = ({r.doc_id: r for r in L.predict(docs, m).collect()} for m in (whole, blocks))
    for k, r in want.items():
        assert (got[k].lang_pred, got[k].rejected) == (r.lang_pred, r.rejected) == ("zz" if k >= 1000 else "aa", False)
        assert math.isclose(got[k].cross_entropy, r.cross_entropy, rel_tol=1e-5)


def test_limits_come_from_all_rows(spark):
    """More than any sample would hold: the quantile of 30,000 rows by numpy, with 60 outliers that a part of the rows would miss."""
    random = np.random.default_rng(5)
    n = 30_000
    entropy = np.round(random.normal(2.0, 0.1, n), 4)
    entropy[random.choice(n, 60, replace=False)] = np.round(random.uniform(5, 9, 60), 4)
    symbols = random.integers(1, 300, n)
    rows = spark.createDataFrame([("en", float(e), int(k)) for e, k in zip(entropy, symbols, strict=True)] + [("de", 1.0, 8)] * 19, "lang_pred string, cross_entropy double, n_symbols long")
    got = {(r.lang_pred, r.k): r.entropy for r in L._limits(rows.repartition(7)).collect()}
    length = np.log2(symbols).astype(int)
    want = {("en", k): np.quantile(entropy[abs(length - k) <= 1], 0.999) for k in range(32) if (abs(length - k) <= 1).sum() >= 20}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_fit_scores_every_training_row(spark, monkeypatch):
    rows = [(i, ("the quick brown fox and the dog " if i % 2 else "der schnelle braune fuchs und der hund ") * (1 + i % 3), "en" if i % 2 else "de") for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen, calibrate = [], L._calibrate
    monkeypatch.setattr(L, "_calibrate", lambda model, scored, slack: (seen.append(scored.count()), calibrate(model, scored, slack)))
    L.fit(docs)
    assert seen == [docs.where(~L.held_out(F.col("doc_id"))).count()] and seen[0] > 4000
