import random

import pytest
from pyspark.sql import functions as F

from stockline.llm import token_counts as C


@pytest.fixture(scope="module")
def counter():
    with open(C.VOCABULARY, "rb") as f:
        return C.Counter(f.read())


def fresh(counter, text):
    sizes, counts = counter.leaves(counter.split.findall(text))
    return sizes, C.build(counts) if counts else [0]


def test_edits_give_what_counting_anew_gives(counter, monkeypatch):
    rng = random.Random(3)
    pieces = ["word", "it's", " ", "  ", "\n\n ", "12345", "éü", "日本語", "!!", "'ll", "a", "\t", "xyz " * 40]
    encoded = total = 0
    for leaf in (1, 3, 32):
        monkeypatch.setattr(C, "LEAF", leaf)
        for _ in range(400):
            text = "".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randrange(0, 300)))
            lengths, tree = fresh(counter, text)
            edits = []
            for _ in range(rng.randrange(1, 5)):
                a = rng.randint(0, len(text))
                edits.append((a, min(len(text), a + rng.choice([0, 0, 1, 5, 60])), "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 4)))))
            kept = C.clean_edits(edits, len(text))
            want, at = "", 0
            for b, e, t in kept:
                want += text[at:b] + t
                at = e
            want += text[at:]
            new, sizes, got, again = C.edit(counter, text, lengths, tree, edits)
            assert new == want and sum(sizes) == len(want)
            assert got[0] == len(counter.encoding.encode_ordinary(want)), (text, kept)
            assert got == C.build(C.leaf_counts(got, len(sizes))) if sizes else got == [0]
            encoded, total = encoded + again, total + len(want)
    assert encoded < total


def test_one_edit_encodes_a_small_region(counter):
    text = "some ordinary words in a row " * 4000
    lengths, tree = fresh(counter, text)
    new, _, got, again = C.edit(counter, text, lengths, tree, [(60000, 60004, "new")])
    assert again < 2000 and got[0] == len(counter.encoding.encode_ordinary(new))


def test_query_parts(spark, counter):
    rows = [(1, "mail me@example.org now", 1), (2, None, 1), (3, "", 1), (4, "call +49 30 1234567 or 0301234567", 1), (4, "plain", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, state int")
    got = C.apply_edits(C.count_tokens(C.redactions(docs))).select("row.doc_id", "row.text", F.col("state.n_tokens").alias("n"), "was", "n_edits").collect()
    assert len(got) == 5
    for r, (_, text, _) in zip(got, rows, strict=True):
        assert r.was == len(counter.encoding.encode_ordinary(text or ""))
        assert r.n == len(counter.encoding.encode_ordinary(r.text or ""))
    assert [r.n_edits for r in got] == [1, 0, 0, 2, 0]
    assert C.count_tokens(docs.where("false")).count() == 0


def test_column_named_edits_gives_way(spark, counter):
    docs = spark.createDataFrame([(1, "mail me@example.org now", "x"), (2, "plain", None)], "doc_id long, text string, edits string")
    got = C.apply_edits(C.count_tokens(C.redactions(docs))).select("row.text", "n_edits").collect()
    assert [tuple(r) for r in got] == [("mail <email> now", 1), ("plain", 0)]
    other = C.redactions(docs, edits="cuts")
    assert other.columns == ["doc_id", "text", "edits", "cuts"]
    assert [r.n_edits for r in C.apply_edits(C.count_tokens(other), edits="cuts").collect()] == [1, 0]
