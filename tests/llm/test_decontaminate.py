import random
import re

import numpy as np
import pytest

from stockline.llm import decontaminate as D

ITEMS = [
    (1, "A train leaves Boston at 45 km per hour and another leaves with 60 km per hour; when do the trains meet if Boston is 300 km away?"),
    (2, "the quick brown fox jumps over the lazy dog near the old river bank today"),
    (3, "how many legs has a spider"),
    (4, None),
]
LEAKS = {
    10: ("intro words. A train leaves Boston at 45 km per hour and another leaves with 60 km per hour; when do the trains meet if Boston is 300 km away? more", [(1, True)]),
    11: ("x A train leaves Paris at 50 km per hour and another leaves with 70 miles per hour; when do the trains meet if Paris is 900 km away?", []),
    12: ("x A train leaves Paris at 50 km per hour and another leaves with 70 km per hour; when do the trains meet if Paris is 900 km away?", [(1, False)]),
    13: ("THE QUICK brown fox, jumps over the lazy dog near the old river bank today!", [(2, True)]),
    14: ("well, how many legs has a spider then", [(3, True)]),
    15: ("the quick brown fox jumps somewhere else and the lazy dog near the river", []),
    16: (None, []),
    17: ("", []),
    18: ("45 60 300 12 7 9 8 1 2 3 4 5 6 7 8 9 10", []),
}


@pytest.mark.parametrize("block_words", [1_000_000, 12])
def test_exact_and_reparameterised(spark, block_words):
    docs = spark.createDataFrame([(k, v[0], 1) for k, v in LEAKS.items()] + [(10, LEAKS[10][0], 1), (None, LEAKS[13][0], 1)], "doc_id long, text string, leaks int")
    bench = spark.createDataFrame(ITEMS + ITEMS[1:2], "item_id long, text string")
    got = D.leaks(docs, bench, block_words=block_words).collect()
    assert len(got) == len(LEAKS) + 2
    for r in got:
        want = LEAKS[r.doc_id if r.doc_id is not None else 13][1]
        # one item value for two text values (km: km and miles) is inconsistent
        assert [(x.item_id, x.exact) for x in r.leaks] == want, r
    assert {r.doc_id for r in D.without_leaks(docs, bench, block_words=block_words).collect()} == {k for k, v in LEAKS.items() if not v[1]}
    assert D.leaks(docs, bench.where("false")).where("contaminated").count() == 0
    assert D.leaks(docs.where("false"), bench).count() == 0


def test_finds_every_planted_passage_and_no_other(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    items = {r.item_id: r.text for r in bench.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items.items() if t in r.text}
    got = {(r.doc_id, x.item_id) for r in D.leaks(docs, bench).collect() for x in r.leaks}
    assert want <= got and want
    for d, i in got - want:  # not verbatim: most of the item's 5-word shingles are there
        text = docs.where(f"doc_id = {d}").first().text.lower().split()
        item = items[i].lower().split()
        grams = {tuple(text[k : k + 5]) for k in range(len(text))}
        assert np.mean([tuple(item[k : k + 5]) in grams for k in range(len(item) - 4)]) > 0.3


def test_long_text_in_pieces(monkeypatch):
    monkeypatch.setattr(D, "CHUNK_BYTES", 700)
    monkeypatch.setattr(D.runs, "__defaults__", (700,))
    rng = random.Random(2)
    filler = lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit"]) + str(rng.randint(1, 9)) + "x" for _ in range(n))
    probe = D.Probe([x for x in ITEMS if x[1]], 8, 0.4)
    for n in range(40, 260, 7):
        text = (filler(n) + " " + ITEMS[1][1] + " " + filler(300)).encode()
        data = np.frombuffer(b"short " + text, np.uint8)
        found = D._leaks(probe)(data, np.array([0, 6, len(data)]))
        assert [x[0] for x in found[1]] == [2] and not found[0]


@pytest.mark.parametrize("block_words", [1_000_000, 12])
def test_items_of_placeholders_and_short_items_are_met_by_value(spark, block_words):
    items = [(1, "2, 4, 8, 16, 32, what comes next?"), (2, "3 + 4 = 7"), (3, "Alice Met Bob Jones In Old Paris Near Big Ben On Monday Morning"), (4, "17 * 3"), (5, "1 1 2 3 5 8 13 21 34 55 89 144")]
    texts = {10: ("so: 2, 4, 8, 16, 32, what comes next? tell", [1]), 11: ("2, 4, 8, 16, 33, what comes next?", []), 12: ("it says 3 + 4 = 7.", [2]), 13: ("3 + 5 = 8", []), 14: ("we know Alice Met Bob Jones In Old Paris Near Big Ben On Monday Morning", [3]), 15: ("17 * 3", [4]), 16: ("17 * 4", []), 17: ("x 1 1 2 3 5 8 13 21 34 55 89 144 y", [5]), 18: ("We saw Carol Meet Dan Smith At New Rome By Big Tom On Friday Evening", [])}
    docs = spark.createDataFrame([(k, v[0]) for k, v in texts.items()], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: [x.item_id for x in r.leaks if x.exact] for r in D.leaks(docs, bench, block_words=block_words).collect()}
    assert got == {k: v[1] for k, v in texts.items()}
    assert {r.doc_id for r in D.without_leaks(docs, bench, block_words=block_words).collect()} == {11, 13, 16, 18}


@pytest.mark.parametrize("block_words", [1_000_000, 12])
def test_number_words_names_of_several_words_and_texts_without_spaces(spark, block_words):
    items = [
        (1, "If Alice buys twelve apples for 3 dollars and gives five of them to Bob, how many apples does she have left over today?"),
        (2, "小明有五个苹果，吃了两个，又买了十个，还剩几个苹果？"),
        (3, "...!"),
    ]
    texts = {
        10: ("q: If Mary Ann buys eleven apples for 7 dollars and gives two hundred of them to Van Der Berg, how many apples does she have left over today? yes", [(1, False)]),
        11: ("q: If Alice buys twelve apples for 3 dollars and gives five of them to Bob, how many apples does she have left over today?", [(1, True)]),
        12: ("题目如下：小明有五个苹果，吃了两个，又买了十个，还剩几个苹果？请回答。", [(2, True)]),
        13: ("题目：小明有二十个苹果，吃了三个，又买了十五个，还剩几个苹果？", [(2, False)]),
        14: ("小红去了学校，她很喜欢画画，也喜欢唱歌和跳舞。", []),
        15: ("If we buy apples for the school then gives them to somebody, how many apples are there?", []),
        16: (None, []),
    }
    docs = spark.createDataFrame([(k, v[0], 1, 2) for k, v in texts.items()], "doc_id long, text string, contaminated int, print int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for r in D.leaks(docs, bench, block_words=block_words).collect():
        assert [(x.item_id, x.exact) for x in r.leaks] == texts[r.doc_id][1], r
    kept = D.without_leaks(docs, bench, block_words=block_words)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {14, 15, 16}
    assert [r.item_id for r in D.unmatchable(bench).collect()] == [3]


def test_reparameterised_items_by_brute_force(spark):
    """Templates by regular expressions and Python sets: an item is leaked where enough of its windows are in the text with one value for each."""
    rng = random.Random(6)
    vocabulary = [f"word{c}" for c in "abcdefghijklmnop"]
    items = []
    for i in range(12):
        words = [rng.choice(vocabulary) if rng.random() < 0.75 else str(10 * i + k) for k in range(rng.randint(8, 24))]
        items.append((i, " ".join(words)))
    number = re.compile(r"\d+$")

    def grams(words):
        out = {}
        for k in range(len(words) - 7):
            window = words[k : k + 8]
            if sum(not number.match(w) for w in window) >= 4:
                out.setdefault(tuple("#" if number.match(w) else w for w in window), []).append((k, [w for w in window if number.match(w)]))
        return out

    docs, want = [], {}
    for d in range(60):
        pad = [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))]
        parts = list(pad)
        if d % 2:
            i, text = rng.choice(items)
            values = {}
            for w in text.split():
                parts.append(values.setdefault(w, str(rng.randint(1000, 9999))) if number.match(w) else w)
            parts += pad[::-1]
        docs.append((d, " ".join(parts)))
        have = grams(parts)
        for i, text in items:
            own = grams(text.split())
            total = sum(map(len, own.values()))
            lines = {}
            for g, places in own.items():
                for k, values in places:
                    for at, other in have.get(g, ()):
                        lines.setdefault(at - k, []).append((k, list(zip(values, other, strict=True))))
            for found in [*lines.values(), [x for group in lines.values() for x in group]]:
                stands, fits = {}, True
                for _, pairs in found:
                    for x, y in pairs:
                        fits &= stands.setdefault(x, y) == y
                if fits and total and len({k for k, _ in found}) >= 0.4 * total:
                    want.setdefault(d, set()).add(i)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: {x.item_id for x in r.leaks} for r in D.leaks(frame, spark.createDataFrame(items, "item_id long, text string")).collect() if r.leaks}
    assert got == want and len(want) >= 25


@pytest.mark.parametrize("block_words", [1_000_000, 1])
def test_one_word_items_are_reported_and_any_columns_may_be_there(spark, block_words):
    bench = spark.createDataFrame([(1, "yes"), (2, "No!"), (3, "seven"), (4, "three red apples fell"), (5, None), (6, "图")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "yes, it is so", "a", 1), (2, "seven and no more", "b", 2), (3, "then three red apples fell down", "c", 3), (4, None, "d", 4)], "doc_id long, text string, _found string, print int")
    assert sorted(r.item_id for r in D.unmatchable(bench).collect()) == [1, 2, 3, 5, 6]
    kept = D.without_leaks(docs, bench, block_words=block_words)
    assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == [(1, "yes, it is so", "a", 1), (2, "seven and no more", "b", 2), (4, None, "d", 4)]
    assert {r.doc_id for r in D.leaks(docs, bench, block_words=block_words).where("contaminated").collect()} == {3}
