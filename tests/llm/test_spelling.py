import random
import re
import zlib
from collections import Counter

import pytest

from stockline.llm import spelling as S


def vocabulary(rows, least_length=5, least_count=3):
    total = Counter()
    for doc, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least_length:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= least_count}


def apart(a, b):
    """Exactly one edit, by trying all of them."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = vocabulary(rows)
    near = {w: [x for x in n if apart(w, x)] for w in n}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def corpus(seed, docs=60):
    rng = random.Random(seed)
    letters = "abcé×ÿ"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(40)]

    def slip(w):
        i, c = rng.randrange(len(w)), rng.choice(letters)
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :], w[:i] + c + w[i:]])

    near = {w: [x := slip(w), x, x, slip(x), slip(w)] for w in base}
    rows = []
    for i in range(docs):
        ws = [rng.choice(base[: 1 + rng.randrange(40)]) for _ in range(rng.randint(0, 80))]
        ws = [rng.choice(near[w]) if rng.random() < 0.5 else w for w in ws]
        ws = [w.upper() if rng.random() < 0.1 and "ÿ" not in w else w for w in ws]
        rows.append((i, rng.choice([" ", "-", "1 "]).join(ws)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    assert sorted((tuple(r) for r in S.variants(docs).collect()), key=lambda r: r[0]) == want
    assert any(r[1] and r[2] != r[1] for r in want)  # chains of forms


def test_runs_of_one_letter_and_ends_of_words(spark):
    group = ["aaaaa", "aaaaaa", "aaaaaaa", "aaaab", "aaaabb", "baaaa", "baaaaa", "abaaa", "caaaab", "ab" * 400, "ab" * 400 + "a", "b" + "ab" * 400]
    rows = [(i, " ".join(w for w in group for _ in range(3 + len(w) % 3))) for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in S.variants(docs).collect()), key=lambda r: r[0]) == brute(rows)


def test_nulls_empty_repeated_long_and_extra_columns(spark):
    long = "Wörter " * 300_000 + "Worter " * 4
    rows = [(None, "hello hellp hello"), (None, "hello hellp hello"), (7, None), (8, ""), (9, "hellp ... hello"), (10, long), (10, "Wörter")]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, word string, n int")
    got = sorted((tuple(r) for r in S.variants(docs).collect()), key=lambda r: r[0])
    assert got == brute(rows)
    assert S.variants(docs.limit(0)).collect() == []


def test_long_texts_are_read_in_slices(monkeypatch):
    monkeypatch.setattr(S, "SLICE", 7)
    text = "Straße, Éclair; naïve-abcdefghijklmnop " * 3
    parts = list(S._slices(text))
    assert len(parts) > 3 and "".join(parts) == text.encode().lower().decode()
    assert all(not re.search(r"[a-zÀ-ÿ]$", a) or not re.match(r"[a-zÀ-ÿ]", b) for a, b in zip(parts, parts[1:]))
