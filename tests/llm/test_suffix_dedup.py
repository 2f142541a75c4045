import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from stockline.llm import suffix_dedup as S


def brute(rows):
    """rows: (doc_id, text). Digest rows by the definition."""
    out, seen = [], set()
    for doc, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - S.LENGTH + 1):
            window = raw[p : p + S.LENGTH]
            if window in seen:
                gone[p : p + S.LENGTH] = b"\1" * S.LENGTH
            seen.add(window)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["ab", "thé", "ion", "erx", "qu", "zz"]
    make = lambda k: " ".join(rng.choice(words) + rng.choice(words) for _ in range(k))
    shared = [make(rng.randint(15, 60)) for _ in range(5)]
    texts = []
    for _ in range(n):
        parts = [make(rng.randint(0, 40)) for _ in range(2)]
        if rng.random() < 0.6:
            parts.insert(1, rng.choice(shared)[rng.randint(0, 40) :])
        if rng.random() < 0.2:
            parts.append("x" * rng.randint(90, 400))
        texts.append("\n".join(parts))
    for _ in range(8):
        texts[rng.randrange(n)] = rng.choice(texts)
    texts[3], texts[4] = "", None
    return list(enumerate(texts))


@pytest.mark.parametrize("block,hot", [(4 << 20, 20_000), (3000, 20_000), (4 << 20, 3)])
def test_matches_brute_force(spark, monkeypatch, block, hot):
    rows = corpus(block + hot)
    if hot == 3:
        monkeypatch.setattr(S, "HOT_ROWS", 3)
        monkeypatch.setattr(S, "HOT_SAMPLE", 0.99)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in S.digest(docs).collect())
    assert got == brute(rows)


def test_few_rows_held(spark, monkeypatch):
    """Combining a few rows at a time, with frequent anchors and without, removes the same bytes."""
    rows = corpus(11)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    want = brute(rows)
    monkeypatch.setattr(S, "COMBINE_ROWS", 40)
    assert sorted(tuple(r) for r in S.digest(docs).collect()) == want
    monkeypatch.setattr(S, "HOT_ROWS", 3)
    monkeypatch.setattr(S, "HOT_SAMPLE", 0.99)
    assert sorted(tuple(r) for r in S.digest(docs).collect()) == want


def test_small_blocks(monkeypatch):
    """One bucket at a time gives what all at once gives."""
    import numpy as np
    import pyarrow as pa

    rows = corpus(7, 40)
    text = pa.array([t for _, t in rows])
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows]), pa.array([0] * len(rows)), text], ["doc", "print", "text"])
    found = [b for b in S._anchors(np.zeros(0, np.uint64))([batch]) if not b.column(0)[0].as_py()]
    runs = sorted(r for b in found for r in zip(*(b.column(i).to_pylist() for i in (1, 3, 5)), strict=True))
    cut = lambda d, a: (rows[d][1] or "").encode()[(a >> 14) : (a >> 14) + (a >> 7 & 127) + S.LENGTH]
    arrays = [pa.array([r[0] for r in runs]), pa.array([r[1] for r in runs]), pa.array([0] * len(runs)), pa.array([r[2] for r in runs]), pa.array([cut(r[1], r[2]) for r in runs])]
    whole = pa.RecordBatch.from_arrays(arrays, ["h", "doc", "print", "at", "part"])
    results = []
    for size in (1, 4 << 20):
        monkeypatch.setattr(S, "BLOCK_BYTES", size)
        results.append(sorted(x for b in S._bucket_sort([whole.slice(i, 7) for i in range(0, len(runs), 7)]) for x in zip(*b.to_pydict().values(), strict=True)))
    assert results[0] == results[1] and results[0]


def near_copies(n):
    """A bucket of n runs of 168 bytes: copies, every other with a byte of its own."""
    rng = random.Random(n)
    base = bytes(rng.randrange(97, 122) for _ in range(168))
    parts = [base[:k] + bytes([65 + i % 26]) + base[k + 1 :] if i % 2 else base for i, k in ((i, rng.randrange(168)) for i in range(n))]
    at = [5 << 14 | 68 << 7 | 68] * n
    return pa.RecordBatch.from_arrays([pa.array([0] * n), pa.array(range(n)), pa.array([0] * n), pa.array(at), pa.array(parts)], ["h", "doc", "print", "at", "part"])


def test_large_bucket(monkeypatch):
    """A bucket just below a frequent anchor's is sorted a few distances at a time, with the same spans."""
    batch = near_copies(4000)
    sort = lambda: sorted(x for b in S._bucket_sort([batch.slice(i, 1000) for i in range(0, 4000, 1000)]) for x in zip(*b.to_pydict().values(), strict=True))
    tracemalloc.start()
    found = sort()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    seen, want = set(), []
    for doc, part in enumerate(batch.column(4).to_pylist()):
        windows = [part[k : k + S.LENGTH] for k in range(69)]
        again = [k for k in range(69) if (k, windows[k]) in seen]
        seen.update(enumerate(windows))
        want += [(doc, 0, 5 + k, 5 + next(m for m in range(k, 69) if m + 1 not in again) + S.LENGTH) for k in again if k - 1 not in again]
    assert found == sorted(want)
    monkeypatch.setattr(S, "SORT_SUFFIXES", 1)
    assert sort() == found


def test_texts_are_let_go():
    """Cutting runs leaves none of a batch's memory behind."""
    text, runs = ["abcdefghij" * 40] * 100, [[{"h": 1, "at": 30 << 7 | 30}]] * 100

    def batches():
        for _ in range(5):
            row = pa.StructArray.from_arrays([pa.array(range(100)), pa.array(text)], ["doc_id", "text"])
            listed = pa.array(runs, pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int64())])))
            yield pa.RecordBatch.from_arrays([row, pa.array(range(100)), pa.array([0] * 100), listed], ["row", "doc", "print", "runs"])

    before = pa.total_allocated_bytes()
    assert [b.num_rows for b in S._cut_runs(1)(batches())] == [100] * 5
    assert pa.total_allocated_bytes() - before < 40_000


def test_long_text_is_cut_in_pieces(spark, monkeypatch):
    rng = random.Random(5)
    part = "".join(rng.choice("abcdefgh ") for _ in range(700_000))
    rows = [(1, part), (2, "start " + part[100_000:650_000] + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in S.digest(docs).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed >= 550_000 and got[2].n_spans == 1


def test_nulls_repeats_and_clashing_columns(spark):
    text = "some words " * 30 + "tail"
    rows = [(None, text, 1), (1, text, 2), (1, text, 2), (2, None, None), (3, "", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans long").withColumnRenamed("spans", "doc")
    got = S.digest(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == 5 and by[None][0].n_removed == len(text)
    assert by[1][0] == by[1][1] and by[1][0].n_removed < len(text)
    assert by[2][0].n_bytes == by[3][0].n_bytes == 0
    kept = S.without_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == 5
    assert {r.text for r in kept.where("doc_id = 2").collect()} == {None}
    assert S.repeated_spans(docs.where("false")).count() == 0


def place(doc, text):
    """Where a row stands: null doc_ids last, rows of one doc_id by the hash of their texts."""
    hashed = xxhash.xxh64_intdigest((text or "").encode(), seed=42) if text is not None else 0
    return doc is None, doc or 0, hashed - (1 << 64) if hashed >> 63 else hashed


def test_rows_without_or_with_repeated_ids(spark):
    """2,000 rows without a doc_id and 500 that share 50 of them, row by row as by brute force."""
    rng = random.Random(11)
    letters = lambda k: "".join(rng.choice("abcdefghijkl ") for _ in range(k))
    shared = letters(160)
    rows = [(None, (shared if i % 2 else "") + letters(130)) for i in range(2000)]
    rows += [(i % 50, letters(120) + (shared[: 100 + i % 60] if i % 3 else "")) for i in range(500)]
    rows = list(dict.fromkeys(rows))
    want = sorted(brute([(place(*r), r[1]) for r in rows]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((tuple(r)[1:] for r in S.digest(docs).collect()))
    assert got == sorted(w[1:] for w in want)
    kept = {(r.row.doc_id, r.row.text): r.spans for r in S.repeated_spans(docs).collect()}
    by_row = {(doc, text): n for (doc, text), n in zip(sorted(rows, key=lambda r: place(*r)), [w[2] for w in want], strict=True)}
    assert {k: sum(s.end - s.begin for s in v) for k, v in kept.items()} == by_row
    # a row loses bytes exactly where it holds the shared passage and isn't the first that does
    assert sum(1 for n in by_row.values() if n) == sum(1 for d, t in rows if shared[:100] in t) - 1
