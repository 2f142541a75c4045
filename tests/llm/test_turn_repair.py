import hashlib
import random
import zlib
from functools import lru_cache

import numpy as np
import pytest

from stockline.llm import turn_repair as T

WHITE = " \t\n\x0b\x0c\r"
COST = {"K": 0, "R": 1, "D": 2, "I": 5}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h == 0:
            continue
        if h == 1:
            text = ""
        if h == 2:
            text = "".join(c for c in text if c not in ".!?")
        if h == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if h == 3 else 1)
    return out


def cheapest(rows):
    """Least cost and, of its audits, the least: over (rows used, roles so far) with whole strings. rows: (initial, must go, truncated)."""

    @lru_cache(None)
    def best(i, q, inserted):
        # q: "" at the start, else the last initial
        found = []
        if i == len(rows) and q in ("", "a"):
            found.append((0, "", ()))
        following = "a" if q == "u" else "u"
        if inserted < 2:
            c, s, e = best(i, following, inserted + 1)
            found.append((c + 5, "I" + s, (following, *e)))
        if i < len(rows):
            role, goes, cut = rows[i]
            c, s, e = best(i + 1, q, 0)
            found.append((c + 2, "D" + s, ("", *e)))
            if not goes:
                if role == following or role == "s" and q == "":
                    c, s, e = best(i + 1, role, 0)
                    found.append((c + 5 * cut, "K" + s, (role, *e)))
                c, s, e = best(i + 1, following, 0)
                found.append((c + 1 + 5 * cut, "R" + s, (following, *e)))
        return min(found, default=(10**9, "", ()))

    for i in range(len(rows), 0, -1):  # no deep recursion
        for q in ("", "s", "u", "a"):
            best(i, q, 0)
    return best(0, "", 0)


def brute(rows):
    ids = {r[0] for r in rows}
    out = []
    for conv in ids:
        mine = sorted((r[1:] for r in damage(rows) if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, counts, symbols = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
        for _, role, text in mine:
            body = text.strip(WHITE)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            symbols.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(symbols, symbols[1:]))
        cost, audit, roles = cheapest(tuple(symbols))
        left, lines = list(mine), []
        for letter, role in zip(audit, roles):
            name = {"u": "user", "a": "assistant"}.get(role)
            if letter == "I":
                lines.append(f"{name}:")
                continue
            _, old, text = left.pop(0)
            if letter != "D":
                lines.append(f"{old if letter == 'K' else name}:{text}")
        out.append((conv, gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=60, most=14):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        said = [f"{rng.random()}." for _ in range(3)]
        for turn in range(rng.randrange(most)):
            role = rng.choice(["user", "assistant", "assistant", "system", "tool", "", None, "unit"]) if rng.random() < 0.4 else ("user", "assistant")[turn % 2]
            text = rng.choice([None, "", " \t", "cut off", "a.b", rng.choice(said)]) if rng.random() < 0.4 else f"{rng.random()}{rng.choice('.!?')} \n"
            rows.append((conv, None if rng.random() < 0.05 else turn * rng.choice([1, 1, 2]), role, text))
    return rows


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed,bits", [(1, 12), (2, 1), (3, 2)])
def test_equals_brute_force(spark, monkeypatch, seed, bits):
    monkeypatch.setattr(T, "CHUNK_BITS", bits)
    rows = corpus(seed)
    docs = docs_of(spark, rows)
    assert collected(T.digest(docs, T.damaged(docs))) == brute(rows)


def test_tables_are_few_and_every_symbol_string_is_cheapest():
    t = T.Tables(2)
    assert len(t.vectors) < 200
    rng = random.Random(7)
    for _ in range(300):
        codes = np.array([rng.randrange(16) for _ in range(rng.randrange(12))], np.int64)
        rows = tuple(("sua?"[c % 4], c // 4 in (1, 2), c // 4 == 3) for c in codes.tolist())
        before, added = t.function(codes)
        assert int(added[0] + t.start[before[0]]) == cheapest(rows)[0]
        assert len(t.expanded(codes, 0)) == len(codes)


def test_repaired_rows_have_the_form(spark):
    docs = docs_of(spark, corpus(4))
    rows = T.repaired(docs).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.conv_id, r.number)):
        by.setdefault(r.conv_id, []).append(r)
    import re

    assert by and all(re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in x)) for x in by.values())
    assert all((r.text == "") == (r.edit == "I") for r in rows)


def test_one_long_conversation_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(T, "CHUNK_BITS", 4)
    rng = random.Random(5)
    rows = [(1, i, rng.choice(["user", "assistant", "system"]), f"{i}{rng.choice('.,')}") for i in range(400)] + [(2, 0, "user", "x.")]
    docs = docs_of(spark, rows)
    assert collected(T.digest(docs, T.damaged(docs))) == brute(rows)


def test_nulls_repeated_rows_long_texts_and_clashing_columns(spark):
    rows = [(None, None, None, None), (None, 1, "user", "a."), (None, 1, "user", "a."), (3, None, "user", "b."), (3, None, "assistant", "c." * 500_000), (4, 1, "user", "é!"), (5, 2, "x", "")]
    docs = spark.createDataFrame([(*r, 1, "m") for r in rows], "conv_id long, turn long, role string, text string, place int, mark string")
    assert collected(T.digest(docs, T.damaged(docs))) == brute(rows)
    assert T.digest(docs.limit(0), T.damaged(docs.limit(0))).collect() == []
