r"""Operator 2: licence scans by conditional compression.

*Candidates*: a block is all words, whatever their lines, that are near enough to a cue to belong to a notice with it (the longest template's
length and its slack); overlapping blocks are one. Rows without a cue (found JVM-side) send no text to Python.

*Ranking*: the words about each cue, in order, are a window, compressed with zstandard alone and with each template as raw dictionary. The template that
saves the largest share of the window's size is tried first. The share ranks and is reported; no template is left out for it.

*Confirmation* (``differences``): the words of template and window are aligned, with the template's cue at the window's, and about their longest
common run. A template is confirmed if at most ``slack`` of its words are missing and no word that tells licences apart (``TELLING``, and any word with a
digit) is missing, added or replaced inside the aligned part. Only templates are left out that can't be confirmed, by the counts of the window's words.
Confirmed words are taken out and what is left is ranked and tried again, so a block may hold several notices.

Defined results: null, empty texts and texts without a cue have no candidate; equal notices are counted each; ties go
to the template first in the list; very long texts are scanned whole. Only the named columns are read, so others can't clash.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_right
from collections import Counter
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: The parts of BSD notices (fixed values). The head alone, without clauses, is of a BSD licence that isn't known.
BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
BSD_CLAUSES = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
BSD_NAMES = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
#: Licences that a tag may name (fixed values).
TAGS = ("MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "ISC", "0BSD", "Zlib", "Unlicense", "CC0-1.0")
#: Notices by licence (fixed values).
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-2-Clause", BSD_HEAD + BSD_CLAUSES),
    ("BSD-3-Clause", BSD_HEAD + BSD_CLAUSES + BSD_NAMES),
    ("BSD", BSD_HEAD.strip()),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MIT", "Distributed under the MIT License."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    *((name, f"SPDX-License-Identifier: {name}") for name in TAGS),
)
#: Words that tell one licence from another (fixed values).
TELLING = frozenset("mit apache bsd gnu lesser affero gpl lgpl agpl mozilla isc unencumbered creative commons cc cc0 by nc sa nd attribution noncommercial sharealike noderivatives zero not no without later or only clause domain zlib 0bsd unlicense endorse anyone".split())
#: A cue may be wrapped, with comment signs between its words.
CUE = r"(?i)licen[sc]e|permission\W+is\W+hereby|permission\W+to\W+use|permission\W+is\W+granted|redistribut|public\W+domain|spdx|creative\W+commons"
#: Share of a template's words that may be missing or added.
SLACK = 0.1
_CUE = re.compile(CUE)
_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@lru_cache(maxsize=1)
def _templates():
    found = []
    for name, text in TEMPLATES:
        dictionary = zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        found.append((name, words(text), zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_content_size=False)))
    return found, zstandard.ZstdCompressor(level=3, write_content_size=False)


def _room(template: list[str], slack: float) -> int:
    """Words by which a confirmed copy may be longer than the template."""
    return int(slack * len(template)) + 1


def _near(text: str, slack: float) -> tuple[list[tuple[str, int, int]], list[int], int]:
    """Words with their places, the index of each cue's word, and how far from it a notice's words may be."""
    found = [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(text)]
    ends = [e for _, _, e in found]
    cues = sorted({i for m in _CUE.finditer(text) if (i := bisect_right(ends, m.start())) < len(found)})
    return found, cues, max(len(t) + _room(t, slack) for _, t, _ in _templates()[0])


def blocks(text: str, slack: float = SLACK) -> list[str]:
    """Parts of a text whose words may belong to a notice with one of its cues."""
    found, cues, reach = _near(text, slack)
    runs: list[list[int]] = []
    for i in cues:
        low, high = max(i - reach, 0), min(i + reach, len(found) - 1)
        if runs and low <= runs[-1][1]:
            runs[-1][1] = high
        else:
            runs.append([low, high])
    return [text[found[low][1] : found[high + 1][1] if high + 1 < len(found) else len(text)] for low, high in runs]


def reductions(block: str) -> list[tuple[float, int]]:
    """Share of the block's compressed size that each template saves, largest first."""
    return _reductions(block, range(len(TEMPLATES)))


def _reductions(block: str, chosen) -> list[tuple[float, int]]:
    templates, plain = _templates()
    data = block.lower().encode("utf-8", "replace")
    alone = len(plain.compress(data))
    return sorted((((alone - len(templates[i][2].compress(data))) / alone, -i) for i in chosen), reverse=True)


def differences(template: list[str], block: list[str]) -> tuple[list[str], list[str], int, int]:
    """Words of the template that the block lacks, words that it has between, and the aligned part of the block."""
    match = difflib.SequenceMatcher(None, template, block, autojunk=False)
    codes = [c for c in match.get_opcodes() if c[0] == "equal"]
    if not codes:
        return template, [], 0, 0
    begin, end = codes[0][3], codes[-1][4]
    missing = [w for op, a, b, _, _ in match.get_opcodes() if op in ("delete", "replace") for w in template[a:b]]
    added = [w for op, _, _, a, b in match.get_opcodes() if op in ("insert", "replace") for w in block[max(a, begin) : min(b, end)]]
    return missing, added, begin, end


def _tells(word: str) -> bool:
    return word in TELLING or any(c.isdigit() for c in word)


def _possible(block: list[str], chosen, slack: float) -> list[int]:
    """Templates whose words are in the block often enough for a confirmation, in whatever order."""
    templates, _ = _templates()
    has, left = Counter(block), []
    for i in chosen:
        lacks = Counter(templates[i][1]) - has
        if sum(lacks.values()) <= slack * len(templates[i][1]) and not any(map(_tells, lacks)):
            left.append(i)
    return left


def _confirm(own: list[str], rest: list[str], at: int, slack: float) -> tuple[int, int, int] | None:
    """Begin, end and number of differing words of a confirmed copy with its cue at rest[at]."""
    room = _room(own, slack)
    low, high = max(at - len(own) - room, 0), at + len(own) + room
    run = difflib.SequenceMatcher(None, own, rest[low:high], autojunk=False).find_longest_match()
    starts = [low + run.b - run.a, *(at - i for i, w in enumerate(own) if w == rest[at])]
    for start in dict.fromkeys(starts):
        first = max(start - room, 0)
        missing, added, begin, end = differences(own, rest[first : max(start + len(own) + room, first)])
        if first + begin <= at < first + end and len(missing) <= slack * len(own) and len(added) <= slack * len(own) and not any(map(_tells, [*missing, *added])):
            return first + begin, first + end, len(missing) + len(added)
    return None


def identify(block: str, slack: float = SLACK) -> list[tuple[str, float, int]]:
    """Confirmed licences of a block: name, size reduction of the window about its cue, number of differing words."""
    templates, _ = _templates()
    places, cues, reach = _near(block, slack)
    places = [(*p, i) for i, p in enumerate(places)]  # the number shows where notices were taken out
    rest = [p[0] for p in places]
    chosen = _possible(rest, range(len(templates)), slack)
    is_cue = [False] * len(rest)
    for i in cues:
        is_cue[i] = True

    def denied(begin, end):
        """Whether a word beside the copy, in the same sentence, makes it another licence or none."""
        for k, x, y in ((begin - 1, begin - 1, begin), (end, end - 1, end)):
            if 0 <= k < len(rest) and rest[k] in ("not", "nc", "sa", "nd") and not re.search(r"[.!?:]\s", block[places[x][2] : places[y][1]]):
                return True
        return False

    found, at = [], 0
    while chosen and at < len(rest):
        if not is_cue[at]:
            at += 1
            continue
        low, high = max(at - reach, 0), min(at + reach + 1, len(rest))
        fit = _possible(rest[low:high], chosen, slack)
        # where notices were taken out, what is left is put together
        pieces, k = [], low
        for i in range(low + 1, high + 1) if fit else ():
            if i == high or places[i][3] != places[i - 1][3] + 1:
                pieces.append(block[places[k][1] : places[i - 1][2]])
                k = i
        best = None  # of the notices that are confirmed here, the longest is the most specific
        for share, i in _reductions(" ".join(pieces), fit) if fit else ():
            name, own, _ = templates[-i]
            if best and len(own) <= best[0]:
                continue
            copy = _confirm(own, rest, at, slack)
            if copy and not denied(*copy[:2]):
                best = (len(own), name, share, copy)
        if best:
            begin, end, n = best[3]
            found.append((best[1], best[2], n))
            del rest[begin:end], places[begin:end], is_cue[begin:end]
            at = max(begin - reach, 0)
        else:
            at += 1
    return found


def _scan(batches):
    kind = pa.list_(pa.struct([("licence", pa.string()), ("reduction", pa.float64()), ("n_different", pa.int64())]))
    for batch in batches:
        count, lists = [], []
        for text in batch.column(1).to_pylist():
            candidates = blocks(text) if text else []
            count.append(len(candidates))
            lists.append([{"licence": n, "reduction": r, "n_different": d} for b in candidates for n, r, d in identify(b)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(lists, kind)], ["doc_id", "n_candidates", "notices"])


def licence_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_candidates, notices (licence, reduction, n_different) for each row of docs."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.when(F.col(text).rlike(CUE), F.col(text)).alias("text"))
    return rows.mapInArrow(_scan, "doc_id long, n_candidates long, notices array<struct<licence:string,reduction:double,n_different:bigint>>")
