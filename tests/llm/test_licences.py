from stockline.llm import licences as L


def names(text):
    return [n for b in L.blocks(text) for n, _, _ in L.identify(b)]


def test_every_template_is_found_and_only_it():
    for name, text in L.TEMPLATES:
        assert names(f"Some words before.\n{text}\nand words after") == [name], text


def test_wording_decides():
    assert names("Licensed under CC BY-NC 4.0.") == ["CC-BY-NC-4.0"]
    assert names("Licensed under CC BY-NC 3.0.") == []
    assert names("This work is licensed under the GNU General Public License, version 4.") == []
    assert names("this WORK is licensed under the   GNU General Public License version 3") == ["GPL-3.0"]
    assert names("Not released under the MIT License.") == []
    assert names("he lost the fishing license") == []
    assert names("Released under the MIT License.\nLicensed under CC BY 4.0.") in (["MIT", "CC-BY-4.0"], ["CC-BY-4.0", "MIT"])
    wrapped = L.TEMPLATES[3][1].replace(", including", ",\nincluding")
    assert names(wrapped) == ["MIT"]


def test_finds_what_is_there(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: sorted({x.licence for x in r.notices}) for r in L.licence_scan(docs).collect()}
    lines = {t: n for n, t in L.TEMPLATES}
    want = {r.doc_id: sorted({lines[x] for x in (r.text or "").split("\n") if x in lines}) for r in docs.collect()}
    assert got == want and any(want.values())


def test_defined_results(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "Released under the MIT License.", 1), (3, "licence " * 30000, 1)], "doc_id long, text string, notices int")
    got = {r.doc_id: (r.n_candidates, len(r.notices)) for r in L.licence_scan(docs).collect()}
    assert got == {1: (0, 0), 2: (0, 0), None: (1, 1), 3: (1, 0)}
    assert L.licence_scan(docs.where("false")).count() == 0


def test_wrapped_templates():
    """Each template, wrapped at any usual width, as it is and as a comment."""
    import textwrap

    for name, text in L.TEMPLATES:
        for width in range(60, 81):
            lines = textwrap.wrap(text, width)
            for sign in ("", "# "):
                wrapped = "\n".join(sign + x for x in lines)
                assert names(f"{sign}Copyright someone\n{sign}\n{wrapped}\n{sign}\nimport os") == [name], (width, wrapped)


def test_notices_in_long_lines():
    """A notice in a long line, and neighbours that each are a small share of their block."""
    words = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(3000))
    for name, text in L.TEMPLATES:
        assert names(f"{words} {text} {words}") == [name], text
    assert sorted(names(" ".join(t for _, t in L.TEMPLATES))) == sorted(n for n, _ in L.TEMPLATES)


def test_neighbouring_licences_are_told_apart():
    import textwrap

    text = {n: t for n, t in L.TEMPLATES if t.startswith("Redistribution")}
    for name in ("BSD-2-Clause", "BSD-3-Clause"):
        assert names(f"Copyright (c) 2020, Some One\n\n{textwrap.fill(text[name], 72)}\n\nTHIS SOFTWARE IS PROVIDED AS IS") == [name]
    assert names(L.BSD_HEAD) == ["BSD"]
    assert names("/* SPDX-License-Identifier: MIT */") == ["MIT"] and names("# SPDX-License-Identifier: Apache-2.0") == ["Apache-2.0"]
    for tag in L.TAGS:
        assert names(f"// SPDX-License-Identifier: {tag}\nint x;") == [tag]
    assert names("SPDX-License-Identifier: Whatever-9.0") == []
    assert names("Distributed under the MIT License.") == ["MIT"]
    isc = next(t for n, t in L.TEMPLATES if n == "ISC")
    free = next(t for n, t in L.TEMPLATES if n == "0BSD")
    assert names(isc) == ["ISC"] and names(free) == ["0BSD"]


def test_ties_and_tables_of_other_columns(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License. Licensed under the MIT License.", 1, "x")] * 2, "doc_id long, text string, n_candidates int, licence string")
    assert [[x.licence for x in r.notices] for r in L.licence_scan(docs).collect()] == [["MIT", "MIT"]] * 2
    assert L.licence_scan(docs.limit(0)).collect() == []
