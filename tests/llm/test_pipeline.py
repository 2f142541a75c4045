import re

import corpus_pipeline as P
from pyspark.sql import functions as F

from stockline.llm import decontaminate, language_id


def test_stages_and_their_effects(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs
    for i, (name, stage) in enumerate(P.STAGES[:-1]):
        got = stage(spark, before, sf_dir)
        assert got.columns == columns, name
        got.write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        assert 0 < after.count() <= before.count()
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()}
        before = after
    items = {r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    for r in before.collect():
        assert not any(t in r.text for t in items)
    mixed = P.STAGES[-1][1](spark, before, sf_dir).collect()
    assert len(mixed) == before.count() and all(r.taken <= 3 * r.size for r in mixed)
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in before.collect()}
    assert {r.doc_id: r.size for r in mixed} == words
    whole = P.run(spark, sf_dir).collect()
    assert sorted(map(str, whole)) == sorted(map(str, mixed))


def test_clean_documents_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = P.identified(spark, docs, sf_dir).count()
    assert kept >= 0.97 * docs.count()
    held = language_id.predict(docs, language_id.fit(docs)).where("rejected and n_symbols >= 40").count()
    assert held <= 0.01 * docs.count()
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert decontaminate.leaks(docs, bench).where("contaminated").count() < 0.1 * docs.count()


def test_nulls_repeats_ties_and_clashing_columns(spark, sf_dir):
    """Rows without id, text, lang or source, repeated rows, equal texts, a very long text, and columns with the operators' own names."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = docs.where("length(text) BETWEEN 400 AND 3000 AND lang IS NOT NULL").orderBy("doc_id").limit(40)
    some = first.collect()
    columns = docs.schema
    row = lambda r, **new: tuple({**r.asDict(), **new}[c] for c in docs.columns)
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first().text
    odd = [row(r) for r in some] + [row(some[0])] * 3 + [row(some[1], doc_id=None)] * 2 + [row(some[2], doc_id=None, lang=None, source=None)]
    odd += [row(some[3], text=None), row(some[4], text=""), row(some[5], doc_id=some[6].doc_id), row(some[7], doc_id=10**9, text=" ".join(r.text for r in some) * 20), row(some[8], doc_id=10**9 + 1, text=f"{some[9].text} {item}")]
    frame = spark.createDataFrame(odd, columns)
    for name in ("_doc", "print", "row", "spans", "doc", "label", "size", "rejected"):
        frame = frame.withColumn(name, F.lit(1))
    before = frame.repartition(3)
    for name, stage in P.STAGES[:-1]:
        after = stage(spark, before, sf_dir)
        assert after.columns == frame.columns, name
        rows = after.collect()
        assert len(rows) <= before.count() and {r.row for r in rows} == {1}
        assert stage(spark, before.where("false"), sf_dir).count() == 0, name
        if name == "minhash_near_dedup":
            assert len({r.text for r in rows}) == len(rows)  # copies, with or without id, are one row
        if name == "decontamination":
            assert not any(r.text and item in r.text for r in rows)
        before = spark.createDataFrame(rows, frame.schema)
    mixed = P.STAGES[-1][1](spark, before, sf_dir)
    assert mixed.count() == len(rows) and P.STAGES[-1][1](spark, before.where("false"), sf_dir).count() == 0
