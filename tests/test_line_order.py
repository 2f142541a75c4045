"""Lines of transcripts that many tasks read keep the order of their files."""

import random

from stockline.sources import transcripts as T


def test_lines_of_many_splits_have_the_order_of_the_file(spark, tmp_path):
    rng = random.Random(1)
    want = {}
    (tmp_path / "a" / "subagents").mkdir(parents=True)
    for name, n in (("a/one.jsonl", 3000), ("a/subagents/two.jsonl", 1), ("three.jsonl", 700), ("empty.jsonl", 0)):
        lines = [rng.choice(["", "é" * rng.randrange(40), f'{{"n":{i},"x":"{"y" * rng.randrange(200)}"}}']) for i in range(n)]
        (tmp_path / name).write_bytes(b"".join(x.encode() + rng.choice([b"\n", b"\r\n"]) for x in lines) + rng.choice([b"", b'{"last":1}']))
        want |= {(name, i): x.rstrip("\r") for i, x in enumerate((tmp_path / name).read_bytes().decode().split("\n")) if x.rstrip("\r")}
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for limit in ("4096", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
            rows = T.read_lines(spark, str(tmp_path))
            got = {(r.path.split(f"{tmp_path}/")[1], r.ord): r.line for r in rows.collect()}
            assert got == want
            if limit == "4096":
                assert spark.read.text(str(tmp_path), lineSep="\n", recursiveFileLookup=True).rdd.getNumPartitions() > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
