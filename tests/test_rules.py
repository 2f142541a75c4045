"""Ignore rules by folder against each rule on each path, and words of many texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from stockline.functions import text as X
from stockline.operators import handoff


def test_rules_by_folder_equal_all_rules_on_all_paths(spark):
    rng = random.Random(1)
    names = ["src", "lib", "a-b", "node_modules", "x1", "long.name"]
    paths = ["/".join([""] * rng.randrange(2) + [rng.choice(names) for _ in range(rng.randint(1, 5))]) + rng.choice([".js", ".log", "", "/"]) for _ in range(200)] + ["", "/", "plain"]
    patterns = [r"^/src/.*\.js$", "^src/lib/", "^/a-b/", r"\.log$", "^lib/x*", "^src/*x1", "^/src/|^lib/", "(?i)^SRC/", "^src/lib/.*", "node_modules", "^/", r"^long\.name/"]
    rules = [(p, i, rng.random() < 0.3) for i, p in enumerate(rng.sample(patterns * 2, 20))]
    df = spark.createDataFrame(rules, "pattern string, priority int, negated boolean")
    got = {r.path: r.ignored for r in handoff.apply_ignore_rules(spark.createDataFrame([(p,) for p in paths] * 2, "path string"), df).collect()}
    want = {}
    for p in paths:
        hit = [(priority, not negated) for pattern, priority, negated in rules if re.search(pattern, p)]
        want[p] = max(hit)[1] if hit else False
    assert got == want and len(set(want.values())) == 2
    folders = {r.pattern: r.f for r in df.select("pattern", handoff.rule_folder(F.col("pattern")).alias("f")).collect()}
    assert folders.get("^src/lib/", "src/lib/") == "src/lib/" and folders.get("^/src/|^lib/") is None and folders.get("^src/*x1") is None and folders.get("(?i)^SRC/") is None


def test_prefixed_rules_have_no_nested_loop_and_free_rules_a_bound(spark, monkeypatch):
    paths = spark.createDataFrame([("/src/a.js",)], "path string")
    rules = spark.createDataFrame([("^/src/", 1, False), ("log", 2, False)], "pattern string, priority int, negated boolean")
    monkeypatch.setattr(handoff, "MOST_FREE_RULES", 0)
    with pytest.raises(ValueError, match="without a folder"):
        handoff.apply_ignore_rules(paths, rules)
    out = handoff.apply_ignore_rules(paths, rules.where("priority = 1"))
    assert [tuple(r) for r in out.collect()] == [("/src/a.js", True)]


def test_frequent_words_are_no_content_words(spark):
    texts = spark.createDataFrame([("implement the parser",), ("implement the lexer tables",), ("Implement nothing",), (None,)], "task string")
    assert [(r.word, r["count"]) for r in handoff.frequent_words(texts, "task", 0.5).collect()] == [("implement", 3)]
    row = texts.limit(1).select(X.handoff_token(F.lit("s"), F.lit("implement the parser tables"), F.lit(1), ("implement",)).alias("t")).first()
    assert row.t.startswith("parser-tables-")
