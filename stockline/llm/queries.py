"""The registered queries of the operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import tool_calls

    linked = tool_calls.link(*tool_calls.calls_of(table(spark, sf_dir, "conversations")))
    return linked.withColumn("mistakes", F.array_join("mistakes", ","))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html_text

    return html_text.main_text(table(spark, sf_dir, "pages"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_counts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    edited = token_counts.apply_edits(token_counts.count_tokens(token_counts.redactions(docs)))
    return edited.selectExpr("row.doc_id AS doc_id", "was AS n_tokens", "state.n_tokens AS n_tokens_edited", "n_edits", "n_encoded", "size(state.lengths) AS n_leaves")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix_dedup

    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.selectExpr("doc_id", "contaminated", "transform(leaks, x -> x.item_id) AS item_ids", "exists(leaks, x -> NOT x.exact) AS reparameterised")


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import licences

    found = licences.licence_scan(table(spark, sf_dir, "documents"))
    return found.selectExpr("doc_id", "n_candidates", "size(notices) AS n_confirmed", "transform(notices, x -> x.licence) AS licences", "aggregate(notices, 0L, (a, x) -> a + x.n_different) AS n_different")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language_id

    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(docs))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import minhash

    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import topk

    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import turn_repair

    conversations = table(spark, sf_dir, "conversations")
    return turn_repair.digest(conversations, turn_repair.damaged(conversations))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import line_dedup

    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import spelling

    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_mixing, op2_licences, op3_language_id, op4_minhash, op5_tool_calls, op6_html_text, op7_token_counts, op8_suffix_dedup, op9_topk, op10_decontaminate, op11_turn_repair, op12_line_dedup, op13_spelling)
}


def _oracles() -> dict[str, str]:
    from . import line_dedup, mixing, topk

    return {"op1_mixing": mixing.mix_sql(), "op9_topk": topk.TOP_K_SQL, "op12_line_dedup": line_dedup.DIGEST_SQL}


ORACLE_SQL: dict[str, str] = _oracles()
