"""Corpus preparation: five stages over ``documents``, each written as Parquet and read again by the next.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockline.llm import decontaminate, language_id, minhash, mixing, suffix_dedup
from stockline.llm.common import table
from stockline.sources.shared import shared_folder


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model doesn't reject; the model is fitted on the labelled rows of ``docs``.

    Rows without text or without a letter go. Rows that repeat, and rows with a null or repeated doc_id, are judged one by one by
    their texts; a null lang is no label; of equal scores the first language in order wins; an empty table stays empty.
    """
    return language_id.keep_identified(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8): the one of the least doc_id.

    Of rows with one doc_id, or none, the least hash of the text decides; rows that repeat doc_id and text are one row. A text without
    words is like no other. A null doc_id comes after all others. An empty table stays empty.
    """
    return minhash.distinct(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte strings that start earlier; n_chars is counted anew.

    No row goes. A null text stays null; halves of characters that a span cuts go too; rows with a null doc_id come last, rows of
    one doc_id in order of the hashes of their texts; an empty table stays empty.
    """
    return suffix_dedup.without_repeats(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, verbatim or with other values.

    Null and empty texts hold none and stay; null items and items without an id are left out; with an empty benchmark all documents stay.
    """
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target and the words that the mix takes of each document.

    Texts without words have size 0 and are taken 0 times; null is a source of its own, the last; rows that repeat are rows of their own.
    """
    return mixing.mix(docs)


STAGES = [
    ("language_id", identified),
    ("minhash_near_dedup", distinct),
    ("suffix_array_dedup", without_repeats),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
]

#: Language models, sketches and suffix sorting can't be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    folder = os.path.join(shared_folder(spark), f"pipeline-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
