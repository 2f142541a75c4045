"""What several operators share: batches, tables and column helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockline.sources.shared import cut_lineage, shared_folder

__all__ = ["WORD", "cut_lineage", "n_words", "shared_folder", "small_batches", "table", "written"]

#: A word of the word-based operators: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Have Spark send texts to Python in batches of at most ``rows`` rows, unless the session asks for fewer.

    A batch is held by the JVM, by Arrow and by numpy at once, so its size bounds a task's memory.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, so that later steps read the columns they need and lost executors repeat nothing before it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def n_words(text: Column) -> Column:
    """Number of words; 0 for null. JVM-side."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
