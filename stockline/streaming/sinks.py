"""Tables that a stream of ``live_replay`` fills, so that a batch that is written again changes nothing.

Each table is a folder partitioned by ``batch``, the number that Spark gives a micro-batch. A batch overwrites its own partition and no other
(dynamic partition overwrite): one that is repeated, or that failed half-way, leaves one copy. Which rows count is decided when a table is
read: the segment's row of the highest priority and of equal ones the latest, none that a rewind made void, and of steps those of the first
batch that completed their segment. ``compact`` writes what counts as one batch of another folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from stockline.operators.profiles import PRIORITY, SEGMENT

from .fold import PROFILE, unpacked

STEP = ("session_id", "segment", "folded_seq")


def write_batch(rows: DataFrame, batch: int, folder: str, unique: tuple[str, ...] = ()) -> None:
    """``rows`` as the batch's partition of a table; it fails before anything is written if a key of ``unique`` repeats."""
    if unique and not (twice := rows.groupBy(*unique).count().where("count > 1").limit(1)).isEmpty():
        raise ValueError(f"the batch has a key twice: {twice.first().asDict()}")
    numbered = rows.withColumn("batch", F.lit(batch).cast("long"))
    numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(folder)


def read_table(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """All batches of a table, with their number; empty before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(None).cast("long"))
    return spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(folder)


def _not_void(rows: DataFrame, rewinds: DataFrame) -> DataFrame:
    """Rows of live sessions that no later rewind made void. rewinds: session_id, last (its last rewind)."""
    return rows.join(rewinds, "session_id", "left").where(F.coalesce("rewinds", F.lit(0)) >= F.coalesce("last", F.lit(0))).drop("last")


def last_rewinds(marks: DataFrame) -> DataFrame:
    return marks.groupBy("session_id").agg(F.max("rewinds").alias("last"))


def winning_profiles(profiles: DataFrame, marks: DataFrame) -> DataFrame:
    """The profile of each segment: highest archive_priority, then the latest batch, then the latest in it; none from before the session's last rewind."""
    best = Window.partitionBy(*SEGMENT).orderBy(F.desc("archive_priority"), F.desc("batch"), F.desc("at"))
    live = _not_void(profiles.where(F.col("archive_source") == "live"), last_rewinds(marks))
    rows = live.unionByName(profiles.where(F.col("archive_source") != "live"))
    return rows.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")


def winning_steps(steps: DataFrame, marks: DataFrame) -> DataFrame:
    """Steps that count: those of the session's last rewind; of each, the latest revision."""
    latest = F.max_by(F.struct(*[c for c in steps.columns if c not in STEP]), F.struct("batch", "at"))
    rows = _not_void(steps, last_rewinds(marks)).groupBy(*STEP).agg(latest.alias("x"))
    return rows.select(*STEP, "x.*")


def complete_segments(steps: DataFrame, profiles: DataFrame, before: int) -> DataFrame:
    """Segments whose profile was written by a batch before ``before``: their steps stay as they are."""
    return profiles.where(F.col("batch") < before).select(*SEGMENT, "rewinds").distinct().join(steps.where(F.col("batch") < before).select(*SEGMENT, "rewinds").distinct(), [*SEGMENT, "rewinds"], "left_semi")


def replaced_paths(paths: DataFrame, winners: DataFrame) -> DataFrame:
    """The paths of winning profiles: those of the batch and rewind that wrote the profile, as a whole."""
    return paths.join(winners.select(*SEGMENT, "batch", "rewinds"), [*SEGMENT, "batch", "rewinds"], "left_semi")


class LiveTables:
    """The tables of a stream below one folder: ``profiles``, their ``paths``, ``steps`` and ``rewinds``. ``write`` is its foreachBatch."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType):
        self.spark, self.folder, types = spark, folder, {f.name: f for f in schema.fields}
        # the profile columns of a stream have names of their own; b_total and the keys are the stream's
        self.closed = StructType([types[c] for c in (*PROFILE, "at", "rewinds")])
        self.profile = StructType(self.closed.fields).add("archive_source", "string").add("archive_priority", "integer")
        self.step = StructType([types[c] for c in (*STEP, "call_id", "ord", "tokens", "l", "b", "g", "miss", "at", "rewinds")])
        self.path = StructType([types[c] for c in (*SEGMENT, "path", "path_tokens", "at", "rewinds")])
        self.mark = StructType([types[c] for c in ("session_id", "rewinds")])

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, f"{self.folder}/{name}", {"profiles": self.profile, "paths": self.path, "steps": self.step, "rewinds": self.mark}[name])

    def _of(self, rows: DataFrame, kind: str, fields: StructType) -> DataFrame:
        """The batch's rows of one kind; of packs, only theirs are read, and only these columns."""
        same = rows.where(F.col("kind") == kind)
        if "pack" in rows.columns:
            same = unpacked(same, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields))
        return same.select(*fields.names)

    def write(self, rows: DataFrame, batch: int) -> None:
        """The batch's rewinds, steps and closed segments, of rows of ``live_replay`` or of its packs. Steps of segments that an earlier batch completed are left out."""
        rows = rows.persist()
        steps = self._of(rows, "call", self.step).persist()
        try:
            write_batch(self._of(rows, "rewind", self.mark), batch, f"{self.folder}/rewinds")
            key, kept = [*SEGMENT, "rewinds"], steps
            # few segments get steps after their profile, so the steps of earlier batches are read for those segments alone
            late = self.table("profiles").where(F.col("batch") < batch).join(steps.select(*key).distinct(), key, "left_semi")
            if not late.isEmpty():
                done = complete_segments(self.table("steps"), late, batch)
                kept = steps.join(done, key, "left_anti").select(*self.step.names)
            write_batch(kept, batch, f"{self.folder}/steps", (*STEP, "rewinds"))
            write_batch(self._of(rows, "path", self.path), batch, f"{self.folder}/paths", (*SEGMENT, "rewinds", "path"))
            closed = self._of(rows, "closed", self.closed).select(*self.closed.names, F.lit("live").alias("archive_source"), F.lit(PRIORITY["live"]).alias("archive_priority"))
            write_batch(closed, batch, f"{self.folder}/profiles", (*SEGMENT, "rewinds"))
        finally:
            steps.unpersist()
            rows.unpersist()

    def profiles(self) -> DataFrame:
        return winning_profiles(self.table("profiles"), self.table("rewinds"))

    def paths(self) -> DataFrame:
        return replaced_paths(self.table("paths"), self.profiles())

    def steps(self) -> DataFrame:
        return winning_steps(self.table("steps"), self.table("rewinds"))

    def compact(self, folder: str, until: int) -> LiveTables:
        """What counts of the batches up to ``until`` as one batch of a new folder; readers and the stream then go on with that."""
        new = object.__new__(LiveTables)
        new.__dict__ = self.__dict__ | {"folder": folder}
        old = F.col("batch") <= until
        marks = self.table("rewinds").where(old)
        write_batch(marks.drop("batch").groupBy("session_id").agg(F.max("rewinds").alias("rewinds")), until, f"{folder}/rewinds")
        write_batch(winning_steps(self.table("steps").where(old), marks).select(*self.step.names), until, f"{folder}/steps")
        won = winning_profiles(self.table("profiles").where(old), marks)
        write_batch(replaced_paths(self.table("paths").where(old), won).select(*self.path.names), until, f"{folder}/paths")
        write_batch(won.select(*self.profile.names), until, f"{folder}/profiles")
        return new


def snapshot_profiles(profiles: DataFrame, source: str) -> DataFrame:
    """Profiles of a batch job (``segment_profiles``) as rows of the profiles table, with the priority of their source."""
    return profiles.select(*PROFILE, F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("rewinds"), F.lit(source).alias("archive_source"), F.lit(PRIORITY[source]).alias("archive_priority"))
