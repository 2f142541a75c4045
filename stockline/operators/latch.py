"""Rules that latch anew: from a base, the next row whose ``reach`` meets the base's ``need`` fires and becomes the base.

Where a row's reach is below the need of every later base (bills that start from zero, a line that is latched at a jump), the first row that
meets a base's need is a record of the running maximum, so each record knows the record that would fire after it: one ordered window by value.
The rows that do fire are then followed from the start by pointer doubling. Nothing is looped over or gathered; windows are by ``keys``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockline.sources.shared import cut_lineage


def fires(rows: DataFrame, keys: tuple[str, ...], start: DataFrame, strict: bool = False) -> DataFrame:
    """keys and ord of the rows that fire. rows: keys, ord, need, reach (null where a row can't fire); start: keys, need of the first base.

    ``strict``: reach must be more than the need, not only as much.
    """
    keys = list(keys)
    before = Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    points = rows.withColumn("_top", F.max("reach").over(before)).where("reach IS NOT NULL AND (_top IS NULL OR reach > _top)")
    sources = points.select(*keys, "ord", F.col("need").alias("value")).unionByName(start.select(*keys, F.lit(None).cast("long").alias("ord"), F.col("need").alias("value")))
    none, both = F.lit(None).cast("long"), [*keys, "value"]
    marked = sources.select(*both, F.col("ord").alias("a"), F.lit(int(strict)).alias("kind"), none.alias("b")).unionByName(
        points.select(*keys, F.col("reach").alias("value"), none.alias("a"), F.lit(int(not strict)).alias("kind"), F.col("ord").alias("b"))
    )
    # from the greatest value down, so that frames begin at the first row: a frame up to the last one is read anew for each row
    following = Window.partitionBy(*keys).orderBy(F.desc("value"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    after = marked.withColumn("next", F.last("b", ignorenulls=True).over(following)).where(F.col("kind") == int(strict)).where("next IS NOT NULL")
    after = cut_lineage(after.select(*keys, "a", F.col("next").alias("b")))
    reached = cut_lineage(after.where("a IS NULL").select(*keys, F.col("b").alias("ord")))
    jump = after.where("a IS NOT NULL AND b > a")
    while not jump.isEmpty():
        new = reached.join(jump.select(*keys, F.col("a").alias("ord"), "b"), [*keys, "ord"]).select(*keys, F.col("b").alias("ord"))
        reached = cut_lineage(reached.union(new).distinct())
        further = jump.select(*keys, F.col("a").alias("b"), F.col("b").alias("c"))
        jump = cut_lineage(jump.join(further, [*keys, "b"]).select(*keys, "a", F.col("c").alias("b")))
    return reached
