"""Numbers within a key, without one task per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import checkpoint


def numbered(rows: DataFrame, key: str, by: str, name: str) -> DataFrame:
    """``rows`` with their place within ``key`` by ``by``, from 0.

    Rows are sorted by range, so a key that half the table bears lies over many
    tasks; each task numbers what it has, and prefix sums over the tasks (one row per
    task and key) give where its numbers begin.  Rows that tie are numbered as they
    come."""
    part = checkpoint(rows.repartitionByRange(key, by).withColumn("_part", F.spark_partition_id()))
    own = Window.partitionBy(key, "_part")
    before = Window.partitionBy("_key").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = part.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    begins = sizes.withColumn("_begin", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = part.withColumn("_at", F.row_number().over(own.orderBy(by)) - 1)
    joined = local.join(begins, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn(name, (F.col("_begin") + F.col("_at")).cast("long")).drop("_part", "_p", "_key", "_begin", "_at")
