"""Rank fusion, dedupe and evidence selection over ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def rrf(lists: DataFrame, key: str, k: int = RRF_K) -> DataFrame:
    """``lists(key, id, source, list_no, rank, score)`` -> ``(key, id, score,
    sources)``: sum of 1/(k+rank); sources named in list order."""
    part = F.concat(F.col("source"), F.lit(":"), F.format_string("%.4f", F.col("score")))
    return lists.groupBy(key, "id").agg(
        F.sum(1 / (F.lit(float(k)) + F.col("rank"))).alias("score"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("list_no", part.alias("p")))), lambda s: s["p"]), ";").alias("sources"),
    )


def keep_best(rows: DataFrame, key: str, score: str, seq: str) -> DataFrame:
    """One row per key: the best score, the first seen on ties; ``first_seq``
    is where the key was first seen.  An aggregation, so a hot key is merged on
    the map side."""
    best = F.min_by(F.struct(*rows.columns), F.struct(-F.col(score), F.col(seq))).alias("_b")
    return rows.groupBy(key).agg(best, F.min(seq).alias("first_seq")).select("_b.*", "first_seq")


def valid_ids(chosen: DataFrame, known: DataFrame, key: str, limit: int) -> DataFrame:
    """``chosen(key, ids array)`` -> existing ids, first seen, at most limit."""
    rows = chosen.select(key, F.posexplode("ids").alias("pos", "id")).groupBy(key, "id").agg(F.min("pos").alias("pos"))
    rows = rows.join(known.select("id").distinct(), "id", "left_semi")
    w = Window.partitionBy(key).orderBy("pos")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def fill(candidates: DataFrame, key: str, at_least: int, most: int) -> DataFrame:
    """``candidates(key, id, manual, rank, chosen)``: chosen ones, then others of
    manuals already chosen (of any, if none is), up to min(at_least, n, most)."""
    w = Window.partitionBy(key)
    c = candidates.withColumn("_any", F.max(F.col("chosen").cast("int")).over(w)).withColumn("_same", F.max(F.col("chosen").cast("int")).over(Window.partitionBy(key, "manual")))
    c = c.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_have", F.sum(F.col("chosen").cast("int")).over(w))
    c = c.where(F.col("chosen") | (F.col("_same") == 1) | (F.col("_any") == 0))
    c = c.withColumn("_rn", F.row_number().over(w.orderBy(F.desc("chosen"), F.asc("rank"))))
    need = F.greatest(F.col("_have"), F.least(F.lit(at_least), F.col("_n"), F.lit(most)))
    return c.where(F.col("_rn") <= need).drop("_any", "_same", "_n", "_have", "_rn")
