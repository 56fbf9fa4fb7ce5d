"""FAQ cascade: question-to-question, question-to-answer, else a direct reply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_SCORE, MIN_RATIO = 0.35, 1.1


def dedupe_first(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key: the first by order; original numbers stay."""
    first = F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_b")
    return rows.groupBy(key).agg(first).select("_b.*")


def reason(top: Column, second: Column) -> Column:
    """Verdict on a leg's best two scores; the gap is a ratio."""
    return (
        F.when(top.isNull() | (top <= 0), "no_candidates")
        .when(top < MIN_SCORE, "vector_score_below_threshold")
        .when((F.coalesce(second, F.lit(0.0)) == 0) | (top / second >= MIN_RATIO), "threshold_pass")
        .otherwise("score_gap_below_threshold")
    )


def best_two(hits: DataFrame, key: str) -> DataFrame:
    """``hits(key, id, score, rank)`` -> best id, its score and the second's."""
    g = hits.where("rank <= 2").groupBy(key)
    return g.agg(F.max(F.when(F.col("rank") == 1, F.col("id"))).alias("id"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"))


def cascade(asked: DataFrame, q2q: DataFrame, q2a: DataFrame, key: str) -> DataFrame:
    """Both legs as data; the second counts only where the first misses."""
    a = best_two(q2q, key).select(key, F.col("id").alias("qid"), F.col("top").alias("q_top"), F.col("second").alias("q_second"))
    b = best_two(q2a, key).select(key, F.col("id").alias("aid"), F.col("top").alias("a_top"), F.col("second").alias("a_second"))
    j = asked.select(key).join(a, key, "left").join(b, key, "left").withColumn("q_reason", reason(F.col("q_top"), F.col("q_second")))
    first = F.col("q_reason") == "threshold_pass"
    j = j.withColumn("a_reason", F.when(first, "skipped").otherwise(reason(F.col("a_top"), F.col("a_second"))))
    second = F.col("a_reason") == "threshold_pass"
    route = F.when(first, "q2q").when(second, "q2a").otherwise("direct_llm")
    return j.select(key, route.alias("route"), F.when(first, F.col("qid")).when(second, F.col("aid")).alias("faq_id"), "q_reason", "a_reason")
