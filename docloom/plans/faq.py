"""Registered FAQ queries: a question is a user turn, its answer the next
assistant turn; vectors come from ``embeddings`` by number."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators import faq, vector
from docloom.plans.registry import register
from docloom.session import table

QUERIES: dict[str, tuple] = {}
query = register(QUERIES)

FAQ = """
t AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations),
faq AS (SELECT conv_id * 100 + turn AS idx, trim(text) AS question, trim(answer) AS answer FROM t WHERE role = 'user' AND next_role = 'assistant' AND trim(text) <> '' AND trim(answer) <> '')
"""


def pairs(spark, d) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, d, "conversations").withColumn("next_role", F.lead("role").over(w)).withColumn("answer", F.trim(F.lead("text").over(w)))
    t = t.where("role = 'user' and next_role = 'assistant'").select((F.col("conv_id") * 100 + F.col("turn")).alias("idx"), F.trim("text").alias("question"), "answer")
    return t.where("question <> '' and answer <> ''")


@query(f"WITH {FAQ} SELECT idx, question, answer FROM faq QUALIFY row_number() OVER (PARTITION BY question ORDER BY idx) = 1")
def faq_dedupe_first(spark, d):
    return faq.dedupe_first(pairs(spark, d), "question", ["idx"])


REASON = "CASE WHEN {t} IS NULL OR {t} <= 0 THEN 'no_candidates' WHEN {t} < 0.35 THEN 'vector_score_below_threshold' WHEN coalesce({s}, 0) = 0 OR {t} / {s} >= 1.1 THEN 'threshold_pass' ELSE 'score_gap_below_threshold' END"
LEG = """
{n} AS (SELECT q.vec_id AS idx, c.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 12) DESC, c.vec_id) AS rank
  FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0 AND c.vec_id % 20 <> 0 AND c.vec_id % 2 = {m} QUALIFY rank <= 3),
{n}2 AS (SELECT idx, max(id) FILTER (rank = 1) AS id, max(score) FILTER (rank = 1) AS top, max(score) FILTER (rank = 2) AS second FROM {n} GROUP BY idx)
"""


def _legs(spark, d):
    """Question vectors are the even numbers, answer vectors the odd ones; every
    twentieth vector asks and so is no entry itself."""
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id % 20 = 0")
    legs = []
    for m in (0, 1):
        hits = vector.top_k(asked, e.where(f"vec_id % 20 <> 0 and vec_id % 2 = {m}"), 3)
        legs.append(hits.select(F.col("query_id").alias("idx"), "id", F.round("score", 6).alias("score"), "rank"))
    return asked.select(F.col("vec_id").alias("idx")), *legs


@query(f"WITH {LEG.format(n='q', m=0)} SELECT idx, id, top, second, {REASON.format(t='top', s='second')} AS reason FROM q2")
def faq_confident_hit(spark, d):
    _, q, _ = _legs(spark, d)
    return faq.best_two(q, "idx").withColumn("reason", faq.reason(F.col("top"), F.col("second")))


@query(f"""WITH {LEG.format(n='q', m=0)}, {LEG.format(n='a', m=1)}, r AS (SELECT e.vec_id AS idx, q2.id AS qid, a2.id AS aid, {REASON.format(t='q2.top', s='q2.second')} AS q_reason, {REASON.format(t='a2.top', s='a2.second')} AS a0
FROM embeddings e LEFT JOIN q2 ON q2.idx = e.vec_id LEFT JOIN a2 ON a2.idx = e.vec_id WHERE e.vec_id % 20 = 0), s AS (SELECT *, CASE WHEN q_reason = 'threshold_pass' THEN 'skipped' ELSE a0 END AS a_reason FROM r)
SELECT idx, q_reason, a_reason, CASE WHEN q_reason = 'threshold_pass' THEN 'q2q' WHEN a_reason = 'threshold_pass' THEN 'q2a' ELSE 'direct_llm' END AS route,
CASE WHEN q_reason = 'threshold_pass' THEN qid WHEN a_reason = 'threshold_pass' THEN aid END AS faq_id FROM s""")
def faq_cascade(spark, d):
    asked, q, a = _legs(spark, d)
    return faq.cascade(asked, q, a, "idx")
