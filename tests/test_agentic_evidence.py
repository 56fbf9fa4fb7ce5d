"""The search of the agentic query returns whole texts."""

from pyspark.sql import functions as F

from docloom.plans import agents
from docloom.session import table


def test_agentic_search_returns_whole_texts(spark, sf):
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    queries = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("task_id"), F.col("text").alias("query"))
    hits = agents._search(spark, sf)(queries).collect()
    assert any(len(r.text) > 300 for r in hits) and all(r.text == texts[r.id] for r in hits)
