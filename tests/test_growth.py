"""Work that must not grow faster than the tables."""

import numpy as np
from pyspark.sql import functions as F

from docloom import plans
from docloom.operators import modal, vector
from docloom.plans import graph
from docloom.plans.modal import Stub
from docloom.sources.collection import Collection


def test_graph_retrieval_compares_each_vector_once_a_kind(spark, sf, monkeypatch):
    seen, real = [], vector.top_k_of_kinds
    monkeypatch.setattr(vector, "top_k_of_kinds", lambda q, c, *a, **k: seen.append(c.count()) or real(q, c, *a, **k))
    assert plans.catalogue()["graph_retrieval"][0](spark, sf).count()
    assert len(seen) == 1 and seen[0] <= 3 * spark.read.parquet(f"{sf}/embeddings.parquet").count()


def test_rows_that_name_a_vector_are_ranked_as_if_each_had_its_own(spark):
    rng = np.random.default_rng(3)
    vecs = rng.integers(-2, 3, (40, 3)).astype(float)
    vecs[20:] = vecs[:20]  # equal scores of different vectors
    vecs[7] = 0
    # ids repeat, also between rows of different vectors
    rows = [(int(k), int(i), f"k{n}", int(r)) for n, (k, i, r) in enumerate(zip(rng.integers(0, 2, 600), rng.integers(0, 90, 600), rng.integers(0, 45, 600)))]
    asked = {100: [1.0, 0.5, 0.0], 101: [0.0, -1.0, 2.0]}
    got = vector.top_k_by_reference(
        spark.createDataFrame([(q, v) for q, v in asked.items()], "id long, embedding array<double>"),
        spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "ref long, embedding array<double>"),
        spark.createDataFrame(rows + [(0, None, "no id", 1), (1, 1, "no vector", None)], "kind int, id long, key string, ref long"),
        [7, 30],
    )
    want = set()
    for q, v in asked.items():
        for kind, k in enumerate([7, 30]):
            score = lambda r: round(float(np.dot(v, vecs[r]) / np.linalg.norm(v) / np.linalg.norm(vecs[r])), 12)
            best = sorted((-score(r), i, key) for kd, i, key, r in rows if kd == kind and r < 40 and vecs[r].any())
            want |= {(q, kind, i, key) for _, i, key in best[:k]}
    have = got.select("query_id", "kind", "id", "key").collect()
    assert {tuple(r) for r in have} == want and len(have) == len(want)


def test_parts_of_edges_grow_with_line_items(spark, sf, monkeypatch):
    monkeypatch.setattr(graph, "DEALT", 500, raising=False)
    got = graph.join_two_endpoints(spark, sf)
    held = got.groupBy(F.spark_partition_id()).count()
    assert held.count() >= 10 and held.agg(F.max("count")).first()[0] <= 1500


def test_items_are_read_once_for_all_rounds_of_requests(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)
    told = F.udf(lambda t: reads.add(1) or t, "string")
    items = spark.range(60).select(F.lit("d").alias("document_id"), F.col("id").cast("string").alias("item_id"), F.lit("table").alias("kind"), told(F.concat(F.lit("error "), F.col("id") % 5)).alias("text"), F.array(F.lit("c")).alias("captions"), F.lit(None).cast("string").alias("context"))
    replies = modal.asked(modal.prepared(items), {"table": Stub()}, Collection(spark, str(tmp_path / "r"), "request_id"))
    assert reads.value <= 120
    assert [(r.error, r.attempts) for r in replies.collect()] == [("no answer", 2)] * 5


def test_items_of_equal_requests_share_a_parsed_reply(spark):
    names = "document_id string, item_id string, kind string, text string, captions array<string>, context string"
    items = spark.createDataFrame([("d", None, "table", "x", ["c"], None), ("d", "2", "table", "x", ["c"], None), ("d", "3", "image", None, [], None)], names)
    requests = modal.prepared(items)
    reply = '{"detailed_description": "D", "entity_info": {"entity_name": "N", "summary": "S"}}'
    replies = requests.where("kind = 'table'").select("request_id", F.lit(reply).alias("reply")).distinct()
    got = sorted((str(r.item_id), r.description, r.entity_name, r.parsed) for r in modal.analysed(requests, replies).collect())
    assert [g[:2] + g[3:] for g in got] == [("2", "D", True), ("3", "image without text", False), ("None", "D", True)]
