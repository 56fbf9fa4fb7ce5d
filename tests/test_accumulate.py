"""Scores summed where the documents are, against the aggregations of ``lexical``."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import accumulate, lexical
from docloom.plans import agents, retrieval
from docloom.sources import term_index
from docloom.sources.term_index import TermIndex

WORDS = [f"w{k}" for k in range(60)]


def moved(spark, act):
    """Rows that all shuffles of ``act`` write."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark._jvm

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        none = spark.sparkContext._gateway.new_array(jvm.double, 0)
        stages = store.stageList(None, False, False, none, jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    out = act()
    return written() - before, out


def frames(spark, n, q, length=12):
    rng = random.Random(5)
    texts = [(i, " ".join(rng.choices(WORDS, k=rng.randint(0, 2 * length))), f"m{i % 3}") for i in range(n)]
    asked = [(i, " ".join(rng.choices(WORDS, k=length))) for i in range(q)]
    return spark.createDataFrame(texts, "doc_id long, text string, source string").repartition(4), spark.createDataFrame(asked, "item_id long, text string")


def as_aggregated(docs, queries, k, digits):
    s = lexical.scores(docs, queries).withColumn("score", F.round("score", digits))
    return {(r.item_id, r.doc_id, r.score, r["rank"]) for r in lexical.top_k(s, "item_id", k).collect()}


def got(docs, queries, k, digits):
    return {(r.item_id, r.doc_id, r.score, r["rank"]) for r in accumulate.Corpus(docs).best(queries, k, "item_id", digits=digits).collect()}


@pytest.mark.parametrize("small", [False, True])
def test_the_best_are_those_of_the_aggregations(spark, sf, monkeypatch, small):
    if small:  # many slices, passes and shards
        for name, n in {"BYTES": 1 << 12, "HELD": 100, "DOCS": 7, "CELLS": 50, "PAIRS": 300, "QUERIES": 9}.items():
            monkeypatch.setattr(accumulate, name, n)
    docs, queries = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    assert got(docs, queries, 5, 9) == as_aggregated(docs, queries, 5, 9)
    # coarse rounding makes ties, copies too; ids repeat or are null; texts are null or empty
    rows = [(i % 90 if i % 31 else None, "x y z " * (i % 3) + WORDS[i % 7]) for i in range(200)] + [(1000, None), (1001, ""), (1002, "İ x-Y…z ǅ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame([(None, "x w1 w1"), (2, "y w2 ñ"), (3, None), (4, "none"), (5, "i̇ ǆ")], "item_id long, text string")
    want = as_aggregated(docs, queries, 8, 1)
    assert len(want) > 16 and got(docs, queries, 8, 1) == want and got(docs, queries, 8, 9) == as_aggregated(docs, queries, 8, 9)
    assert got(docs.where("false"), queries, 8, 9) == set()
    nested = queries.withColumn("item_id", F.struct("item_id", F.lit(None).cast("string").alias("b")))
    assert {(q["item_id"], *rest) for q, *rest in got(docs, nested, 8, 1)} == want


def test_sums_may_pass_a_long(spark):
    docs, _ = frames(spark, 40, 1)
    queries = spark.createDataFrame([(1, "w1 w2"), (2, "w3")], "item_id long, text string")
    many = spark.createDataFrame([(1, "w1", 3_000_000), (1, "w2", 1), (2, "w3", 2)], "item_id long, term string, qf long")
    want = {(r.item_id, r.doc_id, r.score) for r in lexical.top_k(lexical.search(lexical.impacts(docs), many).withColumn("score", F.round("score", 6)), "item_id", 9).collect()}
    real = lexical.query_terms
    try:
        lexical.query_terms = lambda *a: many
        assert {(r.item_id, r.doc_id, r.score) for r in accumulate.Corpus(docs).best(queries, 9, "item_id", digits=6).collect()} == want
    finally:
        lexical.query_terms = real


def saved(docs, queries, path):
    docs.write.parquet(f"{path}/documents.parquet")
    queries.write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_reranking_moves_no_sums_of_all_documents(spark, tmp_path):
    """2,000 documents and 100 queries make 190,000 sums."""
    d = saved(*frames(spark, 2000, 100), tmp_path)
    n, rows = moved(spark, lambda: agents.rerank_candidates(spark, d).collect())
    assert len(rows) == 800 and n < 60_000


def test_tasks_that_ask_the_same_are_searched_for_once(spark, tmp_path):
    docs, queries = frames(spark, 2000, 100)
    d = saved(docs, queries, tmp_path)
    same = spark.range(300).select(F.col("id").cast("string").alias("task_id"), F.lit("w1 w2 w3 w4").alias("query"))
    n, rows = moved(spark, lambda: agents._search(spark, d)(same).collect())
    one = as_aggregated(docs, spark.createDataFrame([(0, "w1 w2 w3 w4")], "item_id long, text string"), 8, 6)
    assert {(r.id, r.score) for r in rows} == {(i, s) for _, i, s, _ in one} and len(rows) == 2400 and n < 30_000


def test_an_index_is_built_and_searched_without_moving_postings_or_sums(spark, tmp_path):
    d = saved(*frames(spark, 2000, 100), tmp_path)
    n, rows = moved(spark, lambda: retrieval.bm25_index_topk(spark, d).collect())
    assert len(rows) == 5000 and n < 60_000
    docs, queries = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "benchmark"))
    assert {(r.item_id, r.doc_id, r["rank"]) for r in rows} == {(q, i, k) for q, i, _, k in as_aggregated(docs, queries, 50, 9)}


@pytest.mark.parametrize("listed", [0, 1 << 24])
def test_changes_of_an_index_move_ids_not_words(spark, tmp_path, monkeypatch, listed):
    monkeypatch.setattr(term_index, "LISTED", listed)
    monkeypatch.setattr(accumulate, "HELD", 3000)
    docs, queries = frames(spark, 1000, 5, 60)
    index = TermIndex(spark, str(tmp_path / "i"), buckets=4)
    half = docs.where("doc_id % 2 = 0").selectExpr("doc_id", "concat(text, ' w1 w1 w1') text")

    def change():
        index.add(half)
        index.add(docs.where("doc_id % 2 = 1 or doc_id % 4 = 0"))
        index.delete(docs.where("doc_id % 5 = 0"))
        found = index.search(queries, 7).collect()
        index.merge()
        return found, index.search(queries, 7).collect()

    n, (before, after) = moved(spark, change)
    left = half.where("doc_id % 4 <> 0").unionByName(docs.where("doc_id % 2 = 1 or doc_id % 4 = 0").select("doc_id", "text")).where("doc_id % 5 <> 0")
    want = as_aggregated(left, queries, 7, 9)
    assert {(r.item_id, r.id, r.score, r["rank"]) for r in before} == want == {(r.item_id, r.id, r.score, r["rank"]) for r in after}
    assert n < 30_000  # of 67,000 postings


def test_rows_that_repeat_an_id_are_one_document(spark, tmp_path):
    for name, words in (("text", None), ("words", "words")):
        index = TermIndex(spark, str(tmp_path / name), buckets=2, id_type="string")
        rows = [("a", "x y"), ("a", "z"), ("b", None), ("c", "x x-Q"), ("c", "x x-Q")]
        docs = spark.createDataFrame(rows, "doc_id string, text string").selectExpr("*", "split(text, ' ') words").repartition(3)
        index.add(docs, words_col=words)
        one = docs.groupBy("doc_id").agg(F.min_by("text", F.xxhash64(F.coalesce("words", F.array().cast("array<string>")) if words else T.tokens(F.coalesce("text", F.lit(""))))).alias("text"))
        kept = {r.doc_id: r.text for r in one.collect()}
        assert index.size() == 3
        found = {r.id for r in index.search(spark.createDataFrame([(1, "x z"), (2, "q")], "item_id long, text string"), 9).collect()}
        assert found == {i for i, t in kept.items() if t and ({"x", "z"} & set(t.split()) or "Q" in t and not words)}
