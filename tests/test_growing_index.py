"""The BM25 index on disk against a full computation, and keyed collections."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import lexical
from docloom.sources import term_index
from docloom.sources.collection import Collection
from docloom.sources.term_index import TermIndex

WORDS = ["a", "b", "c", "common", *[f"w{k}" for k in range(40)]]


def texts(seed, n):
    rng = random.Random(seed)
    return {i: " ".join(["common"] * (rng.random() < 0.9) + rng.choices(WORDS, k=rng.randint(0, 12)) + [f"w{i % 40}"] * rng.randint(0, 3)) for i in range(n)}


def frame(spark, docs):
    return spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)


def whole(spark, docs, queries, k):
    s = lexical.scores(frame(spark, docs), queries).selectExpr("item_id", "doc_id", "round(score, 9) score")
    return {(r.item_id, r.doc_id, r.score, r["rank"]) for r in lexical.top_k(s, "item_id", k).collect()}


@pytest.mark.parametrize("block", [2, 128])
def test_changes_leave_what_a_full_build_gives(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(term_index, "BLOCK", block)
    q = spark.createDataFrame([(1, "a w3 w3 common"), (2, "w7 b c"), (3, "common"), (4, None), (5, "nothing here")], "item_id long, text string")
    docs = texts(1, 120)
    index = TermIndex(spark, str(tmp_path / "i"), buckets=4)
    assert index.search(q, 5).count() == 0 and index.size() == 0 and index.delete(frame(spark, docs)) == -1
    got = lambda: {(r.item_id, r.id, r.score, r["rank"]) for r in index.search(q, 5).collect()}
    index.add(frame(spark, docs))
    assert got() == whole(spark, docs, q, 5) and len(got()) >= 10
    more = {i: t for i, t in texts(2, 140).items() if i >= 100}
    index.add(frame(spark, more))
    docs |= more
    index.delete(spark.createDataFrame([(i,) for i in (3, 7, 47, 9999, 110)], "doc_id long"))
    for i in (3, 7, 47, 110):
        del docs[i]
    assert got() == whole(spark, docs, q, 5) and index.size() == len(docs)
    if block == 2:
        index.merge()
        assert got() == whole(spark, docs, q, 5)
        index.add(frame(spark, {3: "a w3"}))
        assert {r.id for r in index.documents().collect()} == {*docs, 3}


def test_a_search_opens_the_buckets_of_its_terms_only(spark, tmp_path):
    index = TermIndex(spark, str(tmp_path / "i"), buckets=16)
    index.add(frame(spark, texts(1, 60)))
    terms = spark.createDataFrame([("w3",)], "term string")
    plan = index.blocks(terms)
    files = {f.split("bucket=")[1].split("/")[0] for f in plan.inputFiles()}
    from pyspark.sql import functions as F

    [(bucket,)] = terms.select(index._bucket()).collect()
    opened = plan.select(F.col("_metadata.file_path").alias("f")).distinct().collect() if "_metadata" in plan.columns else []
    assert str(bucket) in files and len({r.bucket for r in plan.collect()}) == 1 and not opened
    assert "PartitionFilters" in plan._jdf.queryExecution().executedPlan().toString()


def test_a_change_that_broke_off_is_not_seen(spark, tmp_path, monkeypatch):
    index = TermIndex(spark, str(tmp_path / "i"), buckets=2)
    index.add(frame(spark, {1: "a b", 2: "c"}))
    monkeypatch.setattr(TermIndex, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("driver lost")))
    with pytest.raises(RuntimeError):
        index.add(frame(spark, {1: "x", 3: "y"}))
    monkeypatch.undo()
    q = spark.createDataFrame([(1, "a x y c")], "item_id long, text string")
    assert {r.id for r in index.search(q, 5).collect()} == whole_ids(spark, {1: "a b", 2: "c"}, q)
    index.add(frame(spark, {4: "a a z"}))
    assert {r.id for r in index.documents().collect()} == {1, 2, 4}
    with pytest.raises(Exception, match="without an id"):
        index.add(spark.createDataFrame([(None, "x")], "doc_id long, text string"))


def whole_ids(spark, docs, q):
    return {d for _, d, _, _ in whole(spark, docs, q, 5)}


def test_collection(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "c"), "k")
    with pytest.raises(FileNotFoundError):
        c.read()
    df = lambda *rows: spark.createDataFrame(rows, "k string, v int")
    c.upsert(df(("a", 1), ("b", 2), ("b", 2)))
    c.upsert(df(("b", 3), ("c", 4)))
    c.delete(df(("a", 0), ("zz", 0)))
    seen = lambda: {tuple(r) for r in c.read().collect()}
    assert seen() == {("b", 3), ("c", 4)}
    c.merge()
    c.upsert(df(("a", 9)))
    assert seen() == {("a", 9), ("b", 3), ("c", 4)}
    c.replace(df(("x", 1)))
    assert seen() == {("x", 1)}
    with pytest.raises(Exception, match="without its key"):
        c.upsert(df((None, 1)))


def test_sums_of_shares_may_pass_a_long(spark):
    raw = spark.range(0, 2_000_000, 1, 4).selectExpr("cast(12 + id % 7 / 8 - 26 * cast(id % 50 = 0 as int) as double) raw", "id % 3 q")
    want = sum(int((12 + i % 7 / 8 - 26 * (i % 50 == 0)) * lexical.PART) for i in range(2_000_000))  # eighths are exact
    assert want > 1 << 63
    assert lexical.mean_idf(raw).first().mean == pytest.approx(want / lexical.PART / 2_000_000, rel=1e-15)
    parts = [5, -7, (1 << 62), (1 << 62) + 3, (1 << 62) - 1, -(1 << 61)]
    rows = spark.createDataFrame([(x,) for x in parts], "x long")
    assert rows.agg(lexical.total(F.col("x"))).first()[0] == float(sum(parts)) and rows.where("false").agg(lexical.total(F.col("x"))).first()[0] is None
    assert raw.agg(lexical.summed(F.lit(30.0), F.lit(1)).alias("s")).first().s == 6e7
