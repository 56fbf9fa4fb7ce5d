"""Near copies against brute force, over chunks, on odd cases, and in the pipeline."""

import collections
import itertools
import random

import corpus_pipeline as P
import pytest

from docloom.llm import near_copies, simhash


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def similar_pairs(texts):
    """Ids of all pairs of 5-word Jaccard similarity 0.8 or more."""
    sets, places = {i: shingles(t) for i, t in texts.items()}, collections.defaultdict(list)
    for i in sorted(sets):
        for g in sets[i]:
            places[g].append(i)
    both = collections.Counter(p for ids in places.values() for p in itertools.combinations(ids, 2))
    return {(a, b) for (a, b), n in both.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)}


def expected(texts):
    root = {i: i for i in texts}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in similar_pairs(texts):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return sorted({find(i) for i in texts})


def test_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == expected(texts)


def test_chunks_of_a_large_bucket_lose_nothing(spark, monkeypatch):
    """Two groups in one bucket, of many chunks, unlike each other and the first."""
    monkeypatch.setattr(near_copies, "CHUNK", 4)
    monkeypatch.setattr(near_copies, "band_keys", lambda s: near_copies._BAND)
    words = lambda k, i: " ".join(f"g{k}w{n}" for n in range(200)) + f" own{i}"
    texts = {i: words(i % 3, i) for i in range(40)} | {99: "quite another text without any copy at all"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.keep_one(df).collect()) == [0, 1, 2, 99] == expected(texts)


def test_odd_cases(spark):
    rows = [(None, "no id"), (None, "no id"), (1, None), (2, ""), (3, "one"), (4, " \n"), (5, "ONE"), (6, "w " * 5000), (7, "w " * 9), (8, "one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id or 0) for r in near_copies.keep_one(df).collect()) == [0, 0, 1, 3, 6, 8]
    assert near_copies.keep_one(df.where("false")).count() == 0


def test_pipeline_keeps_no_two_near_copies(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    once = {r.doc_id: r.text for r in simhash.keep_one(docs).collect()}
    assert similar_pairs(once)
    assert sorted(r.doc_id for r in P.near_duplicates_out(spark, docs, sf).collect()) == expected(once)


WORDS = [" ".join(f"{k}word{n}" for n in range(60)) for k in "abcd"]


@pytest.mark.parametrize("keep_one", [simhash.keep_one, near_copies.keep_one])
@pytest.mark.parametrize("seed", range(3))
def test_repeated_ids_are_judged_by_their_texts(spark, keep_one, seed):
    """Texts unlike all others stay, whatever else bears their id, in any order."""
    a, b, c, d = WORDS
    rows = [(3, a, 1), (7, a, 1), (7, b, 1), (9, c, 1), (9, d, 1), (9, d, 1), (None, a, 1), (8, b, 1)]
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    got = sorted((r.doc_id or 0, r.text) for r in keep_one(df).collect())
    assert got == sorted([(3, a), (7, b), (9, c), (9, d), (0, a)])
    rows = [(1, a, 1), (2, a + " x", 1), (2, d, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    assert {(r.doc_id, r.text) for r in near_copies.keep_one(df).collect()} == {(1, a), (2, d)}


@pytest.mark.parametrize("keep_one", [simhash.keep_one, near_copies.keep_one])
def test_of_rows_that_differ_in_other_columns_the_same_stays(spark, keep_one):
    rows = [(5, WORDS[0], f"src{k}") for k in range(6)]
    got = {tuple(keep_one(spark.createDataFrame(random.Random(k).sample(rows, 6), "doc_id long, text string, source string").repartition(k + 1)).first()) for k in range(3)}
    assert len(got) == 1
