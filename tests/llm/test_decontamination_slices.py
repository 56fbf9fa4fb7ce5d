"""Scores of test items do not depend on how the items are cut into slices."""

import numpy as np

from docloom.llm import decontaminate


def test_scores_do_not_depend_on_slices(spark, monkeypatch):
    items = [(i, " ".join(f"c{n}" if n % 3 else f"w{i}x{n}" for n in range(20 + i))) for i in range(12)]
    docs = [(i, "before it " + t.rsplit(" ", 2)[0] + " and after it") for i, t in items]
    bench, texts = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    whole = sorted(map(tuple, decontaminate.contaminated(texts, bench).collect()))
    assert len(whole) >= len(items) and any(score < 1 for _, _, score, _ in whole)
    monkeypatch.setattr(decontaminate, "WORDS", 60)
    assert sorted(map(tuple, decontaminate.contaminated(texts, bench).collect())) == whole
    monkeypatch.setattr(decontaminate, "PASS", 100)
    assert sorted(map(tuple, decontaminate.contaminated(texts, bench).collect())) == whole


def test_one_pass_for_all_slices_that_fit(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"a{i} b{i} c{i} d{i} e{i} " * (1 + 9 * (i % 3))) for i in range(30)], "item_id long, text string")
    assert len(list(decontaminate._indexes(items))) > 1 and len(list(decontaminate._passes(items))) == 1
    monkeypatch.setattr(decontaminate, "WORDS", 100)
    monkeypatch.setattr(decontaminate, "PASS", 400)
    assert len(list(decontaminate._indexes(items))) > len(list(decontaminate._passes(items))) > 2


def test_items_of_null_id_and_of_equal_ids(spark):
    bench = [(None, "one two three four five six seven"), (4, "red green blue white black grey pink"), (4, "north east south west up down left"), (4, "north east south west up down left")]
    texts = [(1, "x " + bench[0][1] + " y"), (2, bench[1][1] + " z"), (3, "u v " + bench[2][1]), (4, "nothing of it")]
    b, d = spark.createDataFrame(bench, "item_id long, text string"), spark.createDataFrame(texts, "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b).collect()} == {(1, None), (2, 4), (3, 4)}
    assert [r.doc_id for r in decontaminate.keep_clean(d, b).collect()] == [4]


def test_both_ways_to_add_up_bounds(monkeypatch):
    """The wide text takes the sparse way; every block whose items could reach
    the threshold by brute force is among the blocks kept."""
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(300)]
    items = [(i, " ".join(rng.choice(words, 20))) for i in range(900)]
    ix = decontaminate.Index(items).prepare()
    text = " ".join(" ".join(rng.choice(words, 15)) + " " + items[k][1] for k in range(0, 900, 45))
    raw = text.encode().split()
    terms = np.array([ix.memo[w] for w in raw])
    dense = set(ix._bound(terms))
    long = np.concatenate([terms, np.full(1 << 19, -1)])
    assert -(-len(long) // ix.span) * len(ix.slack) > 1 << 22
    assert set(ix._bound(long)) == dense and dense
    for p in range(-(-len(terms) // ix.span)):
        present = set(terms[p * ix.span : (p + 2) * ix.span].tolist())
        for i in range(len(items)):
            score = sum(w for t, w in zip(ix.terms[i].tolist(), ix.weights[i]) if t in present)
            assert score < decontaminate.THRESHOLD or (p, i // decontaminate.BLOCK) in dense
