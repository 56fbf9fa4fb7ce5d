"""Recall of the hash tables per setting, and tiles of mixed lengths."""

import numpy as np
import pytest

from docloom.llm import embed_dedup


def at_cosine(rng, n, dim, cosine):
    """Pairs of unit vectors at that cosine."""
    a = rng.normal(size=(n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(n, dim))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    return a, cosine * a + np.sqrt(1 - cosine**2) * b


@pytest.mark.parametrize("k, recall", [(4, 0.97), (8, 0.97), (8, 0.9), (14, 0.97)])
def test_recall_at_the_limit(k, recall):
    got, tables = embed_dedup.parameters(10**9, k, recall)
    assert got == k
    a, b = at_cosine(np.random.default_rng(k), 2000, 64, embed_dedup.COSINE)
    hasher = embed_dedup.Hasher(k, tables)
    met = (hasher.keys(a) == hasher.keys(b)).any(axis=1).mean()
    assert met >= recall - 0.02
    a, b = at_cosine(np.random.default_rng(k), 2000, 64, 0.95)
    assert (hasher.keys(a) == hasher.keys(b)).any(axis=1).mean() > met


def test_other_vectors_do_not_change_links_at_a_given_k(spark):
    rng = np.random.default_rng(1)
    a, b = at_cosine(rng, 60, 16, 0.91)
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([a, b]))]
    more = [(1000 + i, v.tolist()) for i, v in enumerate(rng.normal(size=(3000, 24)))]
    links = lambda r: {x.vec_id: x.n_links for x in embed_dedup.near_duplicates(spark.createDataFrame(r, "vec_id long, embedding array<double>"), 6).collect() if x.vec_id < 1000}
    assert links(rows) == links(rows + more) and sum(links(rows).values()) >= 108


def test_a_tile_of_mixed_lengths_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup.Hasher, "keys", lambda self, unit: np.zeros((len(unit), self.tables), np.int64))
    rows = [(i, [1.0, 0.0, i / 100]) for i in range(4)] + [(10 + i, [1.0, i / 100]) for i in range(4)] + [(None, [1.0, 0.5, 0.5, 0.5])]
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {**{i: (3, 0) for i in range(4)}, **{10 + i: (3, 10) for i in range(4)}, None: (0, None)}
