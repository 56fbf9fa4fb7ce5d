"""Vector top-k in tiles against all pairs."""

import numpy as np
import pytest

from docloom.operators import vector

SCHEMA = "vec_id long, embedding array<double>, side string"


def plain(queries, corpus, k):
    out = set()
    ok = lambda v: v is not None and None not in v and np.isfinite(v).all() and any(v)
    for q, a in queries:
        hits = []
        for c, b in corpus:
            if q is not None and c is not None and ok(a) and ok(b) and len(a) == len(b):
                hits.append((-round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 12), c))
        out |= {(q, c, rank + 1) for rank, (_, c) in enumerate(sorted(hits)[:k])}
    return out


@pytest.mark.parametrize("held, corpus", [(1 << 21, 1 << 17), (64, 16)])
def test_tiles_equal_all_pairs(spark, monkeypatch, held, corpus):
    monkeypatch.setattr(vector, "HELD", held)
    monkeypatch.setattr(vector, "CORPUS", corpus)
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-2, 3, 6).astype(float).tolist()) for i in range(90)]
    odd = [(200, None), (201, [0.0] * 6), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (203, [float("nan")] * 6), (204, [1.0, 2.0]), (205, [2.0, 4.0]), (206, []), (None, [1.0] * 6), (207, [1.0] * 5 + [float("inf")])]
    df = spark.createDataFrame([(*r, "x") for r in rows + odd], SCHEMA).repartition(5)
    asked = [r for r in rows + odd if (r[0] or 200) % 7 == 0 or (r[0] or 200) >= 200]
    q = spark.createDataFrame([(*r, "x") for r in asked], SCHEMA)
    got = vector.top_k(q, df, 5).collect()
    assert {(r.query_id, r.id, r["rank"]) for r in got} == plain(asked, rows + odd, 5) and len(got) > 60
    assert vector.top_k(q.where("false"), df, 5).count() == vector.top_k(q, df.where("false"), 5).count() == 0


def test_one_shuffle_of_vectors_and_no_collect(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    df = spark.createDataFrame([(i, [float(i), 1.0], "x") for i in range(50)], SCHEMA)
    monkeypatch.setattr(DataFrame, "toPandas", None)
    plan = vector.top_k(df, df, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Broadcast" not in plan
