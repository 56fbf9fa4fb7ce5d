"""Exact vector search: a stated query set against all rows, in tiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import written

#: Numbers of a tile's query matrix, rows of a corpus block, rows compared at once.
HELD, CORPUS, ROWS = 1 << 21, 1 << 17, 512


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def _usable(rows: DataFrame, id_col: str, vec_col: str, kind=None) -> DataFrame:
    """``(id, v, kind)`` of the vectors that have a direction."""
    out = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), (F.lit(0) if kind is None else kind.cast("int")).alias("kind"))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return out.where(F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def _best(ids, scores, k):
    """Per row the k best by score rounded to 12 places, ties by id."""
    top = np.lexsort((ids, -np.round(scores, 12)), axis=1)[:, :k]
    return np.take_along_axis(ids, top, 1), np.take_along_axis(scores, top, 1)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # squares of very large or small entries stay finite
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _tiles(k: int):
    """Rows ``tile, dim, kind, side, id, v`` in that order: a tile's queries are held
    as a matrix, its corpus rows of one kind stream past, and each query's best k
    leave."""

    def done(kind, q, best):
        ids, scores = best
        if scores.shape[1]:
            at = np.isfinite(scores)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q[0], scores.shape[1])[at.ravel()]), pa.array(np.full(at.sum(), kind, np.int32)), pa.array(ids[at]), pa.array(scores[at])], ["query_id", "kind", "id", "score"])

    def run(batches):
        key, ids, held, q, best = None, [], [], None, None
        for b in batches:
            tile, dim, kind, side, own = (b.column(c).to_numpy() for c in range(5))
            runs = np.flatnonzero(np.append(True, np.any([x[1:] != x[:-1] for x in (tile, dim, kind, side)], axis=0)))
            for s, e in zip(runs, np.append(runs[1:], len(tile))):
                if key != (tile[s], dim[s], kind[s]):
                    if q is not None:
                        yield from done(key[2], q, best)
                    key, ids, held, q, best = (tile[s], dim[s], kind[s]), [], [], None, None
                v = b.column(5).slice(s, e - s).flatten().to_numpy().reshape(e - s, -1)
                if side[s] == 0:
                    ids.append(own[s:e])
                    held.append(_unit(v))
                elif held:
                    if q is None:
                        q = (np.concatenate(ids), np.concatenate(held))
                        best = (np.zeros((len(q[0]), 0), np.int64), np.zeros((len(q[0]), 0)))
                    for p in range(0, e - s, ROWS):
                        scores = q[1] @ _unit(v[p : p + ROWS]).T
                        own_ids = np.broadcast_to(own[s + p : s + p + scores.shape[1]], scores.shape)
                        best = _best(np.concatenate([best[0], own_ids], axis=1), np.concatenate([best[1], scores], axis=1), k)
        if q is not None:
            yield from done(key[2], q, best)

    return run


def top_k(queries: DataFrame, corpus: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(query_id, id, score, rank)``: the k most similar rows of ``corpus`` for
    every row of ``queries`` by cosine, ties by id.

    Queries and corpus are dealt into blocks, and every pair of blocks is a tile:
    one shuffle brings its rows together, a task holds a tile's queries (at most
    about ``HELD`` numbers) and each query's best k, and a window merges the bests.
    Only counts reach the driver.  Both sides are repeated once per block of the
    other, which a batch of queries against all rows costs in any layout.

    Defined cases: vectors that are null, zero or hold null or non-finite entries
    find nothing and are not found; vectors of different lengths do not meet; null
    query ids are left out; of queries that repeat an id the vector of least hash
    counts; corpus rows that repeat an id are hits of their own; null corpus ids are
    left out; with an empty side there are no rows.
    """
    return top_k_of_kinds(queries, corpus, [k], id_col, vec_col).drop("kind")


def top_k_of_kinds(queries: DataFrame, corpus: DataFrame, ks: list[int], id_col: str = "vec_id", vec_col: str = "embedding", kind_col: str | None = None) -> DataFrame:
    """``(query_id, kind, id, score, rank)``: like :func:`top_k` for several corpora in
    one table and one pass; ``kind_col`` numbers them from 0, and of kind i each query
    gets the best ``ks[i]``."""
    q = _usable(queries, id_col, vec_col).where("id is not null").groupBy("id").agg(F.min_by("v", F.xxhash64("v")).alias("v"))
    c = _usable(corpus, id_col, vec_col, F.col(kind_col) if kind_col else None).where("id is not null")
    asked = q.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("d")).first()
    there = c.agg(F.count(F.lit(1)).alias("n")).first()
    across = max(1, -(-asked.n * asked.d // (HELD // 2)))
    down = max(1, -(-there.n // CORPUS))
    deal = lambda n, *salt: F.pmod(F.xxhash64("id", *salt), F.lit(n)).cast("int")
    order = ["tile", "dim", "kind", "side"]
    tiles = F.explode(F.transform(F.sequence(F.lit(0), F.lit(down - 1)), lambda x: deal(across) * down + x)).alias("tile")
    left = q.select(tiles, F.size("v").alias("dim"), F.lit(0).alias("side"), "id", "v")
    left = left.withColumn("kind", F.explode(F.sequence(F.lit(0), F.lit(len(ks) - 1)))).select(*order, "id", "v")
    tiles = F.explode(F.transform(F.sequence(F.lit(0), F.lit(across - 1)), lambda x: x * down + F.col("_b"))).alias("tile")
    right = c.withColumn("_b", deal(down, F.spark_partition_id())).select(tiles, F.size("v").alias("dim"), "kind", F.lit(1).alias("side"), "id", "v")
    laid = left.unionByName(right).repartition("tile", "dim", "kind").sortWithinPartitions(*order)
    found = laid.mapInArrow(_tiles(max(ks)), "query_id long, kind int, id long, score double")
    w = Window.partitionBy("query_id", "kind").orderBy(F.desc(F.round("score", 12)), F.asc("id"))
    ranked = found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= max(ks))
    return ranked if len(ks) == 1 else ranked.where(F.col("rank") <= F.element_at(F.array(*map(F.lit, ks)), F.col("kind") + 1))


def top_k_by_reference(queries: DataFrame, vectors: DataFrame, rows: DataFrame, ks: list[int]) -> DataFrame:
    """``(query_id, kind, id, key, score)``: like :func:`top_k_of_kinds` for
    ``rows(kind, id, key, ref)`` that name their vector in ``vectors(ref, embedding)``;
    ``queries(id, embedding)``.

    Rows that share a vector score alike, so a vector is compared once a kind, under the
    least id of its rows: the best k rows belong to the best k vectors in that order.
    Only of these vectors the rows of least ids are ranked.  Ties go by id, then key.
    """
    rows = rows.where("id is not null")
    heads = rows.groupBy("kind", "ref").agg(F.min("id").alias("id")).join(vectors.select("ref", "embedding"), "ref")
    heads = written(heads.orderBy("id", "ref").select(F.monotonically_increasing_id().alias("at"), "kind", "ref", "embedding"), "heads")  # numbered in order of ids
    near = top_k_of_kinds(queries.withColumnRenamed("id", "at"), heads, ks, "at", kind_col="kind").select("query_id", F.col("id").alias("at"), "score")
    best = written(near.join(heads.select("at", "kind", "ref"), "at").select("query_id", "kind", "ref", "score"), "best")
    least = Window.partitionBy("kind", "ref").orderBy("id", "key")
    few = rows.join(best.select("kind", "ref").distinct(), ["kind", "ref"], "left_semi").withColumn("_n", F.row_number().over(least)).where(F.col("_n") <= max(ks))
    w = Window.partitionBy("query_id", "kind").orderBy(F.desc(F.round("score", 12)), "id", "key")
    ranked = best.join(few, ["kind", "ref"]).withColumn("_rank", F.row_number().over(w))
    return ranked.where(F.col("_rank") <= F.element_at(F.array(*map(F.lit, ks)), F.col("kind") + 1)).select("query_id", "kind", "id", "key", "score")
