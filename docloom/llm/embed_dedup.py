"""Embedding near-duplicates by Euclidean p-stable hashing.

Equal vectors collapse to one class first.  A vector is normalised and put on a
grid of 2**-20; Gaussian directions stand on a grid of 2**-10, so projections
are whole-number arithmetic and come out alike in any order of summation.  A
table's bucket is the tuple floor((a.v + b) / w) of K projections; a pair at
cosine 0.9 (distance 0.447) meets in some of the L tables with probability
``RECALL`` at least, closer pairs with more.  K follows the number of classes,
so that chance buckets keep their size as the data grow, and L follows from K.

Inside a bucket all pairs are compared exactly in double precision, tile by
tile; a hot bucket is dealt into many tiles.  A pair counts only in the first
table where it meets.  Tiles give per vector the number of its links, and
spanning edges, never all pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing (0 links, their own component, kept); vectors of
different lengths are never compared; repeated rows link with each other; null
``vec_id`` rows count as links but name no component.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import shared
from docloom.llm.shared import Forest

COSINE = 0.9
WIDTH = 2.0
RECALL = 0.97
#: Classes that meet by chance in one bucket, about.
CHANCE = 64
CHUNK = 1024
SEED = 20_240_601
GRID, DIRECTION_GRID = 1 << 20, 1 << 10


def meet(distance: float) -> float:
    """Probability that one projection puts two points into the same cell."""
    r = WIDTH / distance
    phi = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * phi - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def parameters(classes: int, k: int | None = None, recall: float = RECALL) -> tuple[int, int]:
    """(K, L) for that many distinct vectors, or for the K given."""
    near, far = meet(math.sqrt(2 - 2 * COSINE)), meet(math.sqrt(2))
    k = k or max(4, math.ceil(math.log(max(classes, 1) / CHANCE) / -math.log(far)))
    return k, math.ceil(math.log(1 - recall) / math.log(1 - near**k))


class Hasher:
    def __init__(self, k: int, tables: int):
        self.k, self.tables = k, tables
        self.of: dict[int, tuple] = {}

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """Bucket keys (n x tables) of unit rows."""
        dim = unit.shape[1]
        if dim not in self.of:
            rng = np.random.default_rng([SEED, dim])
            n = self.k * self.tables
            self.of[dim] = np.rint(rng.normal(size=(dim, n)) * DIRECTION_GRID), np.rint(rng.uniform(0, WIDTH, n) * GRID * DIRECTION_GRID)
        a, b = self.of[dim]
        cells = np.floor((np.rint(unit * GRID) @ a + b) / (WIDTH * GRID * DIRECTION_GRID)).astype(np.int64)
        cells = cells.reshape(len(unit), self.tables, self.k).astype(np.uint64)
        h = np.full(cells.shape[:2], dim, np.uint64)
        for j in range(self.k):
            h = shared.mix64(h * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, j])
        return h.view(np.int64)


def unit_rows(raw: list[bytes]) -> np.ndarray:
    v = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # no overflow in the squares
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _to_bytes(batches):
    """Components as bytes of doubles; null where a vector links with nothing."""
    for b in batches:
        out = []
        for x in b.column(1):
            v = np.array(x.as_py() if x.is_valid and x.as_py() else [np.nan], np.float64)
            out.append((v + 0.0).astype("<f8").tobytes() if np.isfinite(v).all() and v.any() else None)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["vec_id", "vec"])


def _tile_links(hasher):
    keys = ["tab", "key", "ti", "tj"]

    def run(batches):
        for t, starts in shared.runs(batches, keys):
            col = {c: t[c].to_numpy() for c in ("tab", "side", "cls", "n")}
            raw = t["vec"].to_pylist()
            counts: dict[int, int] = {}
            edges: list[tuple[int, int]] = []
            for s, e in zip(starts[:-1], starts[1:]):
                size = np.fromiter(map(len, raw[s:e]), np.int64, e - s)
                for one in np.unique(size):  # keys of different lengths may be equal by chance
                    at = s + np.flatnonzero(size == one)
                    if len(at) > 1:
                        _tile(hasher, int(col["tab"][s]), col["side"][at], col["cls"][at], col["n"][at], unit_rows([raw[i] for i in at]), counts, edges)
            a = list(counts) + [x for x, _ in edges]
            b = [None] * len(counts) + [y for _, y in edges]
            w = list(counts.values()) + [0] * len(edges)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(w, pa.int64())], ["a", "b", "w"])

    return run


def _tile(hasher, table, side, cls, n, unit, counts, edges):
    cross = side.any()
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if cross else left
    forest = Forest()
    sig = None
    for s in range(0, len(left), 256):
        rows = left[s : s + 256]
        i, j = np.nonzero(unit[rows] @ unit[right].T >= COSINE - 1e-9)
        i, j = rows[i], right[j]
        if not cross:
            i, j = i[i < j], j[i < j]
        if not len(i):
            continue
        exact = np.einsum("ij,ij->i", unit[i], unit[j]) >= COSINE
        i, j = i[exact], j[exact]
        if table and len(i):
            sig = hasher.keys(unit)[:, :table] if sig is None else sig
            for p in range(0, len(i), 1 << 16):
                part = slice(p, p + (1 << 16))
                new = ~(sig[i[part]] == sig[j[part]]).any(axis=1)
                _count(cls, n, i[part][new], j[part][new], counts, forest)
        else:
            _count(cls, n, i, j, counts, forest)
    edges += forest.kept


def _count(cls, n, i, j, counts, forest):
    for a, b in ((i, j), (j, i)):
        u, at = np.unique(cls[a], return_inverse=True)
        for c, w in zip(u.tolist(), np.bincount(at, n[b]).tolist() if len(u) else []):
            counts[c] = counts.get(c, 0) + int(w)
    for a, b in zip(cls[i].tolist(), cls[j].tolist()):
        forest.add(a, b)


def near_duplicates(vectors: DataFrame, k: int | None = None, recall: float = RECALL) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors``.  With
    ``k`` given, pairs are found or not whatever else the table holds; else ``k``
    follows its number of distinct vectors.  Either way the number of tables
    follows from ``k`` and ``recall``, the least chance of a pair at the limit."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = shared.materialize(rows.mapInArrow(_to_bytes, "vec_id long, vec binary"), "embed-rows")
    classes = rows.where("vec is not null").groupBy("vec").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("rep"))
    classes = shared.materialize(classes.select("vec", "n", "rep", F.xxhash64("vec").alias("cls")), "embed-classes")
    k, tables = parameters(classes.count(), k, recall)
    hasher = Hasher(k, tables)

    def hashed(batches):
        for b in batches:
            raw = b.column(1).to_pylist()
            for dim in sorted({len(r) for r in raw}):
                at = [i for i, r in enumerate(raw) if len(r) == dim]
                keys = hasher.keys(unit_rows([raw[i] for i in at]))
                cls = np.repeat(b.column(0).to_numpy()[at], tables)
                yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(at))), pa.array(keys.ravel())], ["cls", "tab", "key"])

    slots = classes.select("cls", "vec").mapInArrow(hashed, "cls long, tab int, key long")
    tiles = shared.bucket_tiles(slots, ["tab", "key"], "cls", CHUNK).join(classes.select("cls", "vec", "n"), "cls")
    order = ["tab", "key", "ti", "tj"]
    dealt = tiles.repartition(*order).sortWithinPartitions(*order).select(*order, "side", "cls", "n", "vec")
    found = shared.materialize(dealt.mapInArrow(_tile_links(hasher), "a long, b long, w long"), "embed-links")
    counts = found.where("b is null").groupBy("a").agg(F.sum("w").alias("w"))
    roots = shared.components(found.where("b is not null").select("a", "b"), "embed-cc")
    named = classes.join(roots, classes.cls == roots.node, "left").select("cls", "vec", "n", "rep", F.coalesce("root", "cls").alias("root"))
    lowest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    full = named.join(lowest, "root").join(counts, named.cls == counts.a, "left")
    full = full.select("vec", (F.coalesce("w", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    valid = rows.where("vec is not null").join(full, "vec").select("vec_id", "n_links", F.when(F.col("vec_id").isNotNull(), F.col("component_id")).alias("component_id"))
    alone = rows.where("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = valid.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
