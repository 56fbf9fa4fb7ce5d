"""SimHash near-duplicate classes by bit-sliced comparison.

Fingerprints: 64 bits over 3-word shingles (XXH64, seed 42).  Two distinct
fingerprints that differ in at most three of 64 bits agree on at least two of
five bit blocks, so the ten choices of two blocks are ten exact bucket tables.
Inside a bucket tile the fingerprints of one side stand as 64 vertical bit
planes; carry-save counters hold many distances at once, and a block of lanes
is abandoned once every counter has passed the radius.

Defined cases: null text counts as empty; a text without words has fingerprint
zero and is linked like any other; null ``doc_id`` rows get a fingerprint, a
null component and never name one; repeated rows stay repeated.  Columns other
than ``doc_id`` and ``text`` are ignored by :func:`near_duplicates`.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import shared

SHINGLE = 3
SEED = 42
RADIUS = 3
CHUNK = 2048
#: Five bit blocks (start, width) that cover 64 bits.
BLOCKS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]


def fingerprint(text: str | None) -> int:
    """Bit i is 1 if it is set in over half of the shingle hashes."""
    w = shared.words_of(text)
    if not w:
        return 0
    grams = [b" ".join(w)] if len(w) < SHINGLE else list(map(b" ".join, zip(w, w[1:], w[2:])))
    h = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, len(grams))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        part = h[k : k + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, tkey, fp long)``, one row per row of ``docs``; tkey tells texts
    of one id apart."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py()) for t in b.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], ["doc_id", "tkey", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), shared.text_key(docs).alias("tkey"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, tkey long, fp long")


def planes_of(fps: np.ndarray) -> np.ndarray:
    """64 bit planes of packed lanes: plane[b] has bit b of every fingerprint."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    pad = -len(fps) % 64
    packed = np.packbits(np.pad(bits, ((0, pad), (0, 0))).T, axis=1, bitorder="little")
    return np.ascontiguousarray(packed).view(np.uint64)


def count_planes(diff, radius_over):
    """Carry-save counters over 64 difference planes; ``diff(b)`` is plane b.
    Two counter bits hold 0..3, ``over`` marks lanes beyond; stops early once
    all lanes are over."""
    low = high = over = np.uint64(0)
    for b in range(64):
        d = diff(b)
        carry = low & d
        low = low ^ d
        over = over | (high & carry)
        high = high ^ carry
        if b % 8 == 7 and radius_over(over):
            break
    return over


def near(queries: np.ndarray, fps: np.ndarray, step: int = 64):
    """Index pairs (i, j) with at most RADIUS differing bits, in query blocks."""
    planes = planes_of(fps)
    full = ~np.uint64(0)
    lanes = len(fps)
    for q in range(0, len(queries), step):
        block = queries[q : q + step]
        masks = np.where((block[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1), full, np.uint64(0))
        over = count_planes(lambda b: planes[b][None, :] ^ masks[:, b, None], lambda o: (o == full).all())
        hit = np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little")[:, :lanes]
        i, j = np.nonzero(hit)
        yield i + q, j


def near_small(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same counters over a list of pairs: lane k holds pair (a[k], b[k])."""
    planes = planes_of(a ^ b)
    over = count_planes(lambda p: planes[p], lambda o: (o == ~np.uint64(0)).all())
    return np.unpackbits((~over).view(np.uint8), bitorder="little")[: len(a)].astype(bool)


def _tile_edges(batches):
    """Spanning edges of each tile: at most one per fingerprint."""
    keys = ["tab", "key", "ti", "tj"]
    for t, starts in shared.runs(batches, keys):
        fps = t["fp"].to_numpy().view(np.uint64)
        side = t["side"].to_numpy()
        sizes = np.diff(starts)
        out: list[tuple[int, int]] = []
        small_a, small_b = [], []
        for k in np.flatnonzero(sizes > 1):
            s, e = starts[k], starts[k + 1]
            x, sd = fps[s:e], side[s:e]
            if len(x) <= 24:
                i, j = np.triu_indices(len(x), 1)
                if sd.any():
                    cross = sd[i] != sd[j]
                    i, j = i[cross], j[cross]
                small_a.append(x[i])
                small_b.append(x[j])
            else:
                out += _forest(x[sd == 0], x[sd == 1] if sd.any() else None)
        if small_a:
            a, b = np.concatenate(small_a), np.concatenate(small_b)
            for p in range(0, len(a), 1 << 18):
                hit = near_small(a[p : p + (1 << 18)], b[p : p + (1 << 18)])
                out += list(zip(a[p : p + (1 << 18)][hit].tolist(), b[p : p + (1 << 18)][hit].tolist()))
        if out:
            e = np.array(out, np.uint64).view(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])


def _forest(x, y):
    """Edges that span what is linked between x and y (or within x)."""
    nodes = x if y is None else np.concatenate([x, y])
    shift = 0 if y is None else len(x)
    label = np.arange(len(nodes))
    kept = []
    for i, j in near(x, x if y is None else y):
        j = j + shift
        while True:
            differ = label[i] != label[j]
            i, j = i[differ], j[differ]
            if not len(i):
                break
            a = i[0]
            mine = j[i == a]
            _, first = np.unique(label[mine], return_index=True)
            kept += [(int(nodes[a]), int(nodes[m])) for m in mine[first]]
            merged = np.append(label[mine[first]], label[a])
            label[np.isin(label, merged)] = merged.min()
    return kept


def _rooted(fps: DataFrame) -> DataFrame:
    """``(fp, rep, root)``: distinct fingerprints with the least ``doc_id`` of each
    and the component it is in."""
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    cut = lambda s, n: F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << n) - 1))
    tables = [
        F.struct(F.lit(k).alias("tab"), (cut(*BLOCKS[i]) * F.lit(1 << 13) + cut(*BLOCKS[j])).alias("key"))
        for k, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))
    ]
    rows = classes.select("fp", F.explode(F.array(*tables)).alias("t")).select("fp", "t.tab", "t.key")
    tiles = shared.bucket_tiles(rows, ["tab", "key"], "fp", CHUNK)
    order = ["tab", "key", "ti", "tj"]
    edges = tiles.repartition(*order).sortWithinPartitions(*order).select(*order, "side", "fp").mapInArrow(_tile_edges, "a long, b long")
    roots = shared.components(edges, "simhash-cc")
    return classes.join(roots, classes.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs``."""
    fps = shared.materialize(fingerprints(docs), "simhash-fp")
    rooted = _rooted(fps)
    lowest = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_fp = rooted.join(lowest, "root").select("fp", "component_id")
    named = fps.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    return named.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each near-duplicate group stays: that of least ``doc_id``; of rows
    that repeat it with texts of the same group, the one of least text hash.  Rows
    that repeat an id with texts of different groups are judged each in its own
    group.  Rows of null id stay and remove no other."""
    fps = shared.materialize(fingerprints(docs), "simhash-fp")
    own = fps.where("doc_id is not null")
    first = own.groupBy("fp", "doc_id", "tkey").agg(F.count(F.lit(1)).alias("n"))
    first = first.groupBy("fp").agg(F.min(F.struct("doc_id", "tkey", "n")).alias("first"))
    chosen = _rooted(own).join(first, "fp").groupBy("root").agg(F.min("first").alias("c")).select("c.doc_id", "c.tkey", "c.n")
    return shared.one_each(docs, chosen).unionByName(docs.where(F.col("doc_id").isNull()))
