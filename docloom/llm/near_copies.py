"""Near copies by Jaccard similarity of 5-word shingle sets.

Documents whose sets of 5-word shingles have a Jaccard similarity of at least
``SIMILARITY`` are linked, and one document of each connected group stays.
Candidates come from ``BANDS`` bands of ``ROWS`` minimum hashes each: a pair at
the similarity itself misses all bands with probability
(1 - 0.8**4)**24 = 3e-6, a closer pair with less.  Every candidate pair is
checked exactly on the whole sets, unless both are connected already.

Equal sets are one node.  Buckets with the same members are compared once.  The
members of a large bucket are dealt into chunks, each of which also gets the
bucket's least member; pairs of chunks meet only where that leaves a bucket in
several groups, so a hot group of near copies costs rows in proportion.

Defined cases: a text of one to four words is one shingle; texts without words
are equal to each other; of a group the row of least ``doc_id`` stays, of rows that
repeat it with texts of the group the one of least text hash; rows that repeat an
id with texts of different groups are judged each in its own; rows of null
``doc_id`` stay and remove no other row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import shared

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 4
CHUNK = 128
#: Shingles whose minimum hashes are taken at once.
STEP = 1024
#: Texts of a batch whose sets are held at once.
TEXTS = 512
_rng = np.random.default_rng(5)
_ODD = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_PLACE = shared.powers(ROWS)
_BAND = shared.mix64(np.arange(1, BANDS + 1, dtype=np.uint64))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    w = shared.words_of(text)
    if not w:
        return np.zeros(0, np.uint64)
    n = min(SHINGLE, len(w))
    start = np.arange(len(w) - n + 1)
    return np.unique(shared.RollingHash(shared.word_hashes(w))(start, start + n))


def band_keys(s: np.ndarray) -> np.ndarray:
    """One key per band; equal where all minimum hashes of the band are."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for k in range(0, len(s), STEP):
        least = np.minimum(least, ((s[k : k + STEP] ^ _XOR[:, None]) * _ODD[:, None]).min(axis=1))
    mixed = (shared.mix64(least).reshape(BANDS, ROWS) * _PLACE).sum(axis=1, dtype=np.uint64)
    return shared.mix64(mixed ^ _BAND)


def node_of(s: np.ndarray) -> int:
    """64-bit digest of a set."""
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).view(np.int64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SIMILARITY * (len(a) + len(b) - both)


def _slices(batches):
    for b in batches:
        for k in range(0, b.num_rows, TEXTS):
            yield b.slice(k, TEXTS)


def _signatures(batches):
    for b in _slices(batches):
        sets = [shingle_set(t.as_py()) for t in b.column(1)]
        keys = np.array([band_keys(s) for s in sets], np.uint64).reshape(-1).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([node_of(s) for s in sets], pa.int64()), lists], ["doc_id", "tkey", "node", "keys"])


def _sets(batches):
    for b in _slices(batches):
        sets = [shingle_set(t.as_py()) for t in b.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"])


def _tile_edges(batches):
    """Edges that span what is linked in each tile."""
    for t, starts in shared.runs(_slices(batches), ["key", "ti", "tj"]):
        nodes, side = t["node"].to_pylist(), t["side"].to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in t["shingles"].to_pylist()]
        kept = []
        for s, e in zip(starts[:-1], starts[1:]):
            tree = shared.Forest()
            across = any(side[s:e])
            for i in range(s, e):
                for j in range(i + 1, e):
                    if (not across or side[i] != side[j]) and tree.find(nodes[i]) != tree.find(nodes[j]) and similar(sets[i], sets[j]):
                        tree.add(nodes[i], nodes[j])
            kept += tree.kept
        if kept:
            a, b = zip(*kept)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _edges(tiles: DataFrame, sets: DataFrame) -> DataFrame:
    order = ["key", "ti", "tj"]
    whole = tiles.join(sets, "node").repartition(*order).sortWithinPartitions(*order)
    return whole.select(*order, "side", "node", "shingles").mapInArrow(_tile_edges, "a long, b long")


def _chosen(docs: DataFrame) -> DataFrame:
    """``doc_id, tkey, n`` of the row that stays of each group (of one row, too)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), shared.text_key(docs).alias("tkey")).where("doc_id is not null")
    signed = shared.materialize(texts.mapInArrow(_signatures, "doc_id long, tkey long, node long, keys array<long>"), "copies-signed")
    nodes = signed.groupBy("node").agg(F.min("doc_id").alias("least"))
    rows = signed.select("node", F.explode("keys").alias("key")).distinct()
    buckets = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first"), F.bit_xor(F.xxhash64("node")).alias("members"))
    buckets = buckets.where("n > 1").groupBy("n", "first", "members").agg(F.min("key").alias("key"))
    rows = shared.materialize(rows.join(buckets.select("key", "n", "first"), "key"), "copies-rows")
    wanted = shared.materialize(rows.select("node").distinct().join(nodes, "node").select(F.col("least").alias("doc_id")).distinct(), "copies-wanted")
    sets = texts.join(wanted, "doc_id", "left_semi").select("text").mapInArrow(_sets, "node long, shingles binary")
    sets = shared.materialize(sets.dropDuplicates(["node"]), "copies-sets")

    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    dealt = rows.select("key", "node", "n", "first", F.pmod(F.xxhash64("node", F.lit(77)), chunks).cast("int").alias("ti"))
    first = dealt.where("node = first").select("key", "node", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("ti"))
    tiles = dealt.where("node <> first").select("key", "node", "ti").unionByName(first).select("*", F.lit(0).alias("tj"), F.lit(0).alias("side"))
    edges = shared.materialize(_edges(tiles, sets), "copies-edges")
    roots = shared.components(edges, "copies-cc")

    large = rows.where(F.col("n") > CHUNK).join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    split = large.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    split = shared.materialize(split, "copies-split")
    if not split.isEmpty():
        open_rows = large.join(split, "key", "left_semi").select("key", "node")
        more = _edges(shared.bucket_tiles(open_rows, ["key"], "node", CHUNK), sets)
        roots = shared.components(edges.unionByName(more), "copies-cc")

    rooted = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    first = signed.groupBy("node", "doc_id", "tkey").agg(F.count(F.lit(1)).alias("n"))
    first = first.groupBy("node").agg(F.min(F.struct("doc_id", "tkey", "n")).alias("first"))
    return rooted.join(first, "node").groupBy("root").agg(F.min("first").alias("c")).select("c.doc_id", "c.tkey", "c.n")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, one of each group of near copies."""
    chosen = shared.materialize(_chosen(docs), "copies-chosen")
    return shared.one_each(docs, chosen).unionByName(docs.where(F.col("doc_id").isNull()))
