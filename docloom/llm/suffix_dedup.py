"""Repeated passages across documents by sparse suffix arrays.

Of all suffixes (in words) only those at content-selected positions are kept:
position p is an anchor if the hash of its first ``PREFIX`` words is the least in
some window of ``PASSAGE`` words (leftmost on ties), so any two equal passages
of PASSAGE words keep a common anchor.  About one suffix in thirteen remains.
Suffixes are brought in order by their prefix hash; equal neighbours are a run.
Each anchor is extended left and right to its *block*: the run of all windows
whose least position it is.  Equal blocks match as a whole; where a run holds
different blocks, their windows are compared one by one.  Runs are aggregated
(with partial sums per task), never gathered, so a hot passage costs no more
than a rare one.

Result: a window of PASSAGE words is repeated if it occurs at two places or
more.  Its first place, by (doc_id, position), is kept; all other places are
removed.  Neighbouring windows merge into maximal spans.

Defined cases: words are maximal runs outside ASCII white space, compared with
A-Z lowered; null and empty texts and texts of fewer words have no spans; rows
of null ``doc_id`` are left alone; of rows that repeat a ``doc_id``, equal texts
count as one place and differing texts are ordered by the hash of the text.
Windows are equal if their anchors' prefix hashes and their own hashes are: two
64-bit hashes, the second compared only among windows that share the first.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import shared

PASSAGE = 50
PREFIX = 25
SLICE = 512
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def anchors(words: list[bytes]):
    """(prefix hash, block hash, anchor, first window, windows) arrays."""
    n = len(words) - PASSAGE + 1
    if n < 1:
        return None
    roll = shared.RollingHash(shared.word_hashes(words))
    at = np.arange(len(words) - PREFIX + 1)
    keys = roll(at, at + PREFIX)
    span = PASSAGE - PREFIX + 1
    views = np.lib.stride_tricks.sliding_window_view(keys, span)
    least = np.empty(n, np.int64)
    for s in range(0, n, 1 << 16):
        least[s : s + (1 << 16)] = views[s : s + (1 << 16)].argmin(axis=1)
    least += np.arange(n)
    first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    count = np.diff(np.append(first, n))
    anchor = least[first]
    block = roll(first, first + count + PASSAGE - 1)
    block = shared.mix64(block + ((anchor - first).astype(np.uint64) << np.uint64(8)) + count.astype(np.uint64))
    return keys[anchor], block, anchor, first, count, roll


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents with the hash that tells differing texts of one id apart."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("tkey"), "text")


def _slices(batches):
    """Arrow batches in slices of bounded rows, for a worker's memory."""
    for b in batches:
        for s in range(0, b.num_rows, SLICE):
            yield b.slice(s, SLICE)


def _emit(batches):
    """One row per anchor of each document."""
    for b in _slices(batches):
        cols = [[], [], [], [], [], []]
        for doc, tkey, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            got = anchors(shared.words_of(t.as_py()))
            if got:
                k, blk, _, first, count, _ = got
                cols[0].append(k.view(np.int64))
                cols[1].append(blk.view(np.int64))
                cols[2].append(np.full(len(k), doc, np.int64))
                cols[3].append(np.full(len(k), tkey, np.int64))
                cols[4].append(first.astype(np.int32))
                cols[5].append(count.astype(np.int32))
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["khash", "bhash", "doc_id", "tkey", "first", "n"])


ANCHORS = "khash long, bhash long, doc_id long, tkey long, first int, n int"


def _windows(batches):
    """Single windows of the blocks listed with each document."""
    for b in _slices(batches):
        cols = [[], [], [], [], [], []]
        for doc, tkey, t, blocks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist()):
            words = shared.words_of(t.as_py())
            roll = shared.RollingHash(shared.word_hashes(words))
            first = np.array([x["first"] for x in blocks], np.int64)
            n = np.array([x["n"] for x in blocks], np.int64)
            many = np.repeat(np.array([x["many"] for x in blocks], bool), n)
            pos = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            cols[0].append(roll(pos, pos + PASSAGE).view(np.int64))
            cols[1].append(np.full(len(pos), doc, np.int64))
            cols[2].append(np.full(len(pos), tkey, np.int64))
            cols[3].append(pos.astype(np.int32))
            cols[4].append(many)
            cols[5].append(np.repeat(np.array([x["khash"] for x in blocks], np.int64), n))
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["whash", "doc_id", "tkey", "first", "many", "khash"])


def marks(docs: DataFrame) -> DataFrame:
    """``doc_id, tkey, first, n, kept``: runs of n windows that are repeated;
    kept tells the first place.  Runs may touch or overlap."""
    texts = _keyed(docs)
    all_anchors = shared.materialize(texts.mapInArrow(_emit, ANCHORS), "suffix-anchors")
    place = F.struct("doc_id", "tkey", "first")
    blocks = all_anchors.groupBy("khash", "bhash").agg(F.min(place).alias("rep"), F.max(place).alias("far"))
    blocks = blocks.select("khash", "bhash", "rep", (F.col("rep") != F.col("far")).alias("many"))
    keys = blocks.groupBy("khash").agg(F.count(F.lit(1)).alias("kinds"), F.max("many").alias("any")).where("kinds > 1 or any")
    state = shared.materialize(blocks.join(keys, "khash").select("khash", "bhash", "many", "rep", "kinds"), "suffix-blocks")
    same = F.col("rep") == place
    shared_anchors = all_anchors.join(state, ["khash", "bhash"]).where(~same | F.col("many") | (F.col("kinds") > 1))
    hits = shared.materialize(shared_anchors.select("khash", "doc_id", "tkey", "first", "n", "many", "kinds", same.alias("kept")), "suffix-hits")
    by_block = hits.where("many and (not kept or kinds = 1)").select("doc_id", "tkey", "first", "n", "kept")
    mixed = hits.where("kept and kinds > 1")
    wanted = mixed.groupBy("doc_id", "tkey").agg(F.collect_set(F.struct("first", "n", "many", "khash")).alias("blocks"))
    rows = texts.join(wanted, ["doc_id", "tkey"]).select("doc_id", "tkey", "text", "blocks")
    shared.discard(all_anchors)
    shared.discard(state)
    windows = shared.materialize(rows.mapInArrow(_windows, "whash long, doc_id long, tkey long, first int, many boolean, khash long"), "suffix-windows")
    least = windows.groupBy("khash", "whash").agg(F.min(place).alias("rep"), F.max(place).alias("far"), F.max("many").alias("any")).where("rep <> far or any").drop("far", "any")
    by_window = windows.join(least, ["khash", "whash"]).select("doc_id", "tkey", "first", F.lit(1).alias("n"), same.alias("kept"))
    return by_block.unionByName(by_window)


def merge(runs: list) -> list[tuple[int, int]]:
    """Word spans [start, end) from runs of windows (first, n)."""
    out: list[list[int]] = []
    for first, n in sorted(runs):
        end = first + n + PASSAGE - 1
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return [tuple(x) for x in out]


def _merge_rows(batches):
    for b in batches:
        cols = [[], [], [], [], []]
        for doc, tkey, runs in zip(*(b.column(i).to_pylist() for i in range(3))):
            for kept in (True, False):
                for s, e in merge([(r["first"], r["n"]) for r in runs if r["kept"] is kept]):
                    for c, v in zip(cols, (doc, tkey, s, e, kept)):
                        c.append(v)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "tkey", "start_word", "end_word", "kept"])


def spans(docs: DataFrame) -> DataFrame:
    """``doc_id, tkey, start_word, end_word, kept``: maximal spans of repeated
    passages; ``kept`` spans are first places, the others are to be removed."""
    per_doc = marks(docs).groupBy("doc_id", "tkey").agg(F.collect_list(F.struct("first", "n", "kept")).alias("runs"))
    return per_doc.mapInArrow(_merge_rows, "doc_id long, tkey long, start_word int, end_word int, kept boolean")


def cut(text: str, gone: list[tuple[int, int]]) -> str:
    """``text`` without the words of the spans; what stays is untouched."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.start() for m in _WORD.finditer(raw)]
    out, last = [], 0
    for s, e in gone:
        out.append(raw[last : at[s]])
        last = at[e] if e < len(at) else len(raw)
    out.append(raw[last:])
    left = b"".join(out).decode("utf-8", "surrogatepass")
    return left.rstrip(" \t\r\n\x0b\x0c") if gone and last == len(raw) else left


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with every repeated passage cut out but at its first place; all
    columns stay, ``n_chars`` (if there) is counted anew, and a document of
    which nothing is left goes."""
    gone = spans(docs).where("not kept").groupBy("doc_id", "tkey").agg(F.collect_list(F.struct("start_word", "end_word")).alias("_gone"))
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("tkey").alias("_tkey"), "_gone")
    joined = docs.join(gone, (docs["doc_id"] == gone["_id"]) & (F.xxhash64(docs["text"]) == gone["_tkey"]), "left")
    at, names = docs.columns.index("text"), docs.columns
    chars = names.index("n_chars") if "n_chars" in names else None
    chars_type = None if chars is None else docs.schema["n_chars"].dataType.simpleString()

    def run(batches):
        for b in _slices(batches):
            texts, keep = [], []
            for t, g in zip(b.column(at), b.column(len(names))):
                text, left = t.as_py(), None
                if g.is_valid:
                    left = cut(text, sorted((x["start_word"], x["end_word"]) for x in g.as_py()))
                texts.append(text if left is None else left)
                keep.append(left is None or bool(left.strip(" \t\r\n\x0b\x0c")))
            cols = [b.column(i) for i in range(len(names))]
            cols[at] = pa.array(texts, pa.string())
            if chars is not None and chars_type in ("bigint", "int"):
                new = [len(x) if x is not None and g.is_valid else o for x, g, o in zip(texts, b.column(len(names)), cols[chars].to_pylist())]
                cols[chars] = pa.array(new, cols[chars].type)
            yield pa.RecordBatch.from_arrays(cols, names).filter(pa.array(keep, pa.bool_()))

    own = [docs[c].alias(f"c{k}") for k, c in enumerate(names)]  # names of the table may clash with ours
    return joined.select(*own, gone["_gone"].alias("gone")).mapInArrow(run, docs.schema)
