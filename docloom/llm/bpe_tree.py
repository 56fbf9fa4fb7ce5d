"""Byte-level BPE as a monoid: encode halves, join, decode up the tree.

A text is cut by the public pattern; no merge crosses a cut, so a document is
the concatenation of its pieces.  Every piece that is no single token is halved
down to single bytes.  Two encoded neighbours are joined by re-encoding a window
of tokens around the seam; the window grows until the tokens outside provably
stay: by the pair criterion of BPE (a token sequence is the encoding of its
bytes iff every adjacent pair is the encoding of its own bytes) it is enough
that the two pairs at the window's edges are stable.  Bounded memos keep the
ids of pieces, of short parts and of two-token windows, which recur.

Decoding turns ids into bytes and concatenates neighbours level by level.

Defined cases: null text is empty (no ids, sha256 of nothing); lone surrogates
cannot occur in Spark strings; every other text, of any length, round-trips byte
for byte.  An empty table gives no rows, repeated rows and null ids stay.
Columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import shared

#: Pieces, parts of pieces and two-token windows that a worker's memos hold.
MEMO, PARTS, SEAMS = 400_000, 200_000, 200_000
#: Bytes of a part that is worth keeping.
SHORT = 16
_memo: dict[str, "Tree"] = {}


class Tree:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.pieces = regex.compile(pattern).findall
        self.memo = shared.Cache(self._piece, MEMO)
        self.parts = shared.Cache(self._halves, PARTS)
        self.seams = shared.Cache(lambda pair: self.merge(self.bytes_of[pair[0]] + self.bytes_of[pair[1]]), SEAMS)

    @classmethod
    def load(cls, path: str, pattern: str) -> "Tree":
        if path not in _memo:
            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
            _memo[path] = cls(ranks, pattern)
        return _memo[path]

    def merge(self, data: bytes) -> list[int]:
        """Ids of a window: lowest rank first, leftmost first, by a heap over a
        linked list."""
        ranks, n = self.ranks, len(data)
        end = list(range(1, n + 1))  # part i is data[i:end[i]]; 0 once merged away
        before = list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or ranks.get(data[i : end[j]]) != r:
                continue  # one of the two parts has changed since
            end[i], end[j] = end[j], 0
            if end[i] < n:
                before[end[i]] = i
                if (r := ranks.get(data[i : end[end[i]]])) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := ranks.get(data[h : end[i]])) is not None:
                heapq.heappush(heap, (r, h))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def tree(self, data: bytes) -> list[int]:
        """Ids of a run of bytes of any length."""
        return self.parts[data] if len(data) <= SHORT else self._halves(data)

    def _halves(self, data: bytes) -> list[int]:
        if len(data) == 1:
            return [self.ranks[data]]
        half = len(data) // 2
        return self.join(self.tree(data[:half]), self.tree(data[half:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The monoid's product: re-encodes a window of k tokens on each side of
        the seam, twice as many until the pairs at its edges are stable."""
        k, seams = 1, self.seams
        while True:
            a, b = max(0, len(left) - k), min(len(right), k)
            if k == 1:
                window = seams[left[a], right[0]]
            else:
                window = self.merge(b"".join(map(self.bytes_of.__getitem__, left[a:] + right[:b])))
            if a == 0 and b == len(right):
                return window
            if (a == 0 or self._stable(left[a - 1], window[0])) and (b == len(right) or self._stable(window[-1], right[b])):
                return left[:a] + window + right[b:]
            k *= 2

    def _stable(self, x: int, y: int) -> bool:
        pair = self.seams[x, y]
        return len(pair) == 2 and pair[0] == x

    def _piece(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.ranks.get(data)  # a match that is a token is that token
        return np.array(self.tree(data) if whole is None else [whole], "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        parts = []
        memo = self.memo
        for p in self.pieces(text):
            parts.append(memo[p] if len(p) <= 64 else self._piece(p))
        return b"".join(parts)

    def decode(self, ids: bytes) -> bytes:
        """Concatenate up the tree, neighbours of each level in pairs."""
        parts = list(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        while len(parts) > 1:
            odd = parts[len(parts) & ~1 :]
            parts = [x + y for x, y in zip(parts[::2], parts[1::2])] + odd
        return parts[0] if parts else b""


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """One row per document: counts and digests of ids and decoded bytes."""

    def run(batches):
        tree = Tree.load(vocabulary, pattern)
        for b in batches:
            n, ih, dh = [], [], []
            for t in b.column(1):
                ids = tree.encode(t.as_py())
                n.append(len(ids) // 4)
                ih.append(hashlib.sha256(ids).hexdigest())
                dh.append(hashlib.sha256(tree.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ih, pa.string()), pa.array(dh, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def token_ids(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """General form: the ids themselves beside their count and the digests."""

    def run(batches):
        tree = Tree.load(vocabulary, pattern)
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                raw = [tree.encode(t.as_py()) for t in part.column(1)]
                ids = pa.array([np.frombuffer(r, "<u4").astype(np.int32) for r in raw], pa.list_(pa.int32()))
                n = pa.array([len(r) // 4 for r in raw], pa.int64())
                ih = pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string())
                dh = pa.array([hashlib.sha256(tree.decode(r)).hexdigest() for r in raw], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), n, ids, ih, dh], ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    schema = "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
