"""URL filter over a sorted digest array.

Rules ``(host, path, verdict)`` become one file: sorted 64-bit xxhash keys of
``host + path``, offsets, and the full rule strings.  Workers memory-map it (or
read it through its filesystem where it is no local file), probe the digests of
all host suffix and path prefix combinations of a batch by one vectorised
binary search, and confirm each hit against the stored string, so a digest
collision never decides.  Only suffixes of as many labels and characters, and
prefixes of the lengths, that some rule has are probed, so a url of any length
costs bounded memory.

A rule fits its host and all subdomains when the url's path starts with the
rule's path.  The longest fitting rule in characters wins; of two that are
equally long, the one with the longer host.

Defined cases: a null ``page_id`` stays null; an empty table gives no rows; other
columns are ignored; null urls and urls without ``://`` have empty host and path and
get the default verdict ``allow`` with a null rule; an empty rule list leaves
everything allowed; duplicate rules count once, the last one's verdict holds.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import shared

DEFAULT = "allow"
_HEAD = struct.Struct("<4sQQQQ")
#: Urls that are probed together.
ROWS = 2048
_SPLIT = re.compile(r"[/?#]")
_PATH_END = re.compile(r"[?#]")
_UPPER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lowered) and path of a url."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    m = _SPLIT.search(rest)
    if not m:
        return rest.translate(_UPPER), ""
    return rest[: m.start()].translate(_UPPER), _PATH_END.split(rest[m.start() :], maxsplit=1)[0]


def write_index(path: str, rules: list[tuple[str, str, str]]) -> None:
    """Write the digest array: header, keys, string offsets, verdict bytes, path
    lengths and strings.  The driver writes it before any task starts."""
    verdicts = {(h.translate(_UPPER), p): v for h, p, v in rules}
    rows = sorted((xxhash.xxh64_intdigest(f"{h}\0{p}".encode()), f"{h}\0{p}".encode(), v) for (h, p), v in verdicts.items())
    keys = np.array([r[0] for r in rows], np.uint64)
    offsets = np.cumsum([0] + [len(r[1]) for r in rows]).astype(np.uint64)
    lengths = np.unique(np.array([len(p) for _, p in verdicts], np.uint64))
    block = np.array([r[2] == "block" for r in rows], np.uint8).tobytes()
    labels = max((h.count(".") + 1 for h, _ in verdicts), default=0)
    longest = max((len(h) for h, _ in verdicts), default=0)
    fs, where = shared.filesystem(path)
    fs.create_dir(where.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(where) as out:
        out.write(_HEAD.pack(b"URL2", len(rows), len(lengths), labels, longest))
        for a in (keys.tobytes(), offsets.tobytes(), lengths.tobytes(), block, b"".join(r[1] for r in rows)):
            out.write(a)


class Index:
    """Read side; local files are memory-mapped and shared by all workers."""

    def __init__(self, path: str):
        fs, where = shared.filesystem(path)
        if fs.type_name == "local":
            raw = np.memmap(where, np.uint8, mode="r")
        else:
            with fs.open_input_file(where) as f:
                raw = np.frombuffer(f.read(), np.uint8)
        _, n, m, self.labels, self.longest = _HEAD.unpack(raw[: _HEAD.size].tobytes())
        at = _HEAD.size
        self.keys = raw[at : at + 8 * n].view(np.uint64)
        self.offsets = raw[at + 8 * n : at + 16 * n + 8].view(np.uint64)
        at += 16 * n + 8
        self.lengths = [int(x) for x in raw[at : at + 8 * m].view(np.uint64)]
        self.block = raw[at + 8 * m : at + 8 * m + n]
        self.strings = raw[at + 8 * m + n :]

    def probe(self, candidates: list[bytes]) -> np.ndarray:
        """Rule number of each candidate, or -1."""
        out = np.full(len(candidates), -1, np.int64)
        if not len(self.keys) or not candidates:
            return out
        digest = np.fromiter(map(xxhash.xxh64_intdigest, candidates), np.uint64, len(candidates))
        low = np.searchsorted(self.keys, digest, "left")
        high = np.searchsorted(self.keys, digest, "right")
        for k in np.flatnonzero(high > low):
            for r in range(low[k], high[k]):
                if self.strings[int(self.offsets[r]) : int(self.offsets[r + 1])].tobytes() == candidates[k]:
                    out[k] = r
                    break
        return out


def candidates(host: str, path: str, index: Index):
    """(host suffix, path prefix) pairs that a rule could have."""
    last = host.rsplit(".", index.labels) if index.labels else []
    for k in range(1, min(len(last), index.labels) + 1):
        suffix = ".".join(last[-k:])
        if len(suffix) > index.longest:
            return
        yield from ((suffix, path[:n]) for n in index.lengths if n <= len(path))


def _judged(index: Index, urls: pa.Array):
    """host, path, rule and verdict of each url."""
    parts = [split_url(u.as_py()) for u in urls]
    pairs, owner = [], []
    for k, (h, p) in enumerate(parts):
        for pair in candidates(h, p, index) if h else ():
            pairs.append(pair)
            owner.append(k)
    hits = index.probe([f"{h}\0{p}".encode() for h, p in pairs])
    best: dict[int, tuple] = {}
    for i in np.flatnonzero(hits >= 0).tolist():
        h, p = pairs[i]
        best[owner[i]] = max(best.get(owner[i], (-1,)), (len(h) + len(p), len(h), h + p, bool(index.block[hits[i]])))
    rule = [best[k][2] if k in best else None for k in range(len(parts))]
    verdict = [("block" if best[k][3] else "allow") if k in best else DEFAULT for k in range(len(parts))]
    return [pa.array(c, pa.string()) for c in ([h for h, _ in parts], [p for _, p in parts], rule, verdict)]


def judge(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row of ``pages``."""
    where = shared.fresh_dir(pages.sparkSession, "url-index") + "/rules.idx"
    write_index(where, rules)

    def run(batches):
        index = Index(where)
        for b in batches:
            for s in range(0, b.num_rows, ROWS):
                part = b.slice(s, ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), *_judged(index, part.column(1))], ["page_id", "host", "path", "rule", "verdict"])

    schema = "page_id long, host string, path string, rule string, verdict string"
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string")).mapInArrow(run, schema)
