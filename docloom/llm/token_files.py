"""Token-id output: flat unsigned files with 64-bit document offsets.

Documents are range-partitioned by ``doc_id`` and sorted, so shard k holds
lower ids than shard k+1.  There are as many shards as hold about ``SHARD`` bytes
of text each, and as many as the cluster has cores at least.  A shard is a file
of flat little-endian unsigned ids (``.bin``: 16 bits, or 32 bits where the
vocabulary has more than 65,536 ids) and one of unsigned 64-bit numbers
(``.idx``: for each document its id, whether it has one, and its start inside
the shard, then the end).  Tasks write to names of their own and report them;
only the names that finished tasks reported enter ``manifest.json``, so retried
or doubled tasks do no harm on any store, and files of others are deleted.  Only
one row per shard (its counts) reaches the driver, where prefix sums give the
base of each shard.  Readers memory-map local files and read ranges of files in
other stores.

Encoding splits at white space first and asks the tokenizers library once per
distinct word (bounded memo).  This holds for vocabularies whose normalizer and
pre-tokenizer are those of ``BY_WORDS``; texts for any other, texts with
separators that the two kinds of white space disagree on, and texts with the
literal of an added token (which the library gives its own id, as by default)
go to the library whole.

Defined cases: null text is empty and gets only the end id; null ``doc_id`` sorts
first; rows of equal ``doc_id`` are ordered by text; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import shared

#: Bytes of text of a shard, about, and ids that a reader holds at once.
SHARD, HELD = 128 << 20, 1 << 22
#: Kinds of normalizers, and the split of the pre-tokenizer, under
#: which words are encoded alone.
BY_WORDS = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters that the word split and the pre-tokenizer's white space may treat
#: differently.
ODD = "[\\x{1c}-\\x{1f}\\x{85}\\x{180e}\\x{200b}-\\x{200f}\\x{2028}-\\x{202f}\\x{2060}\\x{feff}\\x{130}]"
_memo: dict[str, "Encoder"] = {}
#: Lower-case letters that lower and normalise alone, whatever stands beside them.
PLAIN = "^[a-zß-öø-ɏ]+$"
#: Texts of a slice that is encoded together.
TEXTS = 4096
#: Marks that the pre-tokenizer cuts off a word as one piece (no apostrophe).
MARKS = '.,;:!?"()[]{}*#$%&|/-_+=<>@~^'
GROUP = 256
#: Words that a worker's memo holds at most.
LIMIT = 600_000


def by_words(vocabulary: str) -> bool:
    """Whether the vocabulary's words are encoded alike wherever they stand."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps, splits = norm.get("normalizers", [norm]), pre.get("pretokenizers", [pre])
    kinds = [x.get("type") for x in steps]
    white = [x.get("pattern") for x in steps if x.get("type") == "Replace"]
    cut = splits[0].get("pattern") == {"Regex": _SPLIT} and splits[0].get("behavior") == "Removed" and splits[0].get("invert")
    rest = [(x.get("type"), x.get("add_prefix_space"), x.get("use_regex")) for x in splits[1:]]
    return kinds == BY_WORDS and white == [{"Regex": r"\s+"}] and bool(cut) and rest == [("ByteLevel", False, False)] and not spec.get("truncation") and not spec.get("padding")


class Encoder:
    """Ids of whole texts as little-endian bytes of type ``kind``."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(vocabulary)
        added = [re.escape(t.content) for t in self.lib.get_added_tokens_decoder().values()]
        self.odd = "|".join([ODD, *added]) if by_words(vocabulary) else ""
        self.kind = "<u2" if self.lib.get_vocab_size() <= 1 << 16 else "<u4"
        self.words: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _learn(self, cores: list[str]) -> None:
        """Encode new runs of plain letters, which the pre-tokenizer keeps in
        one piece, in few calls of many words."""
        for k in range(0, len(cores), GROUP):
            group = cores[k : k + GROUP]
            got = self.lib.encode(" ".join(group), add_special_tokens=False)
            ids = np.array(got.ids, self.kind)
            cut = np.searchsorted(np.array(got.word_ids), np.arange(len(group) + 1))
            self.words.update((w, ids[s:e].tobytes()) for w, s, e in zip(group, cut[:-1], cut[1:]))

    def _distinct(self, words: pa.Array) -> list[bytes]:
        """Ids of each of the distinct words of a slice."""
        low = pc.utf8_lower(words)
        core = pc.utf8_rtrim(low, characters=MARKS)
        plain = pc.match_substring_regex(core, PLAIN).to_numpy(zero_copy_only=False).tolist()
        lows, cores = low.to_numpy(zero_copy_only=False).tolist(), core.to_numpy(zero_copy_only=False).tolist()
        memo = self.words
        if len(memo) + 2 * len(lows) > LIMIT:
            memo.clear()
        memo[""] = b""
        self._learn(list({c for c, p in zip(cores, plain) if p} - memo.keys()))
        out = []
        for raw, l, c, p in zip(words.to_numpy(zero_copy_only=False).tolist(), lows, cores, plain):
            if not p:
                c, l = raw, raw
                if c not in memo:
                    memo[c] = self._whole(c)
            data = memo[c]
            if len(l) > len(c):
                tail = l[len(c) :]
                if tail not in memo:
                    memo[tail] = self._whole(tail)
                data += memo[tail]
            out.append(data)
        return out

    def many(self, texts: pa.Array) -> list[bytes]:
        """Ids of whole texts, each as bytes."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, self.odd)
        lists = pc.utf8_split_whitespace(pc.if_else(odd, "", texts))
        coded = lists.flatten().dictionary_encode()
        pieces = self._distinct(coded.dictionary)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces)) // np.dtype(self.kind).itemsize
        pool, first = np.frombuffer(b"".join(pieces), self.kind), np.cumsum(size) - size
        code = coded.indices.to_numpy()
        n = size[code]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = pool[np.repeat(first[code] - ends[:-1], n) + np.arange(ends[-1])]
        cut = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return [self._whole(t.as_py()) if o else ids[s:e].tobytes() for t, o, s, e in zip(texts, odd.to_numpy(zero_copy_only=False).tolist(), cut[:-1].tolist(), cut[1:].tolist())]


def _encoder(vocabulary: str) -> Encoder:
    if vocabulary not in _memo:
        _memo[vocabulary] = Encoder(vocabulary)
    return _memo[vocabulary]


def write(docs: DataFrame, vocabulary: str, end_id: int, root: str) -> list[dict]:
    """Encode ``docs(doc_id, text)`` into shards under ``root``; returns the
    manifest: per shard its file name, documents, ids and base (ids before it)."""

    def run(batches):
        from pyspark import TaskContext

        k = TaskContext.get().partitionId()
        encode = _encoder(vocabulary)
        end = np.array([end_id], encode.kind).tobytes()
        width = len(end)
        fs, where = shared.filesystem(root)
        ids, sizes = [], []
        name = f"shard-{k:06d}-{uuid.uuid4().hex}"
        out = None
        for b in batches:
            for s in range(0, b.num_rows, TEXTS):
                part = b.slice(s, TEXTS)
                if out is None:
                    fs.create_dir(where, recursive=True)
                    out = fs.open_output_stream(f"{where}/{name}.bin")
                data = encode.many(part.column(1))
                for d in data:
                    out.write(d + end)
                ids.append(part.column(0))
                sizes.append(np.fromiter(map(len, data), np.int64, len(data)) // width + 1)
        if out is None:
            return
        out.close()
        ids, starts = pa.concat_arrays(ids), np.append(0, np.cumsum(np.concatenate(sizes)))
        with fs.open_output_stream(f"{where}/{name}.idx") as f:
            f.write(np.array([len(ids)], "<u8").tobytes())
            f.write(ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            f.write(ids.is_valid().to_numpy(zero_copy_only=False).astype("<u8").tobytes())
            f.write(starts.astype("<u8").tobytes())
        yield pa.RecordBatch.from_pydict({"shard": [k], "name": [name], "n_docs": [len(ids)], "n_ids": [int(starts[-1])]})

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    n = max(spark.sparkContext.defaultParallelism, -(-size // SHARD))
    dealt = rows.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    counts = dealt.mapInArrow(run, "shard long, name string, n_docs long, n_ids long").collect()
    base, manifest = 0, []
    for r in sorted(counts):
        manifest.append({"name": r.name, "n_docs": r.n_docs, "n_ids": r.n_ids, "base": base})
        base += r.n_ids
    fs, where = shared.filesystem(root)
    fs.create_dir(where, recursive=True)
    known = {m["name"] for m in manifest}
    for x in fs.get_file_info(FileSelector(where)):
        if x.base_name.rsplit(".", 1)[0] not in known:
            fs.delete_file(x.path)  # of a task that did not finish
    with fs.open_output_stream(f"{where}/manifest.json") as f:
        f.write(json.dumps({"dtype": _encoder(vocabulary).kind, "end_id": end_id, "shards": manifest}).encode())
    return manifest


def dtype_of(root: str) -> str:
    fs, where = shared.filesystem(root)
    with fs.open_input_file(f"{where}/manifest.json") as f:
        return json.loads(f.read())["dtype"]


class Shard:
    """Read side of a shard: ``docs`` (ids), ``starts``, and ranges of ids."""

    def __init__(self, root: str, name: str, kind: str):
        fs, where = shared.filesystem(root)
        self.kind, self.width = kind, np.dtype(kind).itemsize
        if fs.type_name == "local":
            index = np.memmap(f"{where}/{name}.idx", "<u8", mode="r")
            self.flat = np.memmap(f"{where}/{name}.bin", kind, mode="r")
        else:
            with fs.open_input_file(f"{where}/{name}.idx") as f:
                index = np.frombuffer(f.read(), "<u8")
            self.flat, self.file = None, fs.open_input_file(f"{where}/{name}.bin")
        n = int(index[0])
        self.docs = pa.array(np.array(index[1 : 1 + n].view("<i8")), pa.int64(), mask=np.array(index[1 + n : 1 + 2 * n] == 0))
        self.starts = np.array(index[1 + 2 * n :], np.int64)

    def ids(self, lo: int, hi: int) -> np.ndarray:
        if self.flat is not None:
            return self.flat[lo:hi]
        return np.frombuffer(self.file.read_at((hi - lo) * self.width, lo * self.width), self.kind)

    def groups(self):
        """Runs of documents [i, j) of about HELD ids at most."""
        i, n = 0, len(self.docs)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + HELD, "right")) - 1)
            yield i, min(j, n)
            i = j


def read(spark: SparkSession, root: str, manifest: list[dict]) -> DataFrame:
    """Per document from the files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches):
        kind = dtype_of(root)
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                shard = Shard(root, name, kind)
                for i, j in shard.groups():
                    cuts = shard.starts[i : j + 1]
                    ids = shard.ids(int(cuts[0]), int(cuts[-1]))
                    crc = [zlib.crc32(ids[s:e].astype("<u4").tobytes()) for s, e in zip((cuts[:-1] - cuts[0]).tolist(), (cuts[1:] - cuts[0]).tolist())]
                    yield pa.RecordBatch.from_arrays([shard.docs[i:j], pa.array(cuts[:-1] + base), pa.array(np.diff(cuts)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = [(m["name"], m["base"]) for m in manifest]
    shards = spark.createDataFrame(rows, "name string, base long").repartition(max(1, len(rows)))
    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    root = shared.fresh_dir(docs.sparkSession, "tokens")
    return read(docs.sparkSession, root, write(docs, vocabulary, end_id, root))
