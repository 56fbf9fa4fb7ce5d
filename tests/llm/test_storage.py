"""Files of tokens and rules on any store; folders that come and go."""

import json
import os

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from tokenizers import Tokenizer

from docloom.llm import shared, token_files, url_filter

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def test_filesystems(monkeypatch):
    asked = []
    for path, inner in (("/a/b", "/a/b"), ("file:/a/b", "/a/b"), ("file:///a/b", "/a/b"), ("FILE:///a", "/a")):
        fs, where = shared.filesystem(path)
        assert fs.type_name == "local" and where == inner

    class Any:
        @staticmethod
        def from_uri(uri):
            asked.append(uri)
            return None, uri

    monkeypatch.setattr(shared, "pafs", type("m", (), {"FileSystem": Any, "LocalFileSystem": pafs.LocalFileSystem}))
    for path in ("s3a://b/x", "hdfs://h:1/x", "viewfs://c/x", "gs://b/x"):
        shared.filesystem(path)
    assert asked == ["s3://b/x", "hdfs://h:1/x", "viewfs://c/x", "gs://b/x"]


def test_a_cluster_needs_a_shared_folder():
    class Session:
        conf = type("c", (), {"get": staticmethod(lambda k, d: d)})
        sparkContext = type("s", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_root(Session)


def test_scratch_deletes_what_was_made_inside(spark):
    before = shared.materialize(spark.range(3), "kept")
    with shared.scratch(spark):
        path = shared.materialize(spark.range(3), "gone")._docloom_path
        assert shared.exists(spark, path)
    assert not shared.exists(spark, path) and before.count() == 3
    shared.discard(before)
    assert not shared.exists(spark, before._docloom_path)


class Remote:
    """A store that cannot be memory-mapped."""

    type_name = "remote"

    def __init__(self):
        self.local = pafs.LocalFileSystem()

    def __getattr__(self, name):
        return getattr(self.local, name)


def test_shards_by_size_and_read_by_range(spark, tmp_path, monkeypatch):
    rows = [(i if i % 5 else None, None if i % 7 == 0 else f"some words of text {i} <|endoftext|> " * (i % 4)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(token_files, "SHARD", 500)
    root = str(tmp_path / "t")
    os.makedirs(root)
    (tmp_path / "t/shard-000000-left.bin").write_bytes(b"of a lost task")
    manifest = token_files.write(docs, VOCABULARY, 1, root)
    assert len(manifest) > 8 and sorted(os.listdir(root)) == sorted([m["name"] + x for m in manifest for x in (".bin", ".idx")] + ["manifest.json"])
    saved = json.loads((tmp_path / "t/manifest.json").read_text())
    assert saved["shards"] == manifest and [m["base"] for m in manifest] == np.cumsum([0] + [m["n_ids"] for m in manifest])[:-1].tolist()
    got = token_files.read(spark, root, manifest).collect()
    assert len(got) == 60 and sorted(r.start for r in got)[0] == 0
    lib = Tokenizer.from_file(VOCABULARY)
    want = sorted(((i, lib.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0))
    assert sorted(r.n_tokens for r in got) == sorted(len(x) for _, x in want)
    monkeypatch.setattr(shared, "filesystem", lambda p: (Remote(), p))
    monkeypatch.setattr(token_files, "HELD", 9)
    kind = token_files.dtype_of(root)
    far = [token_files.Shard(root, m["name"], kind) for m in manifest]
    flat = [(d, s.ids(int(s.starts[k]), int(s.starts[k + 1])).tolist()) for s in far for k, d in enumerate(s.docs.to_pylist())]
    assert [d for d, _ in flat] == [i for i, _ in want] and sorted(map(str, flat)) == sorted(map(str, want))
    assert all([x for i, j in s.groups() for x in range(i, j)] == list(range(len(s.docs))) for s in far)


def test_other_vocabularies_go_to_the_library_whole():
    assert token_files.by_words(VOCABULARY) and not token_files.by_words(public_tokenizers.path("byte_bpe_50k.json"))
    path = public_tokenizers.path("byte_bpe_50k.json")
    xs = ["Hello  world, it's Monday", " a\n\nb ", "", "<|endoftext|>x"]
    e, lib = token_files.Encoder(path), Tokenizer.from_file(path)
    assert [np.frombuffer(b, e.kind).tolist() for b in e.many(pa.array(xs))] == [lib.encode(x, add_special_tokens=False).ids for x in xs]


def test_very_long_urls_cost_little(spark):
    rules = [("b.com", "/", "allow"), ("com", "/ab", "block"), ("é.com", "/", "block"), ("com", "/abc", "allow")]
    long = ".".join(["x"] * 20_000)
    rows = [(1, f"http://{long}.b.com/ab"), (2, "http://" + "y" * 200_000 + "/z"), (3, "http://é.com/ab"), (4, "http://b.com/abcd"), (None, "http://b.com/")]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "page_id long, url string, rule string, verdict int")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(df, rules).collect()}
    assert got == {1: ("b.com/", "allow"), 2: (None, "allow"), 3: ("é.com/", "block"), 4: ("com/abc", "allow"), None: ("b.com/", "allow")}
    assert url_filter.judge(df.where("false"), rules).collect() == []
    import tracemalloc

    path = shared.fresh_dir(spark, "urls") + "/r.idx"
    url_filter.write_index(path, rules)
    index = url_filter.Index(path)
    tracemalloc.start()
    url_filter._judged(index, pa.array(["http://" + ".".join(["x"] * 100_000) + "/ab"]))
    assert tracemalloc.get_traced_memory()[1] < 30 << 20
    tracemalloc.stop()
