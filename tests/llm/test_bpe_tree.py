"""The tree is the way that ids are made, and odd pieces equal the library's."""

import base64
import collections

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from docloom.llm import bpe_tree


@pytest.fixture(scope="module")
def ranks():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@pytest.fixture(scope="module")
def lib(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_every_piece_of_several_tokens_is_joined(ranks, texts_of, monkeypatch):
    tree = bpe_tree.Tree(ranks, public_tokenizers.PATTERN)
    seen = collections.Counter()
    join = tree.join

    def counted(left, right):
        out = join(left, right)
        seen[b"".join(map(tree.bytes_of.__getitem__, out))] += 1
        return out

    tree.join = counted
    several = {p for t in texts_of for p in tree.pieces(t) if len(np.frombuffer(tree.encode(p), "<u4")) > 1}
    assert len(several) > 100 and all(seen[p.encode()] for p in several)


def test_windows_grow_until_stable(ranks, lib):
    """Joins of any two neighbours give the encoding of both."""
    tree = bpe_tree.Tree(ranks, public_tokenizers.PATTERN)
    rng = np.random.default_rng(2)
    for letters in (b"ab", b"thein", b" \n", b"a", b"=-", "éß日".encode()):
        for _ in range(60):
            x = bytes(rng.choice(list(letters), rng.integers(2, 200)).tolist())
            k = int(rng.integers(1, len(x)))
            assert tree.join(tree.merge(x[:k]), tree.merge(x[k:])) == tree.merge(x) == tree.tree(x) == lib._encode_single_piece(x)


def test_long_pieces_and_texts(ranks, lib):
    tree = bpe_tree.Tree(ranks, public_tokenizers.PATTERN)
    for x in ("a" * 9000, "Supercalifragilistic" * 400, "word " * 30_000, "日本語" * 3000, "x1y2\n\n" * 9000):
        ids = tree.encode(x)
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode_ordinary(x) and tree.decode(ids).decode() == x
    assert tree.encode(None) == tree.encode("") == b"" == tree.decode(b"")


@pytest.fixture(scope="module")
def texts_of(spark, sf):
    return [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
