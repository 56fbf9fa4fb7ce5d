"""Hashing of many words side by side, against the library and word by word."""

import random

import numpy as np
import xxhash

from docloom.llm import shared, toxicity
from tests.llm.test_classifiers import toxic_rows

SIGNS = ["ab", "thein.,!", "éèüß", "日本語", "a😀é", "\x00\x01a", "***$$", "\ud800a", "�"]


def odd_words():
    rng = random.Random(6)
    words = ["".join(rng.choice(s) for _ in range(n)).encode("utf-8", "surrogatepass") for s in SIGNS for n in range(1, 45)]
    return [b"", b".", b"...", b"\xff", b"a\xc3", b"\x80abc\xc3\xa9", *words]


def test_short_hashes_are_those_of_the_library():
    rng = np.random.default_rng(1)
    keys, size = rng.integers(0, 256, (500, 32), np.uint8), rng.integers(0, 32, 500)
    got = shared.short_hashes(keys, size)
    assert got.tolist() == [xxhash.xxh64_intdigest(k[:n].tobytes()) for k, n in zip(keys, size)]
    assert shared.short_hashes(keys[:0], size[:0]).tolist() == []


def test_many_words_get_the_buckets_of_each():
    for words in (odd_words(), [w for w in odd_words() if w.isascii()], [b""], [b"one"]):
        assert toxicity.padded(words).tolist() == [toxicity._padded(w) for w in words]


def test_words_of_many_texts_are_hashed_together(monkeypatch):
    """Texts with rare words cost one pass together, and long ones stay bounded."""
    model = toxicity.train(toxic_rows(60, np.random.default_rng(1)))
    texts = [[f"rare{k}".encode(), b"very", f"other{k}".encode()] for k in range(200)] + [[]]
    alone = [toxicity.Model(model.p, model.shifts, 1.0).logits([t])[0] for t in texts]
    sizes = []
    project = toxicity.Model._project
    monkeypatch.setattr(toxicity.Model, "_project", lambda self, words: sizes.append(len(words)) or project(self, words))
    assert model.logits(texts).tolist() == alone and sizes == [402]
    monkeypatch.setattr(toxicity, "STEP", 50)
    assert toxicity.Model(model.p, model.shifts, 1.0).logits(texts).tolist() == alone
    assert max(sizes[1:]) <= 2 * 50 + 2
