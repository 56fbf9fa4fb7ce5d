"""Added tokens keep the ids that the library gives them by default."""

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from docloom.llm import token_files


def test_added_tokens_get_their_own_ids():
    path = public_tokenizers.path("word_bpe_49k.json")
    lib, e = Tokenizer.from_file(path), token_files.Encoder(path)
    xs = ["a <|endoftext|> b", "a<|startoftext|>b c", "<|ENDOFTEXT|> a", "a <| endoftext|>", "plain text", "<|endoftext|>"]
    for x, got in zip(xs, e.many(pa.array(xs)), strict=True):
        assert np.frombuffer(got, e.kind).tolist() == lib.encode(x, add_special_tokens=False).ids, x
    assert np.frombuffer(e.many(pa.array(xs[:1]))[0], e.kind).tolist() == [320, 49407, 321]
