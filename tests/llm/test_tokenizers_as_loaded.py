"""Both tokenizers against their libraries, loaded anew from the files: added tokens, other files, long pieces, missing bytes."""

import json
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from cupola.llm import bpe, tokenfile

PARTS = ["<|startoftext|>", "<|endoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", "Word", "don't", "É", "é", " ", " ", "\n", "12", "!", ".", "中", "H̱"]


def test_added_tokens_are_found_as_the_library_does():
    library, own, rnd = Tokenizer.from_file(tokenfile.TOKENIZER), tokenfile.WordEncoder(), random.Random(3)
    assert own.by_words
    for _ in range(3000):
        text = "".join(rnd.choices(PARTS, k=rnd.randint(0, 12)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_other_tokenizer_files_encode_whole_texts(tmp_path):
    made = json.loads(Tokenizer.from_file(tokenfile.TOKENIZER).to_str())
    made["normalizer"] = {"type": "NFC"}
    path = str(tmp_path / "other.json")
    with open(path, "w") as f:
        json.dump(made, f)
    own, library = tokenfile.WordEncoder(path), Tokenizer.from_file(path)
    assert not own.by_words
    for text in ("Two  Words, with CAPITALS\n and more", "", "<|endoftext|> x"):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_long_pieces_and_missing_bytes():
    own, rnd = bpe.encoder(), random.Random(4)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    for text in ("ab" * 700, "".join(rnd.choices("abcdefgh", k=3000)), "é" * 900, " " * 2000, "ABCab" * 300):
        assert own.encode(text).tolist() == library.encode_ordinary(text)
    small = bpe.PrefixBpe({bytes([c]): i for i, c in enumerate(b"abc")})
    for n in (3, 600):
        with pytest.raises(ValueError, match="no token"):
            small.encode_piece(b"ab" + b"z" * n)
