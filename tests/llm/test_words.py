import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from folioscore.llm import words as W

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["'", "'s", "'re", "'ll", "'d", "'v", "e", "a", "Zé", "ñ", "9", "²", " ", "  ", "\n", "\t", " ", "　", "!", "?!", "<|endoftext|>", "<|end", "日本", "😀", "́", "\r\n", "\x85", "​", "﻿", "_", "don't", "I'LL", "\x00"]


@pytest.mark.parametrize("seed", range(4))
def test_same_ids_as_the_library(seed):
    rnd = random.Random(seed)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randrange(0, 12))) for _ in range(3000)] + ["", None]
    enc = W.WordEncoder(PATH)
    ids, at = enc.encode(pa.array(texts, pa.string()))
    tok = W.load_tokenizer(PATH)
    for k, t in enumerate(texts):
        assert list(ids[at[k] : at[k + 1]]) == tok.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_words_are_the_library_cut():
    text = "Hello  world's\n\n it's 42 days!!  "
    got, first = W.split_words(pa.array([text]))
    want = [text[a:b].encode() for _, (a, b) in W.load_tokenizer(PATH).pre_tokenizer.pre_tokenize_str(text)]
    assert got.to_pylist() == want and list(first) == [0, len(want)]


def test_memory_turns_over(monkeypatch):
    monkeypatch.setattr(W, "MEMORY_WORDS", 5)
    enc = W.WordEncoder(PATH)
    texts = [" ".join(f"w{i + j}" for j in range(7)) for i in range(20)]
    for t in texts:
        ids, _ = enc.encode(pa.array([t]))
        assert list(ids) == W.load_tokenizer(PATH).encode(t, add_special_tokens=False).ids
    assert len(enc.young) + len(enc.old) < 60


def test_pieces_are_bytes():
    tok = W.load_tokenizer(PATH)
    text = "Ünïcode 日本 <|endoftext|>x"
    ids = tok.encode(text, add_special_tokens=False).ids
    assert b"".join(W.piece_bytes(tok.id_to_token(i)) for i in ids).decode() == text
    assert np.dtype("<u2") == W.WordEncoder(PATH).type
