import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from folioscore.llm import token_files as T
from folioscore.llm.words import load_tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, path string, n_tokens string"


def expected(rows):
    tok, start, out = load_tokenizer(PATH), 0, []
    for doc_id, text in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip_in_order(spark):
    rows = [(7, "It's a test"), (3, None), (5, ""), (-2, "Zürich <|endoftext|> x"), (9, "word " * 30_000), (4, "  \n tail ")]
    df = spark.createDataFrame([(a, b, "x", "y") for a, b in rows], SCHEMA)
    out = T.write_token_files(df, PATH)
    got = T.read_in_order(spark, out)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == sorted(expected(sorted(rows)))
    ids = {r["doc_id"]: r["ids"] for r in T.read_in_order(spark, out, with_ids=True).collect()}
    assert ids[3] == [0] and load_tokenizer(PATH).decode(ids[7][:-1]) == "It's a test"
    shuffled = T.read_shuffled(spark, out, seed=4).collect()
    assert {r["doc_id"]: r["ids"] for r in shuffled} == ids
    assert [r["doc_id"] for r in shuffled] == [r["doc_id"] for r in T.read_shuffled(spark, out, seed=4).collect()]


def test_equal_and_null_ids(spark):
    rows = [(1, "b"), (1, "a"), (1, "a"), (None, "last"), (0, "first")]
    out = T.write_token_files(spark.createDataFrame([(a, b, "", "") for a, b in rows], SCHEMA), PATH)
    got = sorted(T.read_in_order(spark, out).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [0, 1, 1, 1, None]
    assert [r["start"] for r in got] == list(np.cumsum([0] + [r["n_tokens"] for r in got])[:-1])


def test_empty_table(spark):
    out = T.write_token_files(spark.createDataFrame([], SCHEMA), PATH)
    assert T.read_in_order(spark, out).count() == 0 and T.read_shuffled(spark, out).count() == 0


def test_damage_is_found():
    whole = T.frame(T.pack_sequence(1, np.array([1, 2, 3], "<u2"))) + T.frame(b"")
    assert len(list(T.read_frames(pa.BufferReader(whole)))) == 2
    for k in (2, 9, 14, 25):
        bad = bytearray(whole)
        bad[k] ^= 1
        with pytest.raises(ValueError):
            list(T.read_frames(pa.BufferReader(bytes(bad))))
    with pytest.raises(ValueError):
        list(T.read_frames(pa.BufferReader(whole[:-3])))
