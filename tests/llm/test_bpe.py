import hashlib

import public_tokenizers
import pytest

from folioscore.llm import bpe
from folioscore.llm.words import load_tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["It's a test, it's a test", None, "", "Zürich 日本 😀 <|endoftext|> x", "word " * 20_000, "\n\n tail \t ", "a\x00b", "It's a test, it's a test"]


def library(text):
    tok = load_tokenizer(PATH)
    ids = tok.encode(text or "", add_special_tokens=False).ids
    return ids, tok.decode(ids, skip_special_tokens=False)


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i if i != 6 else None, t, "x", "y") for i, t in enumerate(TEXTS)], "doc_id long, text string, word string, block string").repartition(3)


def test_as_the_library(docs):
    got = bpe.encode_decode(docs, PATH)
    assert sorted((str(r["doc_id"]), r["ids"], r["decoded"]) for r in got.collect()) == sorted((str(i if i != 6 else None), *library(t)) for i, t in enumerate(TEXTS))


def test_blocks_dealt_anew_give_the_same(docs):
    folder = bpe.write_dictionaries(docs.limit(2), PATH)
    got = bpe.lay_out(docs.repartition(2), PATH, folder).cache()
    assert got.agg({"in_place": "sum"}).collect()[0][0] > 0
    assert sorted((r["ids"], r["decoded"]) for r in got.collect()) == sorted(library(t) for t in TEXTS)


def test_many_rounds_and_small_batches(docs, monkeypatch, spark):
    monkeypatch.setattr(bpe, "BLOCK_WORDS", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = bpe.encode_decode(docs, PATH)
        assert sorted((r["ids"], r["decoded"]) for r in got.collect()) == sorted(library(t) for t in TEXTS)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_table(spark):
    assert bpe.encode_decode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_query_digests(spark, tmp_path, docs):
    from folioscore.llm.queries import op2_bpe_encode_decode

    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op2_bpe_encode_decode(spark, str(tmp_path)).collect()}
    for i in (0, 1, 3):
        ids, text = library(TEXTS[i])
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert all(r["in_place"] == 0 for r in got.values())
