import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscore.llm import edits as E
from folioscore.llm.words import load_tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["'", "'s", "'re", "'ll", "e", "abc", " word", " Zé", "9", "12", "²", " ", "  ", "\n", " \n", "\t", "!", "?!", "<|endoftext|>", "<|endof", "text|>", "<|", "日本", "😀", "̃", "don't", "'LL"]


def n_tokens(text):
    return len(load_tokenizer(PATH).encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("chunk", [2, 256])
def test_every_edit_counts_as_encoding_anew(seed, chunk, monkeypatch):
    monkeypatch.setattr(E, "CHUNK", chunk)
    rnd = random.Random(seed)
    some = lambda n: "".join(rnd.choice(PARTS) for _ in range(rnd.randrange(n)))
    counter = E.Counter(PATH)
    for _ in range(25):
        text = some(60)
        tree = E.SumTree.of(counter.leaves(pa.array([text]))[0])
        for _ in range(12):
            start, length, put = rnd.randrange(-2, len(text) + 3), rnd.randrange(-1, 9), some(4)
            a = min(max(0, start), len(text))
            want = text[:a] + put + text[min(len(text), a + max(0, length)) :]
            text, _ = counter.apply(tree, text, start, length, put)
            assert text == want
            assert tree.total[1] == n_tokens(text) and tree.total[0] == len(text), (text, start, length, put)
            assert np.array_equal(tree.leaves(), counter.leaves(pa.array([text]))[0])


def test_long_text_is_mostly_left_alone():
    text = "The quick brown fox jumps over the lazy dog. " * 3000
    counter = E.Counter(PATH)
    tree = E.SumTree.of(counter.leaves(pa.array([text]))[0])
    text, again = counter.apply(tree, text, 60_000, 7, "slow")
    assert again < 200 and tree.total[1] == n_tokens(text)


ROWS = [(1, "some text", [(0, 4, "Any")]), (2, None, [(0, 5, "new")]), (3, "", None), (None, "a b", [(1, None, None), (None, 1, "x"), None, (99, 1, " end")]), (1, "some text", [(0, 4, "Any")]), (5, "w " * 40_000, [])]


def test_frame(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], f"doc_id long, text string, edits {E.EDITS}, n_tokens string")
    state = E.trees(df, PATH)
    assert {r["doc_id"]: E.SumTree.load(r["tree"]).leaves()[:, 0].tolist() for r in state.collect()}[1] == [4, 5]
    todo = {str((d, t or "")): e for d, t, e in ROWS}
    pairs = spark.createDataFrame([(k, e) for k, e in todo.items()], f"k string, edits {E.EDITS}")
    key = F.concat_ws("", F.lit("("), F.coalesce(F.col("doc_id").cast("string"), F.lit("None")), F.lit(", '"), "text", F.lit("')"))
    got = [tuple(r) for r in E.apply_edits(state.join(pairs, key == F.col("k"), "left"), PATH).select("doc_id", "tokens_before", "n_tokens", "n_edits", "text").collect()]
    want = [(1, "some text", "Any text", 1), (2, "", "new", 1), (3, "", "", 0), (None, "a b", "a b end", 2), (1, "some text", "Any text", 1), (5, "w " * 40_000, "w " * 40_000, 0)]
    assert sorted(got, key=str) == sorted([(d, n_tokens(a), n_tokens(b), n, b) for d, a, b, n in want], key=str)
    assert E.trees(df.limit(0), PATH).count() == 0 and E.apply_edits(state.limit(0).join(pairs, F.lit(False)), PATH).count() == 0


def test_rounds_go_on_from_the_state(spark, monkeypatch):
    """Two rounds of edits through a written state: counts are those of the whole texts, and
    no round but the first encodes more than regions around edits."""
    from folioscore.llm.common import staged

    rnd = random.Random(3)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randrange(3000))) for _ in range(12)] + [None, "The quick brown fox. " * 4000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    state, now = staged(E.trees(df, PATH), "state"), [t or "" for t in texts]
    for turn in range(2):
        edits = []
        for i, t in enumerate(now):
            own = []
            for _ in range(6):
                a, n, put = rnd.randrange(len(t) + 1), rnd.randrange(9), "".join(rnd.choice(PARTS) for _ in range(3))
                own.append((a, n, put))
                t = t[:a] + put + t[a + n :]
            now[i] = t
            edits.append((i, own))
        after = E.apply_edits(state.join(spark.createDataFrame(edits, f"doc_id long, edits {E.EDITS}"), "doc_id"), PATH)
        state = staged(after, "state")
        for r in state.collect():
            tree = E.SumTree.load(r["tree"])
            assert r["text"] == now[r["doc_id"]] and r["n_tokens"] == n_tokens(r["text"]) == tree.total[1] == tree.leaves()[:, 1].sum()
            assert tree.total[0] == len(r["text"]) and (tree.sums[1 : tree.width] == tree.sums[2:].reshape(-1, 2, 2).sum(1)).all()
            assert r["doc_id"] < 13 or r["reencoded_chars"] < 2000  # the long text of plain words


def test_state_is_all_that_is_read(spark, monkeypatch):
    """Edits applied to a state never encode a whole text."""
    counter, seen = E.Counter(PATH), []
    text = "The quick brown fox jumps over the lazy dog. " * 3000
    tree = E.SumTree.load(E.SumTree.of(counter.leaves(pa.array([text]))[0]).dump())
    real = counter.region_leaves
    monkeypatch.setattr(counter, "leaves", None)
    monkeypatch.setattr(counter, "region_leaves", lambda x: seen.append(len(x)) or real(x))
    for _ in range(2):
        for at in (10, 60_000, 100_000):
            text, _ = counter.apply(tree, text, at, 7, "slow")
        tree = E.SumTree.load(tree.dump())
    assert sum(seen) < 2000 and tree.total[1] == n_tokens(text)


def test_query_against_encoding_anew(spark):
    from folioscore.llm.queries import op4_token_counts

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r for r in op4_token_counts(spark, sf).collect()}
    for r in docs.select("doc_id", "text", E.sample_edits(F.col("text"), F.col("doc_id")).alias("e")).collect():
        text = r["text"] or ""
        for e in r["e"]:
            text = text[: e["start"]] + e["text"] + text[e["start"] + e["length"] :]
        assert got[r["doc_id"]]["n_tokens"] == n_tokens(r["text"] or "") and got[r["doc_id"]]["edited_tokens"] == n_tokens(text)
