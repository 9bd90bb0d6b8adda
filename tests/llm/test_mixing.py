import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscore.llm import mixing as M

SCHEMA = "doc_id long, source string, text string, size string, shard string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(0)
    out = [(i, ["a", "b", "B", "ç", None][min(4, int(rng.exponential(1.2)))], " ".join(["w"] * int(rng.integers(0, 900)))) for i in range(400)]
    return out + [(400, "a", None), (401, "a", " \n "), (None, "b", "x y z"), (402, "tiny", "one two"), (403, "b", "long " * 40_000)]


def test_targets_by_hand():
    # 100 words; weights 5, 2, 1: 62.5, 25, 12.5; 'b' is at most 3 * 2 = 6, the rest goes 5 : 1.
    got = M.targets([("c", 48), ("a", 50), ("b", 2)])
    assert got == {"a": 94 * 5 / 6, "b": 6.0, "c": 94 / 6}
    assert M.targets([("a", 0), ("b", 10)]) == {"a": 0.0, "b": 10.0}
    assert list(M.targets([(None, 5), ("b", 5)])) and M.targets([(None, 5), ("b", 5)])[None] == pytest.approx(10 * 2 / 7)


def test_split_tree_is_exact_and_without_replacement():
    quotas = np.array([1000, 7, 0, 333])
    out = M.split_tree(quotas, 13, 5)
    assert (out.sum(0) == quotas).all() and (out >= 0).all()
    assert out.sum(1).max() - out.sum(1).min() <= 4
    assert (out == M.split_tree(quotas, 13, 5)).all() and (out != M.split_tree(quotas, 13, 6)).any()
    first = np.array([M.split_tree(np.array([30, 70]), 2, s)[0, 0] for s in range(3000)])
    assert abs(first.mean() - 15) < 0.2 and abs(first.var() - 50 * 0.3 * 0.7 * 50 / 99) < 0.5


def test_contract(spark, rows):
    df = frame(spark, rows).repartition(5)
    mix = M.plan(df, shards=8, block_words=64)
    got = M.summary(mix).collect()
    assert len(got) == len(rows)
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[2] or "")) for r in rows}
    assert {r["doc_id"]: r["size"] for r in got} == size
    src = {r[0]: r[1] for r in rows}
    total, taken = Counter(), Counter()
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        total[src[r["doc_id"]]] += r["size"]
        taken[src[r["doc_id"]]] += r["taken"]
    aims = M.targets(list(total.items()))
    for r in got:
        s = src[r["doc_id"]]
        assert r["source_size"] == total[s] and r["target"] == pytest.approx(aims[s]) and abs(taken[s] - aims[s]) <= 64
    again = M.summary(M.plan(df.repartition(2), shards=8, block_words=64)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_shards_are_disjoint_and_even(spark, rows):
    mix = M.plan(frame(spark, rows), shards=8, block_words=64)
    taken = mix.taken.collect()
    keys = [(r["row"], r["block"], r["epoch"]) for r in taken]
    assert len(keys) == len(set(keys))
    per_shard = Counter(r["shard"] for r in taken)
    assert set(per_shard) == set(range(8)) and max(per_shard.values()) - min(per_shard.values()) <= 8


def test_mixed_texts(spark, rows):
    df = frame(spark, rows)
    mix = M.plan(df, shards=4, block_words=64, keep=True)
    out = M.mixed(mix, 64)
    assert set(df.columns) < set(out.columns)
    words, texts = Counter(), {r[0]: r[2] for r in rows}
    for r in out.collect():
        words[r["doc_id"]] += len(r["text"].split())
        if r["epoch"] == 0 and len(r["text"]) == len(texts[r["doc_id"]]):
            assert r["text"] == texts[r["doc_id"]]
    assert +words == +Counter({r["doc_id"]: r["taken"] for r in M.summary(mix).collect()})


def test_repeated_rows_and_empty(spark):
    two = [(1, "a", "x y z"), (1, "a", "x y z"), (2, "b", "p q r s")]
    got = M.summary(M.plan(frame(spark, two))).collect()
    assert len(got) == 3 and all(r["taken"] <= 3 * r["size"] for r in got)
    out = M.mixed(M.plan(frame(spark, two), block_words=1, keep=True), 1).collect()
    assert sum(len(r["text"].split()) for r in out) == sum(r["taken"] for r in M.summary(M.plan(frame(spark, two), block_words=1)).collect())
    assert M.summary(M.plan(frame(spark, []))).count() == 0
    blank = M.summary(M.plan(frame(spark, [(1, None, None), (2, "a", "")]))).select(F.sum("taken"), F.count("*")).collect()[0]
    assert tuple(blank) == (0, 2)


def test_mixed_rows_hold_the_quotas(spark, rows):
    """Blocks of each shard and source, counted in the texts of ``mixed``, are those of the tree."""
    marked = [(d, s, None if t is None else " ".join(f"b{i // 64}" for i, _ in enumerate(t.split()))) for d, s, t in rows]
    source = {r[0]: r[1] for r in marked}
    df = frame(spark, marked)
    mix = M.plan(df, shards=8, block_words=64, keep=True)
    got, drawn = Counter(), Counter()
    for r in M.mixed(mix, 64).collect():
        n = len(set(r["text"].split()))
        got[r["shard"], source[r["doc_id"]]] += n
        drawn[source[r["doc_id"]]] += n
    order = sorted(mix.targets, key=lambda s: (s is None, s or ""))
    tree = M.split_tree(np.array([drawn[s] for s in order]), 8, M.SEED)
    assert +got == +Counter({(i, s): int(tree[i, k]) for i in range(8) for k, s in enumerate(order)})


@pytest.mark.parametrize("partitions", ["4", "200"])
def test_stage_lays_rows_out_by_shard_and_place(spark, rows, partitions):
    import corpus_pipeline as C

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        df = frame(spark, rows).select("doc_id", "source", "text")
        got = [(r["doc_id"], r["text"]) for r in C.mix_sources(spark, df, "").collect()]
        want = sorted(M.mixed(M.plan(df, keep=True)).collect(), key=lambda r: (r["shard"], r["place"]))
        assert got == [(r["doc_id"], r["text"]) for r in want] and len({r["shard"] for r in want}) == M.SHARDS
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_the_tree_decides_what_is_taken(spark, rows, monkeypatch):
    """A tree that fills one shard only leaves the mix with that shard's words."""
    df, real = frame(spark, rows), M.split_tree
    every = M.summary(M.plan(df, shards=8, block_words=64)).agg(F.sum("taken")).collect()[0][0]
    monkeypatch.setattr(M, "split_tree", lambda q, n, s: real(q, n, s) * (np.arange(n) == 0)[:, None])
    mix = M.plan(df, shards=8, block_words=64)
    some = M.summary(mix).agg(F.sum("taken")).collect()[0][0]
    assert 0 < some < every / 4 and {r["shard"] for r in mix.taken.select("shard").distinct().collect()} == {0}
    monkeypatch.setattr(M, "split_tree", lambda q, n, s: real(q, n, s) * 0)
    assert M.summary(M.plan(df, shards=8, block_words=64)).agg(F.sum("taken")).collect()[0][0] == 0


def test_draws_beyond_the_librarys_range_follow_the_same_law():
    rng = np.random.default_rng(1)
    for good, bad, draw in ((30, 70, 50), (3, 500, 20), (400, 3, 390), (1, 1, 1), (5, 5, 10)):
        some = np.array([M._by_inversion(rng, good, bad, draw) for _ in range(20_000)])
        n = good + bad
        mean, var = draw * good / n, draw * good / n * bad / n * (n - draw) / max(1, n - 1)
        assert some.min() >= max(0, draw - bad) and some.max() <= min(good, draw)
        assert abs(some.mean() - mean) <= 5 * (var / 20_000) ** 0.5 + 1e-9 and abs(some.var() - var) <= 0.1 * var + 1e-9
    good, bad, draw = 3 * 10**10, 5 * 10**10, 4 * 10**10
    some = np.array([M._hypergeometric(rng, good, bad, draw) for _ in range(200)], float)
    var = draw * (3 / 8) * (5 / 8) / 2
    assert abs(some.mean() - 1.5 * 10**10) < 5 * (var / 200) ** 0.5 and 0.6 < some.var() / var < 1.5


def test_copies_and_blanks_in_any_number(spark):
    """One row thousands of times, and blank rows without an id, over many partitions."""
    many = [(1, "a", "x y z")] * 3000 + [(None, None, "")] * 3000 + [(2, "b", "p q r")]
    df = frame(spark, many).repartition(9)
    mix = M.plan(df, shards=4, block_words=2)
    got = M.summary(mix).collect()
    again = M.summary(M.plan(df.repartition(4), shards=4, block_words=2)).collect()
    assert len(got) == 6001 and sorted(map(str, got)) == sorted(map(str, again))
    rows = mix.sizes.filter("size > 0").groupBy("doc_id", "copy").count().filter("count > 1").count()
    assert rows == 0 and mix.sizes.agg(F.max("copy")).collect()[0][0] == 3000
    total = sum(r["taken"] for r in got if r["doc_id"] == 1)
    assert abs(total - next(r["target"] for r in got if r["doc_id"] == 1)) <= 2


def test_parts_are_the_words_of_their_blocks(spark):
    """Numbered words, any white space between them, a text of 300,000 words in many shards."""
    rng = np.random.default_rng(3)
    gaps = [" ", "  ", "\n", "\t \r\n"]
    text = lambda n: "".join(f"w{i}{gaps[int(rng.integers(4))]}" for i in range(n))
    rows = [(i, "a" if i % 3 else "b", " " * (i % 2) + text(int(rng.integers(1, 700)))) for i in range(60)] + [(60, "a", text(300_000))]
    for block_words in (48, 97):
        df = frame(spark, rows)
        mix = M.plan(df, shards=16, block_words=block_words, keep=True)
        at, whole, seen = {(r["row"], r["epoch"], r["shard"]): [] for r in mix.taken.collect()}, {r[0]: r[2] for r in rows}, set()
        for r in mix.taken.collect():
            at[r["row"], r["epoch"], r["shard"]].append(r["block"])
        of = {r["row"]: r["doc_id"] for r in mix.sizes.collect()}
        want = {(of[row], e, s): sorted(b) for (row, e, s), b in at.items()}
        for r in M.mixed(mix, block_words).collect():
            key = r["doc_id"], r["epoch"], r["shard"]
            seen.add(key)
            words = whole[key[0]].split()
            assert r["text"].split() == [w for b in want[key] for w in words[b * block_words : (b + 1) * block_words]]
            assert r["text"] in whole[key[0]] or len(want[key]) > 1
            if len(want[key]) == -(-len(words) // block_words):
                assert r["text"] == whole[key[0]]
        assert seen == set(want)
