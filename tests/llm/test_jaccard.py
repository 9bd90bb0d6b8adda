import random
import re

import numpy as np
import pytest

import corpus_pipeline as C
from folioscore.llm import jaccard as J

SCHEMA = "doc_id long, text string, fp string, root int"


def shingles(text, width=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows):
    """Rows that stay: of each chain of pairs at 0.8 or more the one with the smallest id."""
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                up[find(i)] = find(j)
    return sorted(min(d for k, (d, _) in enumerate(rows) if find(k) == i) for i in range(len(rows)) if find(i) == i)


def some_rows(seed=0):
    """Texts with copies of about every similarity from 0.6 to 1."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdéf") for _ in range(rnd.randrange(1, 6)))
    texts = ["", None, " \n ", "a b c", "A  b\tc", "a b c d"]
    for size in [5, 9, 40, 60, 90, 150, 300, 600, 2500] * 3:
        base = [word() for _ in range(size)]
        texts += [" ".join(base)]
        for share in (0.005, 0.01, 0.015, 0.02, 0.025, 0.03, 0.04, 0.06):
            near = list(base)
            for k in rnd.sample(range(size), max(1, round(share * size))):
                near[k] = word()
            texts.append(" ".join(near).upper())
    rnd.shuffle(texts)
    return [(7 * i + 3, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("limit", [None, 700])
def test_stage_against_brute_force(spark, monkeypatch, limit):
    if limit:
        monkeypatch.setattr(J, "GROUP", limit)
    rows = some_rows()
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA).repartition(3)
    got = C.drop_copies(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == brute(rows)


def test_stage_on_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    assert sorted(r["doc_id"] for r in C.drop_copies(spark, docs, "").collect()) == brute(rows)


def test_no_row_and_no_pair(spark):
    assert C.drop_copies(spark, spark.createDataFrame([], SCHEMA), "").count() == 0
    assert C.drop_copies(spark, spark.createDataFrame([(1, "a b c", "x", 1), (2, "d e f", "x", 1), (None, None, "x", 1)], SCHEMA), "").count() == 3


def test_links_at_the_threshold():
    # 8 of 10 common: a link; 7 of 9: none.
    a = np.arange(9, dtype=np.int64)
    assert list(J.linked([a, np.append(a[:8], 20)])) == [0, 0]
    assert list(J.linked([a[:8], np.append(a[:7], 20)])) == [0, 1]
