"""The registered queries op1, op5, op8 and op9 as they are, over whole tables."""

import re
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from folioscore.llm import queries as Q

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return sorted(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()))


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_op1(spark, docs):
    got = Q.op1_token_files(spark, SF)
    assert dict(got.dtypes).items() >= {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"}.items()
    tok, at, want = Tokenizer.from_file(public_tokenizers.path(Q.BYTE_BPE)), 0, []
    for doc_id, text, _ in docs:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert rows(got, "doc_id", "start", "n_tokens", "ids_crc32") == want


def test_op5(spark, docs):
    got = Q.op5_quality(spark, SF)
    assert dict(got.dtypes).items() >= {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}.items()
    found = rows(got, "doc_id", "held_out", "score", "predicted")
    assert [r[0] for r in found] == [d[0] for d in docs]
    for doc_id, held_out, score, predicted in found:
        assert held_out == (zlib.crc32(str(doc_id).encode()) % 5 == 0) and 0 <= score <= 1 and predicted == int(score >= 0.3)
    labels = dict(map(tuple, spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect()))
    judged = [(labels[d], p) for d, held, _, p in found if held and labels.get(d) is not None]
    assert np.mean([a == b for a, b in judged]) >= 0.9


def test_op8(spark, docs):
    got = Q.op8_simhash(spark, SF)
    assert dict(got.dtypes).items() >= {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}.items()
    prints = {}
    for doc_id, text, _ in docs:
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[doc_id] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {d: d for d in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    assert rows(got, "doc_id", "fingerprint", "component_id") == [(d, f"{prints[d]:016x}", find(d)) for d in sorted(prints)]


def test_op9(spark, docs):
    got = Q.op9_mixing(spark, SF)
    assert dict(got.dtypes).items() >= {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"}.items()
    sizes = {d: len(WORD.findall(t or "")) for d, t, _ in docs}
    of, names = defaultdict(int), sorted({s for _, _, s in docs if s is not None}) + [None] * any(s is None for _, _, s in docs)
    for d, _, s in docs:
        of[s] += sizes[d]
    weights, target, left, free = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, {}, float(sum(of.values())), list(names)
    while free:
        over = [s for s in free if left * weights[s] / sum(weights[x] for x in free) > 3 * of[s]]
        if not over:
            target |= {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
            break
        target |= {s: 3.0 * of[s] for s in over}
        left -= sum(3 * of[s] for s in over)
        free = [s for s in free if s not in over]
    found = rows(got, "doc_id", "size", "source_size", "target", "taken")
    taken = defaultdict(int)
    for (doc_id, size, source_size, goal, took), (d, _, s) in zip(found, docs, strict=True):
        assert (doc_id, size, source_size) == (d, sizes[d], of[s]) and goal == pytest.approx(target[s]) and 0 <= took <= 3 * size
        taken[s] += took
    assert all(abs(taken[s] - target[s]) <= 0.05 * target[s] + 1024 for s in names)
    assert rows(Q.op9_mixing(spark, SF), "doc_id", "taken") == [(r[0], r[4]) for r in found]


def test_batches_are_bounded_by_bytes(spark):
    from folioscore.llm import common as C

    before = spark.conf.get(C._BATCH_SETTING)
    try:
        C.bounded_batches(spark)
        assert int(spark.conf.get(C._BATCH_SETTING)) == C.BATCH_BYTES
        spark.conf.set(C._BATCH_SETTING, "1000")
        C.bounded_batches(spark)
        assert spark.conf.get(C._BATCH_SETTING) == "1000"
        rows = spark.range(0, 40, 1, 1).selectExpr("repeat('x', 500) as text").mapInPandas(lambda parts: (p.assign(n=len(p))[["n"]] for p in parts), "n long")
        assert max(r["n"] for r in rows.collect()) < 40
    finally:
        spark.conf.set(C._BATCH_SETTING, before)
