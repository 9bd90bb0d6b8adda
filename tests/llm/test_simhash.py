import random
import re

import numpy as np
import pytest
import xxhash

from folioscore.llm import simhash as S


def brute(rows, width=4, budget=4):
    fps = []
    for _, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        words = re.findall("[^\x20\x09-\x0d]+", low)
        sh = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [" ".join(words)] * bool(words)
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    up = list(range(len(rows)))
    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= budget:
                up[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        own = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((str(d), f"{fps[i]:016x}", min(own) if own else None))
    return sorted(out, key=str)


def some_rows(seed=0):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdéf") for _ in range(rnd.randrange(1, 5)))
    rows = []
    for i in range(30):
        base = [word() for _ in range(rnd.choice([1, 3, 4, 5, 40, 300]))]
        rows.append((3 * i + 5, " ".join(base)))
        for j in range(rnd.randrange(4)):
            near = list(base)
            near[rnd.randrange(len(near))] = word()
            rows.append((1000 - 3 * i - j * 97, "\t".join(near).upper()))
    return rows + [(2000, ""), (1, None), (3, " \n "), (None, "a b c d e"), (77, "a b c d e"), (None, "unlike"), (rows[0][0], rows[0][1]), (9999, "long " * 50_000)]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, fp string, root int")


@pytest.mark.parametrize("limit", [None, 5])
def test_against_brute_force(spark, monkeypatch, limit):
    if limit:
        monkeypatch.setattr(S, "SUBTREE", limit)
    rows = some_rows()
    got = S.near_duplicates(frame(spark, rows))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(((str(r[0]), r[1], r[2]) for r in got.collect()), key=str) == brute(rows)


def test_empty(spark):
    assert S.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_walk_links_what_brute_force_links(seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 62, 12, dtype=np.uint64)
    keys = [c ^ np.uint64(sum(1 << int(b) for b in rng.choice(52, rng.integers(0, 9), replace=False))) for c in centres for _ in range(60)]
    keys = np.unique(np.array(keys, np.uint64) & np.uint64((1 << 52) - 1))
    root = S.walk(keys, np.array([0, len(keys)]), 12, 4).root
    near = np.bitwise_count(keys[:, None] ^ keys[None, :]) <= 4
    label = np.arange(len(keys))
    while True:
        new = np.where(near, label[None, :], len(keys)).min(1)
        if (new == label).all():
            break
        label = new
    assert list(root) == list(label)


def test_long_chain_of_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (-3, 100)]
    got = {r["node"]: r["root"] for r in S.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100: -3, 101: -3}
