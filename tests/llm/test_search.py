import numpy as np
import pytest

from folioscore.llm import ann, bitslice, grid


def frame(spark, ids, vecs):
    rows = [(None if i is None else int(i), None if v is None else [None if x is None else float(x) for x in v], "x", 1) for i, v in zip(ids, vecs, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string, rank int")


def brute(ids, vecs, k, every, integers):
    x = np.array(vecs, np.float32).astype(np.float64)
    x = np.floor(64 * x).astype(np.int64) if integers else x
    out = []
    for i, own in enumerate(ids):
        if own % every == 0:
            s = np.cumsum(x * x[i], axis=1)[:, -1]
            best = sorted(((-s[j], ids[j]) for j in range(len(ids)) if ids[j] != own))[:k]
            out += [(own, r + 1, j, -t) for r, (t, j) in enumerate(best)]
    return out


ODD = [(900, None), (901, [1.0, None, 2.0, 0, 0, 0]), (902, [float("nan")] * 6), (903, [float("inf"), 0, 0, 0, 0, 0]), (None, [1.0] * 6), (904, [1.0, 2.0]), (905, [])]


@pytest.fixture
def data():
    rng = np.random.default_rng(1)
    vecs = rng.standard_normal((300, 6)).astype(np.float32)
    vecs[50:120] = vecs[3]  # one vector many times
    vecs[7] = 0
    return list(range(300)), vecs.tolist()


def test_bitslice_exact(spark, data):
    ids, vecs = data
    df = frame(spark, ids + [i for i, _ in ODD], vecs + [v for _, v in ODD])
    for rows in (bitslice.BLOCK_ROWS, 64):
        got = bitslice.top_inner_products(df, k=20, block_rows=rows)
        assert got.columns == ["query_id", "rank", "vec_id", "score"]
        assert sorted(map(tuple, got.collect())) == sorted(brute(ids, vecs, 20, 20, True))


def test_bitslice_arithmetic():
    rng = np.random.default_rng(2)
    values = rng.integers(-40, 40, (1000, 5))
    values[:, 3] = 6
    block = grid.load(bitslice.build_block(np.arange(1000), values))
    for w in ([3, -7, 0, 5, 1], [0] * 5, [-1, -2, -4, -8, -16], [63, 63, 63, 63, 63]):
        slices, const = bitslice.add_up(block, np.array(w))
        rows = bitslice.top_rows(slices, block["every"], 1000)
        digit = (slices[:, rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)
        assert list((digit.astype(np.int64) << np.arange(len(slices))[:, None]).sum(0) + const) == list((values @ np.array(w))[rows])


def test_components_of_any_size(spark):
    """Finite components of any size: scores are exact, and beyond a long its ends."""
    vecs = [[2.0**40, 1.0], [2.0**40, 2.0], [-(2.0**41), 5.0], [3.0e38, -3.0e38], [1.0, 1.0], [0.0, 0.0]]
    q = [[max(-(2**62), min(2**62, int(np.floor(64 * float(np.float32(x)))))) for x in v] for v in vecs]
    got = sorted(map(tuple, bitslice.top_inner_products(frame(spark, range(6), vecs), k=5, query_every=1).collect()))
    held = lambda s: max(-bitslice.MOST, min(bitslice.MOST, s))
    for i in range(6):
        want = sorted((-held(q[i][0] * q[j][0] + q[i][1] * q[j][1]), j) for j in range(6) if j != i)
        assert [g for g in got if g[0] == i] == [(i, r + 1, j, -s) for r, (s, j) in enumerate(want)]


def test_vectors_of_several_lengths(spark):
    """A query meets the vectors of its own length."""
    rng = np.random.default_rng(5)
    ids, vecs = list(range(90)), [rng.standard_normal(3 + i % 3).astype(np.float32).tolist() for i in range(90)]
    exact = sorted(map(tuple, bitslice.top_inner_products(frame(spark, ids, vecs), k=50, query_every=10).collect()))
    near = sorted(map(tuple, ann.nearest(frame(spark, ids, vecs), k=50, query_every=10).collect()))
    for got, integers in ((exact, True), (near, False)):
        want = sorted(x for d in range(3) for x in brute(ids[d::3], vecs[d::3], 50, 10, integers))
        assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want])


def test_recall_of_the_query(spark):
    """op3 over the driver's table against brute force."""
    from folioscore.llm.queries import op3_nearest_neighbours

    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    want = brute([r[0] for r in rows], [r[1] for r in rows], 20, 20, False)
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in op3_nearest_neighbours(spark, sf).collect()}
    found = [got[q, v] == s for q, _, v, s in want if (q, v) in got]
    assert all(found) and len(found) >= 0.9 * len(want) and len(got) == len(want)


def test_share_of_rows_that_probing_reads():
    """On vectors spread over the whole sphere most rows are never retrieved."""
    rng = np.random.default_rng(6)
    vecs = rng.standard_normal((8192, 64))
    vecs /= np.sqrt((vecs**2).sum(1))[:, None]
    rotations = ann.fit_rotations(ann.lifted(vecs, 1.0), 256)
    radius = ann.fit_radius(vecs, rotations, 1.0, 20)
    block = grid.load(ann.build_block(np.arange(8192), vecs, rotations, 1.0))
    code = ann.codes(ann._query_side(vecs[:50]), rotations)
    assert np.mean([ann.retrieved(block, c, radius).mean() for c in code]) < 0.4


def test_nearest_finds_all_when_few(spark):
    vecs = np.random.default_rng(3).standard_normal((15, 6)).tolist()
    df = frame(spark, [*range(15)] + [i for i, _ in ODD] + [16], vecs + [v for _, v in ODD] + [[0.0] * 6])
    assert sorted(map(tuple, ann.nearest(df).collect())) == sorted(brute(list(range(15)), vecs, 20, 20, False))


def test_nearest_recall_and_ties(spark, data):
    ids, vecs = data
    keep = [i for i in ids if i != 7]
    got = ann.nearest(frame(spark, ids, vecs), k=20, block_rows=64).collect()
    want = brute(keep, [vecs[i] for i in keep], 20, 20, False)
    scores = {(q, v): s for q, _, v, s in want}
    assert all(abs(scores[r["query_id"], r["vec_id"]] - r["score"]) < 1e-12 for r in got if (r["query_id"], r["vec_id"]) in scores)
    assert len({(r["query_id"], r["vec_id"]) for r in got} & set(scores)) >= 0.9 * len(want) and len(got) == len(want)


def test_probe_retrieves_every_code_within_the_radius():
    rng = np.random.default_rng(4)
    vecs = rng.standard_normal((2000, 8))
    top = np.sqrt((vecs**2).sum(1).max())
    rotations = ann.fit_rotations(ann.lifted(vecs, top), 192)
    block = grid.load(ann.build_block(np.arange(2000), vecs, rotations, top))
    for radius in (0, 2, 3, 7, 12, 30, 64, 120, 192):
        for q in range(20):
            near = np.flatnonzero(ann.distances(block["codes"], block["codes"][q]) <= radius)
            assert list(ann.probe(block, block["codes"][q], radius)) == list(near)


def test_repeated_rows_and_empty(spark):
    df = frame(spark, [0, 0, 1, 2], [[1.0, 0], [1.0, 0], [0.5, 1], [2.0, 0]])
    for f in (ann.nearest, bitslice.top_inner_products):
        got = [(r["query_id"], r["rank"], r["vec_id"]) for r in f(df).collect()]
        assert sorted(got) == [(0, 1, 2), (0, 1, 2), (0, 2, 1), (0, 2, 1)]
        assert f(frame(spark, [], [])).count() == 0
