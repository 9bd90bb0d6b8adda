"""Approximate nearest neighbours by multi-index hashing over learned binary codes.

Codes. Largest inner product becomes smallest angle by one more component,
``sqrt(M^2 - |x|^2)`` with M the greatest norm. Iterative quantisation learns
rotations (from several random starts) whose signs lose least; the signs of the
rotated vector are its code, ``bits`` in all. Rotations and the search radius are
fitted on at most ``SAMPLE_ROWS`` rows, and ``SAMPLE_BYTES`` of doubles, picked by a hash
of their id; every row is indexed.

Index. A code is cut into 64-bit substrings. For each substring position, a block
keeps its rows ordered by that substring. Few long substrings are more selective than
many short ones where neighbours are far: README has the figures.

Search. Codes within Hamming radius r of a query differ by at most ``t_i`` bits in
some substring i wherever the ``t_i`` add up to r - m + 1 (pigeonhole), so probing
each position's buckets within its ``t_i`` retrieves every code within r. Buckets
are found by listing the keys at that distance, or by running through the
position's distinct keys where these are fewer. What lies within r is reranked by
inner products of the original vectors in double precision. Where a block has
fewer than k rows within r, r grows until it has k or all of them, so a query
never gets fewer neighbours than exist.

Rows: vectors that are null, zero, hold null or non-finite components, have a null
id take no part. A query's candidates are the vectors of its length. Rows with a query's
id aren't its candidates; a repeated query row is answered each time. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import grid

SAMPLE_ROWS = 50_000
SAMPLE_BYTES = 64 << 20
SAMPLE_QUERIES = 400
BLOCK_ROWS = 8192
GROUP_QUERIES = 1024
#: The share of the sample's true neighbours that the radius takes in.
RADIUS_SHARE = 0.95
_SUB = 64


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    return np.concatenate((x, np.sqrt(np.maximum(top * top - (x * x).sum(1), 0))[:, None]), 1) / top


def fit_rotations(x: np.ndarray, bits: int, rounds: int = 15, seed: int = 7) -> np.ndarray:
    """Columns of rotations learned by iterative quantisation, ``bits`` of them."""
    d, found, rng = x.shape[1], [], np.random.default_rng(seed)
    while sum(r.shape[1] for r in found) < bits:
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(x.T @ np.where(x @ r >= 0, 1.0, -1.0))
            r = u @ vt
        found.append(r)
    return np.concatenate(found, 1)[:, :bits]


def codes(x: np.ndarray, rotations: np.ndarray) -> np.ndarray:
    """Packed codes, (rows, bits / 64) u64."""
    return np.packbits((x @ rotations >= 0).reshape(len(x), -1, _SUB), axis=2, bitorder="little").view("<u8")[:, :, 0]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(a, b)).sum(axis=-1, dtype=np.int64)


def fit_radius(x: np.ndarray, rotations: np.ndarray, top: float, k: int) -> int:
    """The Hamming radius that holds ``RADIUS_SHARE`` of the sample queries' nearest k."""
    c = codes(lifted(x, top), rotations)
    asked = np.linspace(0, len(x) - 1, min(len(x), SAMPLE_QUERIES)).astype(int)
    as_query = codes(_query_side(x[asked]), rotations)
    seen = []
    for q, i in enumerate(asked):
        scores = x @ x[i]
        scores[i] = -np.inf
        best = np.argpartition(-scores, min(k, len(x) - 1))[:k]
        seen.append(distances(c[best[best != i]], as_query[q]))
    seen = np.concatenate(seen) if seen else np.zeros(0)
    return int(np.quantile(seen, RADIUS_SHARE, method="higher")) if len(seen) else rotations.shape[1]


def _query_side(q: np.ndarray) -> np.ndarray:
    return np.concatenate((q / np.sqrt((q * q).sum(1))[:, None], np.zeros((len(q), 1))), 1)


@lru_cache(maxsize=None)
def masks(t: int) -> np.ndarray:
    """All substrings with at most ``t`` bits set."""
    return np.array([sum(1 << b for b in c) for n in range(t + 1) for c in combinations(range(_SUB), n)], np.uint64)


def n_masks(t: int) -> int:
    return sum(comb(_SUB, n) for n in range(t + 1))


def thresholds(radius: int, m: int) -> list[int]:
    """How many bits may differ in each of m substrings; they add up to radius - m + 1 (-1: don't probe)."""
    low, more = divmod(radius - m + 1, m)
    return [max(-1, low + (i < more)) for i in range(m)]


def build_block(ids: np.ndarray, vecs: np.ndarray, rotations: np.ndarray, top: float) -> bytes:
    """Each position's rows in order of its substring, where each key's rows begin, and the keys."""
    c, index = codes(lifted(vecs, top), rotations), {}
    for i in range(c.shape[1]):
        order = np.argsort(c[:, i], kind="stable").astype(np.uint32)
        keys, first = np.unique(c[order, i], return_index=True)
        index |= {f"order{i}": order, f"keys{i}": keys, f"first{i}": np.append(first, len(ids)).astype(np.uint32)}
    single = vecs.astype(np.float32)
    return grid.dump(ids=ids, vecs=single if np.array_equal(single, vecs) else vecs, codes=c, **index)


def retrieved(block: dict, code: np.ndarray, radius: int) -> np.ndarray:
    """Marks of the rows in the buckets that are probed for codes within ``radius``."""
    hit = np.zeros(len(block["ids"]), bool)
    for i, t in enumerate(thresholds(radius, len(code))):
        if t < 0:
            continue
        keys, first, order = (block[f"{name}{i}"] for name in ("keys", "first", "order"))
        if n_masks(t) < len(keys):
            wanted = masks(t) ^ code[i]
            at = np.searchsorted(keys, wanted)
            at = at[(at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == wanted)]
        else:
            at = np.flatnonzero(np.bitwise_count(keys ^ code[i]) <= t)
        if len(keys) == len(order):  # a row a key
            hit[order[at]] = True
        else:
            n = (first[at + 1] - first[at]).astype(np.int64)
            hit[order[np.repeat(first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]] = True
    return hit


def probe(block: dict, code: np.ndarray, radius: int) -> np.ndarray:
    """Numbers of the rows whose code is within ``radius`` of ``code``."""
    rows = np.flatnonzero(retrieved(block, code, radius))
    return rows[distances(block["codes"][rows], code) <= radius]


def scan(block: dict, group: dict, k: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids, vecs, bits = block["ids"], block["vecs"], block["codes"].shape[1] * _SUB
    for own, vec, code in zip(group["ids"], group["vecs"], group["codes"], strict=True):
        near, r = probe(block, code, radius), radius
        near = near[ids[near] != own]
        while len(near) < k and r < bits:
            r = min(bits, r + 8)
            near = probe(block, code, r)
            near = near[ids[near] != own]
        # Added up one component after the other, so that a score is the same in any block.
        scores = np.cumsum(vecs[near].astype(np.float64) * vec, axis=1)[:, -1] if len(near) else np.zeros(0)
        if len(near) > k:
            cut = -np.partition(-scores, k - 1)[k - 1]
            near, scores = near[scores >= cut], scores[scores >= cut]
        order = np.lexsort((ids[near], -scores))[:k]
        yield ids[near][order], scores[order]


def nearest(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, query_every: int = 20, bits: int = 256, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest inner products found for each row
    whose id is divisible by ``query_every``, against all other rows."""

    def run(rows: DataFrame, n: int, d: int) -> DataFrame:
        top = (rows.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).collect()[0][0] or 1.0) ** 0.5
        most = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * max(d, 1))))
        share = int(min(1.0, 0.9 * most / max(n, 1)) * (1 << 30)) if n > most else 1 << 30
        sample = grid.vectors(rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share).limit(most).select("vec").toArrow()["vec"], d)
        sample = np.unique(sample, axis=0) if len(sample) else np.eye(1, max(1, d))
        rotations = fit_rotations(lifted(sample, top), bits)
        radius = fit_radius(np.random.default_rng(3).permutation(sample), rotations, top, k)
        index = grid.packed(rows, n, d, block_rows, lambda ids, vecs: build_block(ids, vecs, rotations, top))
        asked = rows.filter(grid.is_query(query_every))
        n_asked = asked.count()
        queries = grid.packed(asked, n_asked, d, GROUP_QUERIES, lambda ids, vecs: grid.dump(ids=ids, vecs=vecs, codes=codes(_query_side(vecs), rotations)))
        return grid.search(index, queries, k, max(1, -(-n // block_rows)), max(1, -(-n_asked // GROUP_QUERIES)), lambda b, g: scan(b, g, k, radius), T.DoubleType())

    return grid.by_length(df, id_col, vec_col, False, run)
