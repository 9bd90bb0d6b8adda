"""Exact top-k inner products of quantised vectors by a bit-sliced index.

Components become integers, ``floor(scale * x)``. A block of rows keeps each
attribute, less the block's minimum, as bit slices: one bitmap over the rows for
each binary digit. A query's score is a weighted sum of attributes, so it is added
up with bitmap arithmetic alone: weight w contributes the attribute's slices
shifted by each of w's digits (for w < 0 the complemented slices, which differ by
a constant), and carry-save adders reduce the bitmaps of each digit to the score's
own slices. The k greatest rows are read off those from the most significant slice
downward: rows certainly in, rows tied so far. The rows still tied after the last
slice have equal scores and are taken by smallest id.

Sums have as many slices as they need, so scores are exact for components of any size
that a long holds (larger ones count as the largest, 2^62); a score that a long can't
hold counts as the nearest that it can.

Rows: vectors that are null, hold null or non-finite components or have a null id take no
part; an empty or zero vector scores 0. A query's candidates are the vectors of its length.
Rows with a query's id aren't its candidates; a repeated query row is answered each time.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import grid

BLOCK_ROWS = 32_768
GROUP_QUERIES = 512
#: Largest quantised component, and largest score.
LARGEST = 1 << 62
MOST = (1 << 63) - 1


def quantised(vecs: np.ndarray, scale: float) -> np.ndarray:
    return np.clip(np.floor(vecs * scale), -float(LARGEST), float(LARGEST)).astype(np.int64)


def bitmap(marks: np.ndarray) -> np.ndarray:
    """Rows (axis 0) of marks as u64 words, one bitmap for each further column."""
    n = -(-len(marks) // 64) * 64
    bits = np.zeros((n, *marks.shape[1:]), bool)
    bits[: len(marks)] = marks
    return np.ascontiguousarray(np.packbits(bits.T, axis=-1, bitorder="little").view("<u8"))


def rows_of(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def build_block(ids: np.ndarray, values: np.ndarray) -> bytes:
    """Slices of every attribute, from the least significant digit, and their complements."""
    low = values.min(0) if values.size else np.zeros(values.shape[1], np.int64)
    rest = values.astype(np.uint64) - low.astype(np.uint64)  # modulo 2^64, which holds every difference
    digits = np.array([int(m).bit_length() for m in (rest.max(0) if rest.size else low)], np.int64)
    slices = [bitmap((rest[:, d] >> np.uint64(j)) & np.uint64(1) == 1) for d in range(values.shape[1]) for j in range(digits[d])]
    every = bitmap(np.ones(len(ids), bool))
    plain = np.array(slices, np.uint64).reshape(-1, len(every))
    return grid.dump(ids=ids, low=low, digits=digits, every=every, slices=np.concatenate((plain, ~plain & every)))


def add_up(block: dict, weights: np.ndarray) -> tuple[np.ndarray, int]:
    """Slices of sum(weights * attributes) plus a constant that makes it non-negative,
    and that constant's negative."""
    digits, slices = block["digits"], block["slices"]
    n, first = len(slices) // 2, np.cumsum(digits) - digits
    const = sum(w * x for w, x in zip(weights.tolist(), block["low"].tolist(), strict=True))
    wanted: dict[int, list[np.ndarray]] = {}
    for d in np.flatnonzero((weights != 0) & (digits > 0)):
        w, at = int(weights[d]), int(first[d])
        if w < 0:
            const += w * ((1 << int(digits[d])) - 1)
            at += n
        own = np.arange(at, at + digits[d])
        for p in range(abs(w).bit_length()):
            if abs(w) >> p & 1:
                for j in range(digits[d]):
                    wanted.setdefault(p + j, []).append(own[j])
    out, carried, p, last = [], [], 0, max(wanted, default=-1)
    while p <= last or carried:
        here = slices[wanted[p]] if p in wanted else np.zeros((0, slices.shape[1]), np.uint64)
        here = np.concatenate((here, *carried)) if carried else here
        carried = []
        while len(here) > 1:
            g = len(here) // 3
            if g:
                a, b, c = here[:g], here[g : 2 * g], here[2 * g : 3 * g]
                x = a ^ b
                carried.append((a & b) | (x & c))
                here = np.concatenate((x ^ c, here[3 * g :]))
            else:
                carried.append(here[:1] & here[1:])
                here = here[:1] ^ here[1:]
        out.append(here[0] if len(here) else np.zeros(slices.shape[1], np.uint64))
        p += 1
    return np.array(out, np.uint64).reshape(len(out), slices.shape[1]), const


def top_rows(slices: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k rows of ``among`` with the greatest values, ties to the smaller number."""
    sure, tied = np.zeros_like(among), among
    for s in slices[::-1]:
        up = tied & s
        have = int(np.bitwise_count(sure | up).sum())
        if have > k:
            tied = up
        else:
            sure, tied = sure | up, tied & ~s
            if have == k:
                break
    found = rows_of(sure)
    return np.concatenate((found, rows_of(tied)[: k - len(found)])) if len(found) < k else found


def scan(block: dict, group: dict, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids = block["ids"]
    for own, weights in zip(group["ids"], group["values"], strict=True):
        slices, const = add_up(block, weights)
        among = block["every"].copy()
        for r in range(*np.searchsorted(ids, [own, own + 1])):  # ids are sorted
            among[r >> 6] &= ~(np.uint64(1) << np.uint64(r & 63))
        wide = len(slices) >= 62 or abs(const) >= 1 << 62
        rows = rows_of(among) if wide else top_rows(slices, among, k)
        values = values_of(slices, rows, const)
        if wide:  # scores at a long's ends tie, which the slices don't know
            best = np.lexsort((ids[rows], -values))[:k]
            rows, values = rows[best], values[best]
        yield ids[rows], values


def values_of(slices: np.ndarray, rows: np.ndarray, const: int) -> np.ndarray:
    """What the slices hold for the rows, plus ``const``, within what a long holds."""
    digit = (slices[:, rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)
    if len(slices) < 62 and abs(const) < 1 << 62:
        return (digit.astype(np.int64) << np.arange(len(slices))[:, None]).sum(0) + const
    exact = [sum(1 << int(p) for p in np.flatnonzero(digit[:, j])) + const for j in range(len(rows))]
    return np.array([min(MOST, max(-MOST, x)) for x in exact], np.int64)


def top_inner_products(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, query_every: int = 20, scale: float = 64.0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` greatest integer inner products for each
    row whose id is divisible by ``query_every``, against all other rows."""

    def run(rows: DataFrame, n: int, d: int) -> DataFrame:
        index = grid.packed(rows, n, d, block_rows, lambda ids, vecs: build_block(ids, quantised(vecs, scale)))
        asked = rows.filter(grid.is_query(query_every))
        n_asked = asked.count()
        queries = grid.packed(asked, n_asked, d, GROUP_QUERIES, lambda ids, vecs: grid.dump(ids=ids, values=quantised(vecs, scale)))
        return grid.search(index, queries, k, max(1, -(-n // block_rows)), max(1, -(-n_asked // GROUP_QUERIES)), lambda b, g: scan(b, g, k), T.LongType())

    return grid.by_length(df, id_col, vec_col, True, run)
