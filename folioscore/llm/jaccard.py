"""SimHash near-duplicates at an exact Jaccard similarity: the pipeline's near-dedup.

Shingles: those of ``simhash``, as a set of their XXH64 values. Texts with the same
set share a key (``fp``), texts without a word the key 0; the join runs over keys.

Links: two sets of which at least ``LEAST`` (a fraction) of the union is common. The
trie's self-join of ``simhash`` proposes all pairs of fingerprints within ``BUDGET`` bits.
That can't propose every link: at similarity 0.8 two fingerprints of 64 bits differ in
ten bits on average and in over 16 now and then, which is as near as unrelated texts come
in a large corpus. So min-hashes propose besides: ``BANDS`` bands of ``ROWS`` minima each,
and sets that agree on a band are candidates. A pair at 0.8 agrees on none with
probability (1 - 0.8^5)^48 = 5e-9, a more similar one more rarely still.

Candidates send no pairs but stars, so a group costs no more rows than it has members.
Their components are only groups within which links are sought: each
group's sets are brought together and every pair of them is counted out exactly. A
group of more than ``GROUP`` shingles is split into parts, and each pair of parts is a
unit of its own. Links go out as stars too, and are joined to components as in
``simhash``.

Rows: as in ``simhash``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, staged
from .simhash import Forest, components, fingerprint_of, one_of_each, row_key, shingle_hashes, star_edges

LEAST = (4, 5)
BUDGET = 4
BANDS, ROWS = 48, 5
GROUP = 100_000
#: Bits of the map that spares most other texts their hashing; its size is fixed.
_MAP = 1 << 23
_SLICE = 2048
_RNG = np.random.default_rng(8)
_TIMES, _PLUS = _RNG.integers(0, 1 << 63, (2, BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _RNG.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _RNG.integers(0, 1 << 63, BANDS, np.uint64)


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Distinct shingles' hashes, sorted."""
    return np.unique(shingle_hashes(text, width))


def set_key(s: np.ndarray) -> int:
    from xxhash import xxh64_intdigest as h

    return int(np.uint64(h(s.tobytes())).view(np.int64)) if len(s) else 0


def bands(s: np.ndarray) -> np.ndarray:
    """A key for each band of the set's min-hashes; none of an empty set."""
    if not len(s):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), _SLICE):
        np.minimum(least, (s[at : at + _SLICE] * _TIMES + _PLUS).min(1), out=least)
    return (((least.reshape(BANDS, ROWS) >> np.uint64(7)) * _MIX).sum(1, dtype=np.uint64) ^ _BAND).view(np.int64)


def prints(docs: DataFrame, width: int) -> DataFrame:
    """key (``row_key``), fp (key of the text's set), n (size of it), bands and sim (SimHash
    fingerprint) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1).cast(pa.binary()):
                hashes = shingle_hashes(t.as_py() or b"", width)
                s = np.unique(hashes)
                rows.append((set_key(s), len(s), bands(s), fingerprint_of(hashes)))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64())
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["key", "fp", "n", "bands", "sim"])

    rows = docs.select(row_key(docs).alias("key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "key struct<doc_id:long,h:long,row:long>, fp long, n long, bands array<long>, sim long")


def text_hash():
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def band_edges(rows: DataFrame) -> DataFrame:
    """(a, b) stars over the keys that agree on a band."""
    keys = rows.select("fp", "bands").dropDuplicates(["fp"]).select("fp", F.explode("bands").alias("key"))
    n = shuffle_partitions(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            key, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            new = np.append(True, key[1:] != key[:-1])
            first = fp[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
            if last is not None and last[0] == key[0]:  # a key's rows go on from the batch before
                first = np.where(key == key[0], last[1], first)
            last = key[-1], first[-1]
            tied = first != fp
            yield pa.RecordBatch.from_arrays([pa.array(fp[tied]), pa.array(first[tied])], names=["a", "b"])

    return keys.repartition(n, "key").sortWithinPartitions("key", "fp").select("key", "fp").mapInArrow(run, "a long, b long")


def trie_edges(rows: DataFrame) -> DataFrame:
    """(a, b) stars over the keys whose fingerprints the trie links, and over those of one
    fingerprint."""
    keys = staged(rows.select("fp", "sim").distinct(), "keys")
    least = staged(keys.groupBy("sim").agg(F.min("fp").alias("least")), "least")
    same = keys.join(least, "sim").filter("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b"))
    of = lambda c: least.select(F.col("sim").alias(c), F.col("least").alias(f"_{c}"))
    linked = star_edges(least.select(F.col("sim").alias("fp")), BUDGET).join(of("a"), "a").join(of("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    return same.unionByName(linked)


def sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(h, set) of the texts whose hash is in ``wanted`` (h long) and, by the map's size, a few others."""
    at = F.shiftrightunsigned("h", 20).bitwiseAND(_MAP - 1)
    words = wanted.select((at / 32).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, 20) & {_MAP - 1} as int) % 32)").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits"))
    held = np.zeros(_MAP // 32, np.uint32)
    for w, bits in words.collect():  # at most _MAP / 32 rows
        held[w] = bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False)
            at = (h.view(np.uint64) >> np.uint64(20)) & np.uint64(_MAP - 1)
            some = [i for i in np.flatnonzero(held[at >> np.uint64(5)] >> (at & np.uint64(31)).astype(np.uint32) & 1).tolist() if not (h[i] in seen or seen.add(h[i]))]
            sets = [shingle_set(batch.column(1)[i].as_py().encode(), width).view(np.int64) for i in some]
            yield pa.RecordBatch.from_arrays([pa.array(h[some]), pa.array(sets, pa.list_(pa.int64()))], names=["h", "set"])

    return docs.select(text_hash().alias("h"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, "h long, set array<long>").dropDuplicates(["h"])


def linked(sets: list[np.ndarray], least: tuple[int, int] = LEAST) -> np.ndarray:
    """For each of the sets the first of those that chains of links join it to."""
    forest = Forest(len(sets))
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    values, token = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(token, kind="stable")
    ends = np.cumsum(np.bincount(token, minlength=len(values)))
    posted, ends = owner[order], np.append(0, ends)
    first = np.append(0, np.cumsum(size))
    for i in range(len(sets)):
        own = token[first[i] : first[i + 1]]
        own = own[ends[own + 1] - ends[own] > 1]
        n = ends[own + 1] - ends[own]
        if not len(own):
            continue
        common = np.bincount(posted[np.arange(n.sum()) + np.repeat(ends[own] - np.cumsum(n) + n, n)], minlength=len(sets))
        near = np.flatnonzero(common[:i] * least[1] >= least[0] * (size[:i] + size[i] - common[:i]))
        forest.link(np.full(len(near), i), near)
    return forest.root


def link_edges(sets: DataFrame) -> DataFrame:
    """(a, b) edges between keys that join exactly those which chains of links join, in each
    group of ``sets`` (fp, root, total, set)."""
    parts = F.ceil(F.col("total") / GROUP).cast("int")
    dealt = sets.withColumn("p", parts).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("p")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("p") - 1)))
    units = dealt.select("root", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "fp", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, fps, held = None, [], []
        for batch in batches:
            root, i, j, fp = (batch.column(k).to_pylist() for k in range(4))
            for k, u in enumerate(zip(root, i, j, strict=True)):
                if u != unit:
                    yield from joined(fps, held)
                    unit, fps, held = u, [], []
                fps.append(fp[k])
                held.append(batch.column(4)[k].values.to_numpy())
        yield from joined(fps, held)

    def joined(fps: list[int], held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if len(fps) > 1:
            root, fp = linked(held), np.array(fps, np.int64)
            tied = np.flatnonzero(root != np.arange(len(root)))
            if len(tied):
                yield pa.RecordBatch.from_arrays([pa.array(fp[tied]), pa.array(fp[root[tied]])], names=["a", "b"])

    unit = ["root", "i", "j"]
    return units.repartition(shuffle_partitions(sets.sparkSession), *unit).sortWithinPartitions(*unit).mapInArrow(run, "a long, b long")


def deduplicated(docs: DataFrame, width: int = 5) -> DataFrame:
    """``docs`` with one row of each component: the smallest doc_id's (null ids only where
    there is no other), of repeated ids the text with the smallest hash."""
    rows = staged(prints(docs, width), "prints")
    near = components(trie_edges(rows).unionByName(band_edges(rows)))
    near = near.unionByName(near.select(F.col("root").alias("node"), "root")).distinct()
    one = rows.groupBy("fp").agg(F.min("key.h").alias("h"), F.min("n").alias("n"))
    groups = staged(one.join(near.withColumnRenamed("node", "fp"), "fp"), "groups")
    totals = groups.groupBy("root").agg(F.sum("n").alias("total"))
    sets = sets_of(docs, groups.select("h"), width).join(groups.join(totals, "root"), "h")
    roots = components(link_edges(sets.select("fp", "root", "total", "set")))
    return one_of_each(docs, rows.select("key", "fp"), roots)
