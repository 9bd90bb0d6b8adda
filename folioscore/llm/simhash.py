"""SimHash near-duplicates by a binary trie's self-join.

Fingerprints: A-Z in lower case, words between ASCII white space, shingles of
``width`` words joined by a space; a bit of the fingerprint is 1 if it is set in
over half of the shingles' XXH64 values. Texts without a word have fingerprint 0.

Links: two fingerprints within ``budget`` bits. Exact copies share a fingerprint,
so the join runs over distinct fingerprints. Of ``budget + 2`` stretches of bits
two linked fingerprints agree on at least two; for each pair of stretches the
fingerprints' bits are put in an order that begins with them and stored in a trie.
Subtrees below one value of both stretches (21 bits or more where the budget is 4) are
the units that are dealt out. In each, pairs of nodes are walked together from the root,
level by level: a step down adds a bit where the pair's branches differ, and a pair is
left as soon as its differing bits exceed the budget. Pairs of small nodes are compared
outright.

A subtree with more than ``SUBTREE`` fingerprints is split into parts, and each
pair of parts is a unit of its own, so a unit's size is bounded. A unit sends no
pairs but a star for each of its components (every member to the smallest), so a
dense group costs no more rows than it has members. Components are then found by
alternating large-star and small-star steps over those edges, each step written
to the shared folder. Minima are dealt or written before they are joined to their
members: both sides are plain shuffles then, so that the members of a hub (or the copies of
one fingerprint) are split among tasks.

Rows: a null text has no words. A null doc_id can't be a component's smallest id
unless nothing else is there. Repeated rows are each returned. Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, shuffle_partitions, staged

BITS = 64
SEED = 42
SUBTREE = 20_000
#: Rows of whole subtrees that are walked at once, and pairs of nodes held at once.
_TOGETHER = 50_000
_FRONT = 1 << 20
_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    from xxhash import xxh64_intdigest as h

    words = text.translate(_FOLD).split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([h(line, SEED)], np.uint64)
    ends = np.cumsum([len(w) for w in words]) + np.arange(len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.array([h(line[a:b], SEED) for a, b in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: bytes, width: int) -> int:
    return fingerprint_of(shingle_hashes(text, width))


def fingerprint_of(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int, *carry: Column) -> DataFrame:
    """(doc_id, fp) of every row and the columns ``carry``; the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = pa.array([fingerprint(t.as_py() or b"", width) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps, *batch.columns[2:]], schema=pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), *list(batch.schema)[2:]]))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType()), *rows.schema.fields[2:]])
    return rows.mapInArrow(run, schema)


class Forest:
    """Components of a unit's fingerprints, by smallest member."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def walk(keys: np.ndarray, first: np.ndarray, top: int, budget: int) -> Forest:
    """Link the keys within ``budget`` bits of each other in each subtree. ``keys``:
    u64, sorted and distinct within each subtree; ``first``: where subtrees begin, with
    the end; they agree on their ``top`` leading bits."""
    forest = Forest(len(keys))
    lo, hi = first[:-1].copy(), first[1:].copy()
    zero = np.zeros(len(lo), np.int8)
    ones: dict[int, np.ndarray] = {}
    fronts = [(top, lo, hi, lo, hi, zero)]
    while fronts:
        level, alo, ahi, blo, bhi, diff = fronts.pop()
        small = (ahi - alo) * (bhi - blo) <= 16
        if level >= BITS:
            small[:] = True
        if small.any():
            _compare(keys, forest, alo[small], ahi[small], blo[small], bhi[small], budget)
            alo, ahi, blo, bhi, diff = (x[~small] for x in (alo, ahi, blo, bhi, diff))
        if not len(alo):
            continue
        if level not in ones:
            ones[level] = np.concatenate(([0], np.cumsum((keys >> np.uint64(BITS - 1 - level)) & np.uint64(1), dtype=np.int64)))
        count = ones[level]
        amid, bmid = ahi - (count[ahi] - count[alo]), bhi - (count[bhi] - count[blo])
        same = alo == blo
        pairs = (
            (alo, amid, blo, bmid, diff),
            (amid, ahi, bmid, bhi, diff),
            (alo, amid, bmid, bhi, diff + 1),
            *[tuple(x[~same] for x in (amid, ahi, blo, bmid, diff + 1))],
        )
        down = [np.concatenate(x) for x in zip(*pairs, strict=True)]
        keep = (down[0] < down[1]) & (down[2] < down[3]) & (down[4] <= budget)
        keep &= ~((down[0] == down[2]) & (down[1] - down[0] == 1))  # a leaf with itself
        down = [x[keep] for x in down]
        for at in range(0, len(down[0]), _FRONT):
            fronts.append((level + 1, *(x[at : at + _FRONT] for x in down)))
    return forest


def _compare(keys: np.ndarray, forest: Forest, alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray, budget: int) -> None:
    for at in range(0, len(alo), _FRONT):
        a0, a1, b0, b1 = (x[at : at + _FRONT] for x in (alo, ahi, blo, bhi))
        wide = b1 - b0
        n = (a1 - a0) * wide
        pair = np.repeat(np.arange(len(n)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        a, b = a0[pair] + k // wide[pair], b0[pair] + k % wide[pair]
        near = (a != b) & (np.bitwise_count(keys[a] ^ keys[b]) <= budget)
        forest.link(a[near], b[near])


def stretches(budget: int) -> list[tuple[int, int]]:
    """(first bit from the top, length) of budget + 2 stretches that cover the bits."""
    ends = np.linspace(0, BITS, budget + 3).astype(int)
    return [(int(a), int(b - a)) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def arranged(fp: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    """The fingerprints' bits with the stretches in ``order``, from the top."""
    fp, out, left = fp.view(np.uint64), np.zeros(len(fp), np.uint64), BITS
    for at, size in order:
        left -= size
        bits = (fp >> np.uint64(BITS - at - size)) & np.uint64((1 << size) - 1)
        out |= bits << np.uint64(left)
    return out


def star_edges(fps: DataFrame, budget: int) -> DataFrame:
    """(a, b) edges between distinct fingerprints (fp long) that join exactly those which
    chains of links join. A member's edge goes to its unit's smallest."""
    every = stretches(budget)
    pairs = list(combinations(every, 2))
    n = shuffle_partitions(fps.sparkSession)
    value = lambda part: F.shiftrightunsigned(F.shiftleft("fp", part[0]), BITS - part[1])
    keys = F.array(*[F.shiftleft(value(x), y[1]).bitwiseOR(value(y)) for x, y in pairs])
    placed = fps.select("fp", F.posexplode(keys).alias("t", "key"))
    large = placed.groupBy("t", "key").count().filter(F.col("count") > SUBTREE).select("t", "key", F.ceil(F.col("count") / SUBTREE).cast("int").alias("n"))
    # A large subtree's parts i, j with i <= j are a unit: part i is sent to all of its n units.
    units = placed.join(large, ["t", "key"], "left").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    other = F.explode(F.when(F.col("n").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("n") - 1)))
    units = units.withColumn("other", other).select("t", "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "fp")
    unit = ["t", "key", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            rest = cols if rest is None else [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            if len(rest[0]) >= _TOGETHER:
                change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in rest[:4]], axis=0)) + 1
                if len(change):
                    yield from joined([c[: change[-1]] for c in rest])
                    rest = [c[change[-1] :] for c in rest]
        if rest is not None and len(rest[0]):
            yield from joined(rest)

    def joined(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for t, pair in enumerate(pairs):
            mine = cols[0] == t
            if not mine.any():
                continue
            key, i, j, fp = (c[mine] for c in cols[1:])
            keys = arranged(fp, [*pair, *(x for x in every if x not in pair)])
            order = np.lexsort((keys, j, i, key))
            key, i, j, fp, keys = (c[order] for c in (key, i, j, fp, keys))
            new = np.ones(len(keys), bool)
            new[1:] = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            root = walk(keys, np.append(np.flatnonzero(new), len(keys)), pair[0][1] + pair[1][1], budget).root
            tied = np.flatnonzero(root != np.arange(len(root)))
            if len(tied):
                yield pa.RecordBatch.from_arrays([pa.array(fp[tied]), pa.array(fp[root[tied]])], names=["a", "b"])

    filled = units.withColumns({"i": F.coalesce("i", F.lit(0)), "j": F.coalesce("j", F.lit(0))})
    return filled.repartition(n, *unit).sortWithinPartitions(*unit).select(F.col("t").cast("int"), "key", "i", "j", "fp").mapInArrow(run, "a long, b long")


def _spread(minima: DataFrame) -> DataFrame:
    """``minima`` (a, m) dealt by a hash of a of its own: a join by a shuffles them once more,
    plainly, where it would otherwise take the aggregate's partitions, which can't be split."""
    return minima.repartition(shuffle_partitions(minima.sparkSession), F.xxhash64("a"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b long) but the roots: the smallest
    node that chains of edges reach. Large-star and small-star steps in turn, until
    nothing changes; each step's edges are at most as many as before, and written out."""
    edges = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = _spread(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(_spread(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        old, edges = edges, staged(small, "edges")
        dropped(old)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0])
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def linked(docs: DataFrame, width: int, budget: int, *carry: Column) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every row with the columns ``carry``, and (node, root) of the
    fingerprints that aren't their component's root."""
    prints = staged(fingerprints(docs, width, *carry), "fingerprints")
    return prints, components(star_edges(prints.select("fp").distinct(), budget))


def _by_root(prints: DataFrame, roots: DataFrame, least: Column) -> DataFrame:
    """(fp, root, least): one row for each fingerprint. Copies combine before any shuffle
    by root, so a component's rows there are its different texts."""
    per_fp = prints.groupBy("fp").agg(F.min(least).alias("least"))
    return per_fp.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")


def near_duplicates(docs: DataFrame, width: int = 4, budget: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of ``docs``."""
    prints, roots = linked(docs, width, budget)
    per_fp = staged(_by_root(prints, roots, F.col("doc_id")), "roots")
    smallest = staged(per_fp.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
    classes = staged(per_fp.join(smallest, "root").select("fp", "component_id"), "classes")
    return prints.join(classes, "fp").select("doc_id", hex_of("fp").alias("fingerprint"), "component_id")


def row_key(docs: DataFrame) -> Column:
    """doc_id, h (hash of the text) and row (hash of all columns) as one value."""
    maps = {f.name for f in docs.schema if "map<" in f.dataType.simpleString()}
    row = F.xxhash64(*[F.to_json(F.struct(c)) if c in maps else F.col(c) for c in docs.columns])
    text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return F.struct(F.col("doc_id").cast("long").alias("doc_id"), text.alias("h"), row.alias("row"))


def one_of_each(docs: DataFrame, prints: DataFrame, roots: DataFrame) -> DataFrame:
    """``docs`` with one row of each component of ``prints`` (key: ``row_key``, fp): the
    smallest doc_id's (null ids only where there is no other), of repeated ids the text with
    the smallest hash, of repeated texts the row with the smallest. Only keys decide, so
    texts are read once the rows that stay are known; rows alike in every column are all
    that is gathered by key."""
    per_fp = _by_root(prints, roots, F.struct(F.col("key.doc_id").isNull().alias("no"), "key"))
    # A struct's null fields are equal in joins and here, so null ids need no case of their own.
    first = per_fp.groupBy("root").agg(F.min("least").alias("m")).select(F.col("m.key").alias("key"))
    times = prints.groupBy("key").agg(F.count("*").alias("n"))
    chosen = staged(first.join(times, "key"), "chosen")
    keyed = docs.select(row_key(docs).alias("key"), F.struct(*docs.columns).alias("_all"))
    single = keyed.join(chosen.filter("n = 1").select("key"), "key", "left_semi")
    several = keyed.join(chosen.filter("n > 1").select("key"), "key", "left_semi").dropDuplicates(["key"])
    return single.unionByName(several).select(*[F.col("_all")[c].alias(c) for c in docs.columns])


def hex_of(fp: str) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
